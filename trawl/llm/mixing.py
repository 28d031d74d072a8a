"""Mixing sources to target weights with DataFrame functions only.

Weights become targets by capped water-filling: sources whose share would pass
their maximum of epochs are clamped there, and what is left is shared again by
weight among the rest until none is above. Every document is then taken a whole
number of times, and a seeded order of the documents decides who is taken once
more, until the source's words are spent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawl.session import stage_table

#: Slices of a source's seeded order; no window holds more than about a 4096th of a source.
_SLICE_DIGITS = 3


def word_count(text: str = "text"):
    """Number of runs without space, tab, LF, VT, FF and CR; 0 for null."""
    spaced = F.translate(F.coalesce(F.col(f"`{text}`"), F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.filter(F.split(spaced, " "), lambda w: w != "")).cast("bigint")


def ranked_sources(sources: DataFrame) -> DataFrame:
    """Add `place`: the position from 0 by code point, null last; exact at any number of sources.

    Range partitions are numbered inside, and the few partition sizes are added
    up before them, so no task sees all sources.
    """
    order = [F.col("source").asc_nulls_last()]
    parted = stage_table(sources.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = parted.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return parted.withColumn("_in", within).join(sizes.withColumn("_before", before), "_part").select(
        *sources.columns, (F.col("_before") + F.col("_in")).alias("place")
    )


def water_filled(sources: DataFrame, budget: float, max_epochs: float) -> DataFrame:
    """Add `target` DOUBLE to sources (size BIGINT, weight BIGINT): shares of budget by weight, at most max_epochs x size.

    The level only rises from round to round, so the clamped sources follow from
    it; two sums a round reach the driver. If all are clamped, all targets are
    their caps.
    """
    cap = F.lit(float(max_epochs)) * F.col("size")
    rest, weight = float(budget), None
    while True:
        above = F.lit(rest) * F.col("weight") > cap * F.lit(weight) if weight is not None else F.lit(False)
        sums = sources.agg(
            F.coalesce(F.sum(F.when(above, cap)), F.lit(0.0)).alias("clamped"),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)).alias("free"),
        ).first()
        state = (float(budget) - sums.clamped, sums.free)
        if state == (rest, weight) or not sums.free:
            rest, weight = state
            break
        rest, weight = state
    if not weight:
        return sources.withColumn("target", cap)
    above = F.lit(rest) * F.col("weight") > cap * F.lit(weight)
    return sources.withColumn("target", F.when(above, cap).otherwise(F.lit(rest) * F.col("weight") / F.lit(weight)))


def _taken(docs: DataFrame, weights: list[int], share: float, max_epochs: float, seed: int, key: str, source: str, text: str, carry: bool) -> DataFrame:
    """(key, source, size, source_size, target, whole, once_more[, row]): what `mix` takes; row is the whole row of docs."""
    order = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))).cast("binary"))
    sized = docs.select(
        F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").alias("source"), word_count(text).alias("size"), order.alias("order"),
        *([F.struct("*").alias("row")] if carry else []),
    )
    sized = sized.withColumn("slice", F.substring("order", 1, _SLICE_DIGITS)).withColumn("named", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    sized = stage_table(sized)
    slices = stage_table(sized.groupBy("named", "source", "slice").agg(F.sum("size").alias("words")))
    sources = ranked_sources(slices.groupBy("named", "source").agg(F.sum("words").alias("size")))
    weight = F.array(*map(F.lit, weights))[(F.col("place") % len(weights)).cast("int")].cast("bigint")
    sources = stage_table(sources.withColumn("weight", weight))
    total = sources.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first().n
    goals = water_filled(sources, share * total, max_epochs).select(
        "named", F.col("size").alias("source_size"), "target",
        F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0).cast("bigint").alias("whole"),
    ).withColumn("quota", F.round("target").cast("bigint") - F.col("whole") * F.col("source_size"))
    ahead = F.sum("words").over(Window.partitionBy("named").orderBy("slice")) - F.col("words")
    plan = slices.withColumn("ahead", ahead).join(goals, "named").drop("source", "words")
    within = Window.partitionBy("named", "slice").orderBy("order", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.col("ahead") + F.sum("size").over(within) - F.col("size")
    once_more = F.least(F.greatest(F.col("quota") - start, F.lit(0)), F.col("size")).cast("bigint")
    placed = sized.join(plan, ["named", "slice"]).withColumn("once_more", once_more)
    return placed.select("key", "source", "size", "source_size", "target", "whole", "once_more", *(["row"] if carry else []))


def mix(
    docs: DataFrame, weights: list[int], share: float = 1.5, max_epochs: float = 2.0, seed: int = 42,
    key: str = "doc_id", source: str = "source", text: str = "text",
) -> DataFrame:
    """(key, source, size, source_size, target, taken): one row per row of docs.

    Sources by code point, null last, get the weights in turn, and share
    `share` x all sizes. A source takes round(target) words: each document
    floor(target / source_size) times, then documents in seeded order once more
    until the rest is used up; the last one gives only the words that are left.
    Null and empty texts have size 0 and take 0. Rows that repeat are separate
    documents; equal keys are ordered by size. An empty table gives no rows;
    other columns are ignored.
    """
    taken = _taken(docs, weights, share, max_epochs, seed, key, source, text, carry=False)
    words = (F.col("whole") * F.col("size") + F.col("once_more")).alias("taken")
    return taken.select(F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", words)


def mixed_documents(
    docs: DataFrame, weights: list[int], share: float = 1.5, max_epochs: float = 2.0, seed: int = 42,
    key: str = "doc_id", source: str = "source", text: str = "text",
) -> DataFrame:
    """The columns of docs, a row for each copy that `mix` takes.

    Whole copies are the row as it is; a copy that is only started has the first
    words of the text, joined by spaces. Documents that the mix leaves out and
    texts without words have no row.
    """
    taken = _taken(docs, weights, share, max_epochs, seed, key, source, text, carry=True)
    more = F.col("once_more")
    copies = F.col("whole") + F.when(more > 0, 1).otherwise(0)
    each = taken.filter(F.col("size") > 0).withColumn("copy", F.explode(F.when(copies > 0, F.sequence(F.lit(1).cast("bigint"), copies))))
    value = F.col(f"row.`{text}`")
    words = F.filter(F.split(F.translate(value, "\t\n\x0b\x0c\r", "     "), " "), lambda w: w != "")
    started = (F.col("copy") > F.col("whole")) & (more < F.col("size"))
    kept = F.when(started, F.array_join(F.slice(words, F.lit(1), more.cast("int")), " ")).otherwise(value)
    return each.select(*[(kept if c == text else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
