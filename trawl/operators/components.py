"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.session import stage_table


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One contraction. Large: neighbours above a node hang onto its smallest
    neighbour. Small: a node and its neighbours below it hang onto the smallest."""
    near = _both_ways(links) if large else links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.min("b").alias("m"))
    hung = near.join(least, "a").withColumn("m", F.least("a", "m"))
    if large:
        moved = hung.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return moved.filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): every node of `links` (a, b) with the smallest node it reaches.

    Links may repeat and run either way; self links and links with a null end
    are ignored. The rounds number about the logarithm of the longest chain.
    Each round's links are a written table in the shared folder, so lost
    executors cost a re-read; the driver sees two numbers a round.
    """
    now = stage_table(links.select("a", "b").filter("a <> b").distinct())
    state = None
    while True:
        size = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if size.n == 0 or (size.n, size.s) == state:
            break
        state = (size.n, size.s)
        now = stage_table(_star(stage_table(_star(now, large=True)), large=False))
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
