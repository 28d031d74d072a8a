"""Running totals, minima and maxima over a key that may hold most of the rows.

A plain window would sort a hot key in one task. Keys are counted first; those of
at most `HOT_ROWS` rows take one plain window. The rows of the others are cut into
ranges of about equal numbers of rows by key and order column, so a hot key
spreads over many ranges however its order values lie; one window runs inside the
ranges, one over a row per range and key, and the two are added. The result is
the same either way: rows of equal key and order are always in one range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from trawl.session import stage_table

#: A key with more rows is cut into ranges.
HOT_ROWS = 1 << 20


def ranged(df: DataFrame, keys: list[str], order: str, ranges: int | None = None) -> DataFrame:
    """Add ``_range``, which grows with (keys, order); written, so that it stays the same for all readers."""
    by = [*keys, order]
    cut = df.repartitionByRange(ranges, *by) if ranges else df.repartitionByRange(*by)
    return stage_table(cut.withColumn("_range", F.spark_partition_id()))


def _same(left: str, right: str, names: list[str]) -> Column:
    same = F.lit(True)
    for k in names:
        same = same & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return same


def _before(df: DataFrame, keys: list[str], order: str, value: Column, fold, merge, ranges: int | None, hot_rows: int | None, out: str) -> DataFrame:
    """Ranges for all keys if their number is given, else for hot keys only."""
    if ranges:
        return _before_ranged(df, keys, order, value, fold, merge, ranges, out)
    hot = stage_table(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > (hot_rows or HOT_ROWS)).select(*keys))
    if hot.isEmpty():
        return _before_plain(df, keys, order, value, fold, merge, out)
    same = _same("l", "r", keys)
    rest = df.alias("l").join(hot.alias("r"), same, "left_anti")
    crowded = df.alias("l").join(hot.alias("r"), same, "left_semi")
    return _before_plain(rest, keys, order, value, fold, merge, out).unionByName(
        _before_ranged(crowded, keys, order, value, fold, merge, None, out)
    )


def _before_plain(df: DataFrame, keys: list[str], order: str, value: Column, fold, merge, out: str) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("_value", value)
    return rows.select(*df.columns, merge(F.lit(None), fold(F.col("_value")).over(window)).alias(out))


def _before_ranged(df: DataFrame, keys: list[str], order: str, value: Column, fold, merge, ranges: int | None, out: str) -> DataFrame:
    cut = ranged(df.withColumn("_value", value), keys, order, ranges)
    upto = (Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*keys, "_range").orderBy(order).rowsBetween(*upto)
    across = Window.partitionBy(*keys).orderBy("_range").rowsBetween(*upto)
    sums = (
        cut.groupBy(*keys, "_range").agg(fold(F.col("_value")).alias("_range_value"))
        .select(*keys, "_range", fold(F.col("_range_value")).over(across).alias("_base"))
    )
    local = cut.withColumn("_local", fold(F.col("_value")).over(inside))
    return local.alias("l").join(sums.alias("r"), _same("l", "r", ["_range", *keys])).select(
        *[F.col(f"l.{c}") for c in df.columns], merge(F.col("r._base"), F.col("l._local")).alias(out)
    )


def sum_before(df: DataFrame, keys: list[str], order: str, value: Column, out: str, ranges: int | None = None, hot_rows: int | None = None) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the key's rows ordered before this one."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    return _before(df, keys, order, value, F.sum, lambda a, b: zero(a) + zero(b), ranges, hot_rows, out)


def count_before(df: DataFrame, keys: list[str], order: str, out: str, ranges: int | None = None, hot_rows: int | None = None) -> DataFrame:
    return sum_before(df, keys, order, F.lit(1).cast("bigint"), out, ranges, hot_rows)


def min_before(df: DataFrame, keys: list[str], order: str, value: Column, out: str, ranges: int | None = None, hot_rows: int | None = None) -> DataFrame:
    """Add ``out``: the least ``value`` over the key's earlier rows, NULL for the first."""
    return _before(df, keys, order, value, F.min, lambda a, b: F.least(a, b), ranges, hot_rows, out)


def max_before(df: DataFrame, keys: list[str], order: str, value: Column, out: str, ranges: int | None = None, hot_rows: int | None = None) -> DataFrame:
    """Add ``out``: the greatest ``value`` over the key's earlier rows, NULL for the first."""
    return _before(df, keys, order, value, F.max, lambda a, b: F.greatest(a, b), ranges, hot_rows, out)
