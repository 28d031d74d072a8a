"""Keyed tables and session-partitioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Insert or replace by key; with ``order`` the latest change per key wins.

    One aggregation with partial combine, so a key repeated in many changes does
    not gather in one task.
    """
    rest = [c for c in current.columns if c not in keys]
    rank = F.struct(F.col("_new"), F.col(order)) if order else F.struct(F.col("_new"))
    both = current.withColumn("_new", F.lit(0)).unionByName(changes.select(*current.columns).withColumn("_new", F.lit(1)))
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("r")).select(*keys, "r.*")


def remove_doc(chunks: DataFrame, doc_name: str, session_id: str | None = None) -> DataFrame:
    """Chunks without one document (of one session)."""
    hit = F.col("doc_name") == doc_name
    if session_id is not None:
        hit = hit & (F.col("session_id") == session_id)
    return chunks.filter(~hit)


def removed_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc_name, removed): chunk counts that went away."""
    count = lambda df, name: df.groupBy("doc_name").agg(F.count(F.lit(1)).alias(name))
    lost = F.col("before") - F.coalesce("after", F.lit(0))
    return count(before, "before").join(count(after, "after"), "doc_name", "left").select(
        "doc_name", lost.alias("removed")
    ).filter("removed > 0")


def drop_sessions(rows: DataFrame, sessions: DataFrame | None) -> DataFrame:
    """Rows of all but the named sessions; None drops every row."""
    return rows.limit(0) if sessions is None else rows.join(sessions.select("session_id").distinct(), "session_id", "left_anti")


def list_docs(chunks: DataFrame) -> DataFrame:
    return chunks.select("doc_name").distinct().orderBy("doc_name")


def index_size(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count(F.lit(1)).alias("size"))


def vector_dims(vectors: DataFrame) -> tuple[int | None, int | None]:
    row = vectors.agg(F.min(F.size("vec")).alias("lo"), F.max(F.size("vec")).alias("hi")).collect()[0]
    return row.lo, row.hi


def append_vectors(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """Append chunk vectors to the session-partitioned table at ``path``.

    All new vectors must have one length, and the length of a non-empty table;
    an empty or missing table takes the length of the new rows.
    """
    low, high = vector_dims(rows)
    if low != high:
        raise ValueError(f"vectors of different lengths: {low} to {high}")
    try:
        known = spark.read.parquet(path).select(F.size("vec").alias("dim")).limit(1).collect()
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        known = []
    if known and low is not None and known[0].dim != low:
        raise ValueError(f"vector length {low} differs from the table's {known[0].dim}")
    rows.write.mode("append").partitionBy("session_id").parquet(path)


def replace_sessions(rows: DataFrame, path: str) -> None:
    """Overwrite only the session partitions present in ``rows``."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_id").parquet(path)
