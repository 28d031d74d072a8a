"""Answer cache: a table of k, answer, confidence, citations, ts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trawl.functions.text import answer_key
from trawl.sources.tables import upsert


def with_answer_key(questions: DataFrame, docs: str = "docs") -> DataFrame:
    return questions.withColumn("k", answer_key(F.col("query_text"), F.col(docs)))


def cache_hits(keyed: DataFrame, cache: DataFrame) -> DataFrame:
    return keyed.join(cache.select("k", "answer", "confidence", "citations", "ts"), "k")


def cache_misses(keyed: DataFrame, cache: DataFrame) -> DataFrame:
    return keyed.join(cache.select("k"), "k", "left_anti")


def cache_put(cache: DataFrame, answered: DataFrame) -> DataFrame:
    """Insert or replace by key; of several new answers the latest ts stays."""
    return upsert(cache, answered, ["k"], "ts")
