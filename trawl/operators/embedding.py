"""Embedding through a cache keyed by the SHA-1 of the text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, FloatType

from trawl.functions.text import sha1_key
from trawl.functions.vectors import l2_normalize
from trawl.session import stage
from trawl.sources.tables import upsert

EmbedBatch = Callable[[list[str]], list[list[float]]]


def with_key(texts: DataFrame, text: str = "text") -> DataFrame:
    return texts.withColumn("k", sha1_key(F.col(text)))


def cache_lookup(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """Texts with their cached dim and vec, NULL on a miss."""
    return with_key(texts).join(cache.select("k", "dim", "vec"), "k", "left")


def cache_misses(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """(k, text): each uncached text once."""
    once = with_key(texts).groupBy("k").agg(F.first("text").alias("text"))
    return once.join(cache.select("k"), "k", "left_anti")


def cache_upsert(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    return upsert(cache.select("k", "dim", "vec"), fresh, ["k"])


def embed_misses(misses: DataFrame, embed: EmbedBatch, batch: int = 64) -> DataFrame:
    """(k, dim, vec) computed by the supplied batch function, in Arrow batches."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            out: list = []
            for i in range(0, len(texts), batch):
                out.extend(embed(list(texts.iloc[i : i + batch])))
            yield pd.Series(out, dtype="object")

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    vectors = F.pandas_udf(run, ArrayType(FloatType()))
    return misses.select("k", vectors("text").alias("vec")).select("k", F.size("vec").alias("dim"), "vec")


def embed_column(texts: DataFrame, cache: DataFrame, embed: EmbedBatch, batch: int = 64) -> tuple[DataFrame, DataFrame]:
    """Texts with a normalised ``vec``, and the cache with the new raw vectors.

    Model results are staged, so that both outputs use the same single call per
    text.
    """
    fresh = stage(embed_misses(cache_misses(texts, cache), embed, batch))
    grown = cache_upsert(cache, fresh)
    out = with_key(texts).join(grown, "k", "left").withColumn("vec", l2_normalize(F.col("vec"))).drop("k", "dim")
    return out, grown
