"""Corpus statistics of a changing chunk table, kept as signed sums.

Added chunks count up and removed ones down, so a change costs its own chunks and
never the corpus. Sums lie below ``terms/batch=n`` and ``sizes/batch=n``; a
repeated batch replaces itself, and `fold` makes one batch of all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from trawl.operators import bm25


@dataclass
class CorpusStore:
    spark: SparkSession
    path: str

    def apply(self, batch: int, added: DataFrame | None = None, removed: DataFrame | None = None) -> None:
        """Count chunks (chunk_key, text, scope if there are several) that come or go.

        Removed chunks are given with the texts that they were added with.
        """
        terms, sizes = [], []
        for chunks, sign in ((added, 1), (removed, -1)):
            if chunks is None:
                continue
            postings, one = bm25.chunk_terms(chunks), F.lit(sign).cast("bigint")
            terms.append(postings.select("scope", "term", one.alias("df"), (one * F.col("tf")).alias("cf")))
            sizes.append(bm25.with_scope(chunks).select("scope", one.alias("n_chunks")))
        self._write("terms", self._sums(self._all(terms), ["scope", "term"]), batch)
        self._write("sizes", self._sums(self._all(sizes), ["scope"]), batch)

    @staticmethod
    def _all(parts: list[DataFrame]) -> DataFrame:
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    @staticmethod
    def _sums(rows: DataFrame, keys: list[str]) -> DataFrame:
        return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in rows.columns if c not in keys])

    def _write(self, name: str, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")

    def sizes(self) -> DataFrame:
        """(scope, n_chunks) of scopes that hold chunks."""
        rows = self.spark.read.parquet(f"{self.path}/sizes").drop("batch")
        return self._sums(rows, ["scope"]).filter("n_chunks <> 0")

    def frequency(self) -> DataFrame:
        """(scope, term, df, cf) as `bm25.term_document_frequency` of the chunks that are there gives."""
        rows = self.spark.read.parquet(f"{self.path}/terms").drop("batch")
        return self._sums(rows, ["scope", "term"]).filter("df <> 0")

    def stats(self) -> DataFrame:
        """What `bm25.corpus_stats` gives for the chunks that are there."""
        return bm25.stats_of(self.sizes(), self.frequency())

    def fold(self, into: CorpusStore) -> None:
        """Write all batches as batch 0 of another, empty store."""
        into._write("terms", self.frequency(), 0)
        into._write("sizes", self.sizes(), 0)
