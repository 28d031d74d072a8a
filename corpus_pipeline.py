"""The training corpus pipeline: documents through five stages, each a written table."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.catalog.registry import query
from trawl.llm import mixing, packing, quality, simhash, substrings
from trawl.llm.queries import word_vocabulary
from trawl.session import drop_stages, scratch_folder, staged


#: Folders that the stages so far have staged inside.
_LEFT: list[str] = []


def _fresh(stage):
    """A stage that first deletes what earlier stages have staged inside, but for what its input is read from.

    The stages' results are written before the next one starts, so only the
    input can still need such a table. Nothing else that the session has staged
    is touched.
    """

    @functools.wraps(stage)
    def begin(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_stages(spark, _LEFT, needed_by=docs)
        before = staged(spark)
        result = stage(spark, docs, sf_dir)
        _LEFT[:] = [n for n in staged(spark) if n in _LEFT or n not in before]
        return result

    return begin


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier scores at 0.5 or more."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.cotrained_scores(docs, labels).filter("score >= 0.5").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 0.8 of its five-word shingles."""
    return simhash.one_of_each_group(docs, words=5, similarity=0.8)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the strings of 200 bytes that occur more than once; n_chars follows a changed text."""
    left = substrings.without_repeats(docs, length=200, output="text")
    left = left.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text")))
    n_chars = F.when(F.col("n_removed") > 0, F.char_length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", n_chars).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: a row for each whole copy, and one for a started copy."""
    return mixing.mixed_documents(docs, weights=[5, 2, 1], share=1.5, max_epochs=2.0)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 tokens."""
    return packing.pack(docs, word_vocabulary(), size=4096)


STAGES = [
    ("quality classifier", _fresh(keep_good)),
    ("SimHash near-dedup", _fresh(drop_near_duplicates)),
    ("suffix-array dedup", _fresh(cut_repeats)),
    ("mixing sources to target weights", _fresh(mix_sources)),
    ("packing", _fresh(pack_sequences)),
]

#: The stages use trained models, tokens and similarity groups, which SQL cannot express.
ORACLE_SQL = None


@query("pipeline", ORACLE_SQL)
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        folder = scratch_folder(spark)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
