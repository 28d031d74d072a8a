"""BM25 over many questions at once.

Term counts come from inside each chunk row, without a shuffle; only document
frequencies and the sums per (question, chunk) move. Scores are sparse: a chunk
that shares no term with a question scores 0 and has no row. The zero still
takes part in the min-max normalisation through the candidate count.

A ``scope`` names a set of candidate chunks. Questions are scored against the
chunks of their own scope, with that scope's statistics.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from trawl.functions import fixed_values as fv
from trawl.functions.scores import rescale01
from trawl.functions.text import terms, tokenize_terms
from trawl.operators.ranking import TERMS_IN_TASKS, known_gains, sparse_scores
from trawl.session import stage_table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ALL = ""  # scope of questions without a document filter


def with_scope(df: DataFrame) -> DataFrame:
    return df if "scope" in df.columns else df.withColumn("scope", F.lit(ALL))


# By code point of Latin-1: 1 for the letters, 2 for the digits of TERM_PATTERN.
_KINDS = np.array([2 if chr(c).isdecimal() else int(chr(c).isalpha()) for c in range(256)], dtype=np.uint8)
# Texts tokenised at a time.
_TEXTS = 512
_PAIR = "array<struct<term: string, tf: bigint>>"


def _latin_kinds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of UTF-8: each byte's kind of character, the bytes in lower case, and where characters beyond Latin-1 start."""
    code, low = data.copy(), data.copy()
    low[(data >= ord("A")) & (data <= ord("Z"))] += 32
    first = np.flatnonzero(data >= 0xC0)
    beyond, first = first[data[first] > 0xC3], first[data[first] <= 0xC3]
    point = ((data[first] & 3) << 6) | (data[first + 1] & 63)
    code[first] = code[first + 1] = point
    low[first[(point >= 0xC0) & (point <= 0xDE) & (point != 0xD7)] + 1] += 32
    return _KINDS[code], low, beyond


def _latin_lists(texts: pa.Array, wanted: pa.Array | None) -> pa.StructArray:
    """Per text its number of terms, its distinct terms with their tf, sorted, and those of them that are wanted."""
    n, lost = len(texts), texts.is_null().to_numpy(zero_copy_only=False)
    _, ends, raw = texts.buffers()
    ends = np.frombuffer(ends, np.int32)[texts.offset : texts.offset + n + 1]
    data, ends = np.frombuffer(raw or b"", np.uint8)[ends[0] : ends[-1]], ends - ends[0]
    kinds, low, beyond = _latin_kinds(data)
    lost[np.searchsorted(ends, beyond, "right") - 1] = True
    kinds[np.repeat(lost, np.diff(ends))] = 0
    edge = np.ones(len(kinds) + 1, dtype=bool)
    np.not_equal(kinds[1:], kinds[:-1], out=edge[1:-1])
    edge[ends] = True
    at = np.flatnonzero(edge)
    term = kinds[at[:-1]] > 0
    first, end = at[:-1][term], at[1:][term]
    row = np.searchsorted(ends, first, "right") - 1
    cuts = np.concatenate([[0], np.cumsum(end - first)]).astype(np.int32)
    terms = pa.StringArray.from_buffers(len(first), pa.py_buffer(cuts), pa.py_buffer(low[kinds > 0])).dictionary_encode()
    order = pc.sort_indices(terms.dictionary).to_numpy()
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    each = max(len(order), 1)
    key, tf = np.unique(row * each + rank[terms.indices.to_numpy()], return_counts=True)
    row_of, entry = key // each, order[key % each]

    def lists(kept) -> pa.ListArray:
        starts = np.searchsorted(row_of[kept], np.arange(n + 1)).astype(np.int32)
        pairs = [terms.dictionary.take(pa.array(entry[kept])), pa.array(tf[kept].astype(np.int64))]
        return pa.ListArray.from_arrays(pa.array(starts), pa.StructArray.from_arrays(pairs, ["term", "tf"]))

    out = {"len": pa.array(np.bincount(row, minlength=n).astype(np.int64)), "found": lists(slice(None))}
    if wanted is not None:
        out["asked"] = lists(pc.is_in(terms.dictionary, wanted).to_numpy(zero_copy_only=False)[entry])
    return pa.StructArray.from_arrays(list(out.values()), list(out), mask=pa.array(lost))


def _latin_terms(wanted: pa.Array | None):
    """A UDF of `_latin_lists`, NULL for texts beyond Latin-1."""

    def tokenize(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            texts = texts.cast(pa.string())
            parts = [_latin_lists(texts.slice(at, _TEXTS), wanted) for at in range(0, len(texts), _TEXTS)]
            yield pa.concat_arrays(parts or [_latin_lists(pa.array([""]), wanted)[:0]])

    return F.arrow_udf(tokenize, f"struct<len: bigint, found: {_PAIR}{f', asked: {_PAIR}' if wanted is not None else ''}>")


def chunk_term_lists(
    chunks: DataFrame, key: str = "chunk_key", text: str = "text", keep: list[str] | None = None, wanted: pa.Array | None = None
) -> DataFrame:
    """(scope, key, len, found, keep): a row per chunk; found lists its distinct terms with their tf, len counts all terms.

    A chunk is one row, so its terms are counted inside the row, texts of Latin-1 in
    Arrow batches, the others by columns: sort the terms, find where runs start, and
    take the distances. Nothing is shuffled. With ``wanted`` terms, asked lists all of
    these that a chunk has, for readers who need no others (where found was made by
    columns it is the same list).
    """
    keep = keep or []
    latin = _latin_terms(wanted)
    whole = F.coalesce(F.col(text), F.lit(""))
    counted = with_scope(chunks).withColumn("_latin", latin(F.when(F.is_valid_utf8(whole), whole)))
    found = counted.select(
        "scope", key, *keep, "_latin", F.when(F.col("_latin").isNull(), F.sort_array(tokenize_terms(F.col(text)))).alias("t")
    )
    # No filter on the token array: the optimizer would copy the tokenizing into it.
    at = lambda i: F.get(F.col("t"), i)
    starts = F.filter(
        F.sequence(F.lit(0), F.greatest(F.size("t") - 1, F.lit(0))), lambda i: at(i).isNotNull() & ((i == 0) | (at(i) != at(i - 1)))
    )
    runs = found.select("scope", key, *keep, "_latin", "t", F.size("t").alias("n"), starts.alias("s"))
    term = lambda i, j: F.struct(
        F.get(F.col("t"), i).alias("term"), (F.coalesce(F.get(F.col("s"), j + 1), F.col("n")) - i).cast("bigint").alias("tf")
    )
    latin = F.col("_latin").isNotNull()
    lists = [F.when(latin, F.col(f"_latin.{c}")).otherwise(F.transform("s", term)).alias(c) for c in ("found", "asked")]
    length = F.when(latin, F.col("_latin.len")).otherwise(F.col("n").cast("bigint")).alias("len")
    return runs.select("scope", key, length, *lists[: 1 if wanted is None else 2], *keep)


def chunk_terms(chunks: DataFrame, key: str = "chunk_key", text: str = "text") -> DataFrame:
    """(scope, key, len, term, tf): a row per chunk and distinct term. Write the result as a table to serve many question sets."""
    return _postings(chunk_term_lists(chunks, key, text), key)


def _postings(lists: DataFrame, key: str) -> DataFrame:
    return lists.select("scope", key, "len", F.inline("found"))


def corpus_size(chunks: DataFrame) -> DataFrame:
    """(scope, n_chunks), chunks without any term included."""
    return with_scope(chunks).groupBy("scope").agg(F.count(F.lit(1)).alias("n_chunks"))


def term_document_frequency(postings: DataFrame) -> DataFrame:
    return postings.groupBy("scope", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def corpus_stats(chunks: DataFrame, frequency: DataFrame) -> DataFrame:
    """One row per scope: chunk count, total terms, mean length, mean raw idf."""
    return stats_of(corpus_size(chunks), frequency)


def stats_of(size: DataFrame, frequency: DataFrame) -> DataFrame:
    """The same from (scope, n_chunks) and (scope, term, df, cf)."""
    totals = frequency.join(size, "scope").groupBy("scope").agg(
        F.first("n_chunks").alias("n_chunks"),
        F.sum("cf").alias("n_terms"),
        F.count(F.lit(1)).alias("n_distinct_terms"),
        F.avg(raw_idf()).alias("mean_idf"),
    )
    return totals.withColumn("avg_len", F.col("n_terms") / F.col("n_chunks"))


def raw_idf(n: str = "n_chunks", df: str = "df"):
    return F.log(F.col(n) - F.col(df) + 0.5) - F.log(F.col(df) + 0.5)


def term_idf(frequency: DataFrame, stats: DataFrame, epsilon: float = fv.BM25_EPSILON) -> DataFrame:
    """idf per term; a negative one becomes ``epsilon`` times the mean idf."""
    idf = raw_idf()
    return (
        frequency.join(stats, "scope")
        .withColumn("idf", F.when(idf < 0, epsilon * F.col("mean_idf")).otherwise(idf))
        .select("scope", "term", "df", "idf", "avg_len")
    )


def question_terms(questions: DataFrame, query_id: str = "query_id", text: str = "query_text") -> DataFrame:
    """(scope, query_id, term, query_count); repeated query terms count again."""
    exploded = with_scope(questions).select("scope", query_id, F.explode(terms(F.col(text))).alias("term"))
    return (
        exploded.groupBy("scope", query_id, F.lower("term").alias("term"))
        .agg(F.count(F.lit(1)).alias("query_count"))
    )


def bm25_scores(
    questions: DataFrame,
    chunks: DataFrame,
    key: str = "chunk_key",
    query_id: str = "query_id",
    k1: float = fv.BM25_K1,
    b: float = fv.BM25_B,
    salts: int = 16,
    postings: DataFrame | None = None,
) -> DataFrame:
    """(scope, query_id, key, bm25_raw) of all pairs sharing at least one term.

    Up to 1024 questions are broadcast, and a task sums the scores of its chunks,
    so term matches are never rows. More take a join on (term, salt): a term in a
    third of all chunks is spread over ``salts`` groups, and the question side is
    repeated per salt. ``postings`` is a stored result of ``chunk_terms`` for these
    chunks; without it the terms are staged here, so that statistics and scores
    read one tokenised copy.
    """
    lists = stage_table(chunk_term_lists(chunks, key)) if postings is None else None
    asked, posted = sparse_sides(questions, chunks, key, query_id, k1, b, postings, lists)
    named = asked.withColumnRenamed(query_id, "query_id"), posted.withColumnRenamed(key, "chunk_key")
    scores = sparse_scores(*named)
    if scores is not None:
        return scores.withColumnsRenamed({"query_id": query_id, "chunk_key": key})
    postings = _postings(lists, key) if postings is None else postings
    frequency = term_document_frequency(postings)
    idf = term_idf(frequency, corpus_stats(chunks, frequency))
    weights = (
        question_terms(questions, query_id).join(idf, ["scope", "term"])
        .withColumn("weight", F.col("query_count") * F.col("idf"))
        .select("scope", query_id, "term", "weight", "avg_len")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    )
    sized = postings.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(salts)).cast("int"))
    fade = k1 * (1 - b + b * F.col("len") / F.col("avg_len"))
    return (
        sized.join(weights, ["scope", "term", "salt"])
        .groupBy("scope", query_id, key)
        .agg(F.sum(F.col("weight") * F.col("tf") * (k1 + 1) / (F.col("tf") + fade)).alias("bm25_raw"))
    )


def sparse_sides(
    questions: DataFrame, chunks: DataFrame, key: str = "chunk_key", query_id: str = "query_id", k1: float = fv.BM25_K1, b: float = fv.BM25_B,
    postings: DataFrame | None = None, lists: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(scope, query_id, terms, weights) and (scope, key, terms, gains) for the blocked scorer.

    A chunk's list holds those of its terms that a question of its scope has, so
    neither list is longer than its text. The score of a pair is the sum of
    weight times gain over the terms both have. ``postings`` or ``lists`` are stored
    results of ``chunk_terms`` or ``chunk_term_lists`` for these chunks. From lists, a
    chunk's terms are looked up row by row and never become rows that are shuffled.
    """
    if postings is None and lists is None:
        lists = stage_table(chunk_term_lists(chunks, key))
    weighted, known = _known_terms(questions, chunks, query_id, postings, lists)
    postings = _postings(lists, key) if postings is None else postings
    gains = None if lists is None else known_gains(lists, known, key, k1, b)
    return weighted, _joined_gains(postings, known, key, k1, b) if gains is None else _merged(gains, key)


def scored_sides(
    questions: DataFrame, lists: DataFrame, key: str = "chunk_key", query_id: str = "query_id", k1: float = fv.BM25_K1, b: float = fv.BM25_B
) -> tuple[DataFrame, DataFrame]:
    """`sparse_sides` of stored ``lists``, whose rows keep their other columns beside terms and gains.

    Rows with a key of their own, usually all, are not shuffled. Several rows of one
    key share the terms of all of them; a NULL key has none.
    """
    weighted, known = _known_terms(questions, lists, query_id, None, lists)
    by = ["scope", key]
    rest = [c for c in lists.columns if c not in (*by, "len", "found", "asked")]
    asked = lists.drop("found").withColumnRenamed("asked", "found") if "asked" in lists.columns else lists
    rows = known_gains(asked, known, key, k1, b, rest)
    if rows is None:
        return weighted, lists.select(*by, *rest).join(_joined_gains(_postings(lists, key), known, key, k1, b), by, "left")
    rows = rows.withColumns({c: F.when(F.col(key).isNotNull(), F.col(c)) for c in ("terms", "gains")})
    repeated = stage_table(lists.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*by))
    if repeated.isEmpty():
        return weighted, rows
    several = rows.join(repeated, by, "left_semi")
    several = several.drop("terms", "gains").join(_merged(several.select(*by, "terms", "gains"), key), by)
    return weighted, rows.join(repeated, by, "left_anti").unionByName(several)


def asked_terms(questions: DataFrame) -> pa.Array | None:
    """The terms of all questions for the tasks that tokenise chunks; None if there are more than TERMS_IN_TASKS."""
    terms = question_terms(questions).select("term").distinct().limit(TERMS_IN_TASKS + 1).toArrow()["term"].combine_chunks()
    return terms.cast(pa.string()) if len(terms) <= TERMS_IN_TASKS else None


def _merged(gains: DataFrame, key: str) -> DataFrame:
    """One list for a key, should it name several rows."""
    return gains.groupBy("scope", key).agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("terms", "gains")])


def _lists_of(rows: DataFrame, owner: str, value, out: str) -> DataFrame:
    """(scope, owner, terms, out) from a row for each term."""
    listed = rows.groupBy("scope", owner).agg(F.collect_list(F.struct("id", value.alias("v"))).alias("l"))
    return listed.select("scope", owner, F.col("l.id").alias("terms"), F.col("l.v").alias(out))


def _joined_gains(postings: DataFrame, known: DataFrame, key: str, k1: float, b: float) -> DataFrame:
    fade = k1 * (1 - b + b * F.col("len") / F.col("avg_len"))
    gain = F.col("tf") * (k1 + 1) / (F.col("tf") + fade)
    return _lists_of(postings.join(known, ["scope", "term"]), key, gain, "gains")


def _known_terms(
    questions: DataFrame, chunks: DataFrame, query_id: str, postings: DataFrame | None, lists: DataFrame | None
) -> tuple[DataFrame, DataFrame]:
    """(scope, query_id, terms, weights) of questions and (scope, term, id, avg_len) of the terms that they and chunks have."""
    postings = lists.select("scope", F.inline("found")) if postings is None else postings
    frequency = stage_table(term_document_frequency(postings))  # read for the statistics and for the terms
    idf = term_idf(frequency, corpus_stats(chunks if lists is None else lists, frequency))
    asked = question_terms(questions, query_id).join(idf, ["scope", "term"])
    asked = stage_table(asked.select("scope", query_id, "term", (F.col("query_count") * F.col("idf")).alias("weight"), "avg_len"))
    known = asked.groupBy("scope", "term").agg(F.first("avg_len").alias("avg_len"))
    known = stage_table(known.withColumn("id", F.monotonically_increasing_id()))
    weighted = asked.join(known.select("scope", "term", "id"), ["scope", "term"])
    return _lists_of(weighted, query_id, F.col("weight"), "weights"), known


def bm25_range(scores: DataFrame, chunks: DataFrame, query_id: str = "query_id") -> DataFrame:
    """Per question the least and greatest score over all candidates, zeros included."""
    seen = scores.groupBy("scope", query_id).agg(
        F.min("bm25_raw").alias("low"), F.max("bm25_raw").alias("high"), F.count(F.lit(1)).alias("n_scored")
    )
    has_zero = F.col("n_scored") < F.col("n_chunks")
    return seen.join(corpus_size(chunks), "scope").select(
        "scope",
        query_id,
        F.when(has_zero, F.least("low", F.lit(0.0))).otherwise(F.col("low")).alias("low"),
        F.when(has_zero, F.greatest("high", F.lit(0.0))).otherwise(F.col("high")).alias("high"),
    )


def bm25_normalise(scores: DataFrame, chunks: DataFrame, query_id: str = "query_id") -> DataFrame:
    """Add bm25_01, the min-max rescaled score per question."""
    limits = bm25_range(scores, chunks, query_id)
    return (
        scores.join(limits, ["scope", query_id])
        .withColumn("bm25_01", rescale01(F.col("bm25_raw"), F.col("low"), F.col("high")))
        .drop("low", "high")
    )
