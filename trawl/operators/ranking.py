"""Blocked scoring of questions against chunks, keeping the best n per question.

Neither path builds the product of the two tables as rows. A block of chunk
vectors meets the question matrix in one matrix product inside a task, and only
the best n per question leave the task.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

# Task code travels by value, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCORE_DIGITS = 9
# Size bounds: a task holds a few matrices of QUESTIONS_PER_BLOCK x ROWS_PER_SLICE.
QUESTIONS_PER_BLOCK, CHUNKS_PER_BLOCK, ROWS_PER_SLICE = 1024, 16_384, 512
MERGE_EVERY = 4
ROWS_PER_OUTPUT = 1 << 16
# Term matches of a block summed at a time.
PAIRS_AT_ONCE = 1 << 18
# Terms of questions that travel to the tasks; more are joined.
TERMS_IN_TASKS = 1 << 18


@dataclass(frozen=True)
class Mix:
    """How partial scores are combined; ``alpha`` 0 and no boost is plain cosine."""

    alpha: float = 0.0
    recency_weight: float = 0.0
    best_n: int = 30


def _matrix(column, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _best_rows(rounded: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """Positions of the n best scores; equal scores go to the smaller key."""
    if rounded.size > n:
        cut = np.partition(rounded, rounded.size - n)[rounded.size - n]
        pool = np.flatnonzero(rounded >= cut)
    else:
        pool = np.arange(rounded.size)
    return pool[np.lexsort((keys[pool], -rounded[pool]))[:n]]


def _matches(questions: pa.Table, chunks: pa.Table):
    """(positions in questions x chunks, weight times gain) of the terms that both have, a bounded number at a time."""

    def flat(table: pa.Table, values: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lists = table["terms"].combine_chunks()
        counts = np.asarray(lists.value_lengths().fill_null(0))
        rest = table[values].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return np.repeat(np.arange(table.num_rows), counts), lists.flatten().to_numpy(zero_copy_only=False), rest

    owner, term, weight = flat(questions, "weights")
    order = np.argsort(term, kind="stable")
    owner, term, weight = owner[order], term[order], weight[order]
    column, posted, gain = flat(chunks, "gains")
    first, last = np.searchsorted(term, posted, "left"), np.searchsorted(term, posted, "right")
    sizes = last - first
    steps = np.concatenate([[0], np.flatnonzero(np.diff(np.cumsum(sizes) // PAIRS_AT_ONCE)) + 1, [len(posted)]])
    for a, b in zip(steps[:-1], steps[1:]):
        at = np.repeat(np.arange(a, b), sizes[a:b])
        own = np.arange(len(at)) - np.repeat(np.cumsum(sizes[a:b]) - sizes[a:b], sizes[a:b]) + first[at]
        yield owner[own] * chunks.num_rows + column[at], weight[own] * gain[at]


def _raw_scores(questions: pa.Table, chunks: pa.Table) -> np.ndarray:
    """Sparse scores of a block: for each question and chunk the sum of weight times gain over the terms both have."""
    raw = np.zeros(questions.num_rows * chunks.num_rows)
    if "terms" in chunks.column_names and "terms" in questions.column_names:
        for at, value in _matches(questions, chunks):
            raw += np.bincount(at, value, len(raw))
    return raw.reshape(questions.num_rows, chunks.num_rows)


def _score_block(questions: pa.Table, chunks: pa.Table, mix: Mix) -> pa.Table | None:
    """Best n rows per question of one block of chunks sharing one scope."""
    if questions.num_rows == 0 or chunks.num_rows == 0:
        return None
    dim = len(questions["vec"][0])
    keys = chunks["chunk_key"].to_numpy(zero_copy_only=False)
    vectors = _matrix(chunks["vec"], dim)
    dense = _matrix(questions["vec"], dim) @ vectors.T
    raw = _raw_scores(questions, chunks)
    low = questions["low"].to_numpy(zero_copy_only=False)[:, None]
    span = questions["high"].to_numpy(zero_copy_only=False)[:, None] - low
    flat = span < 1e-12
    bm25 = np.where(flat, 0.0, (raw - low) / np.where(flat, 1.0, span))
    fused = (1.0 - mix.alpha) * (dense + 1.0) / 2.0 + mix.alpha * bm25
    recency = chunks["recency"].to_numpy(zero_copy_only=False)[None, :]
    final = (1.0 - mix.recency_weight) * fused + mix.recency_weight * recency if mix.recency_weight > 0 else fused
    rounded = np.round(final, SCORE_DIGITS)
    picked = [_best_rows(row, keys, mix.best_n) for row in rounded]
    q = np.repeat(np.arange(len(picked)), [len(p) for p in picked])
    c = np.concatenate(picked)
    take = pa.array(c)
    return pa.table(
        {
            "scope": questions["scope"].take(pa.array(q)),
            "query_id": questions["query_id"].take(pa.array(q)),
            "chunk_key": chunks["chunk_key"].take(take),
            "dense_raw": dense[q, c],
            "bm25_raw": raw[q, c],
            "bm25_01": bm25[q, c],
            "fused": fused[q, c],
            "recency": chunks["recency"].take(take),
            "final": final[q, c],
            "vec": chunks["vec"].take(take),
        }
    )


def _keep_best(found: list[pa.Table], n: int) -> pa.Table:
    """Best n rows per question of several partial results."""
    table = pa.concat_tables(found)
    order = pa.array(-np.round(table["final"].to_numpy(zero_copy_only=False), SCORE_DIGITS))
    table = table.append_column("order", order).sort_by(
        [("query_id", "ascending"), ("order", "ascending"), ("chunk_key", "ascending")]
    )
    q = table["query_id"].to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
    place = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
    return table.filter(pa.array(place < n)).drop_columns(["order"])


def _meetings(questions: pa.Table, blocks):
    """(questions, chunks) of one scope, slice by slice over an iterator of chunk blocks."""
    asked = questions["scope"].to_numpy(zero_copy_only=False)
    own = {scope: questions.filter(pa.array(asked == scope)) for scope in np.unique(asked)}
    for block in blocks:
        for at in range(0, block.num_rows, ROWS_PER_SLICE):
            part = block.slice(at, ROWS_PER_SLICE)
            scopes = part["scope"].to_numpy(zero_copy_only=False)
            for scope in np.unique(scopes):
                if scope in own:
                    yield own[scope], part.filter(pa.array(scopes == scope))


def _best_of(questions: pa.Table, blocks, mix: Mix) -> pa.Table | None:
    """Best rows per question over an iterator of chunk blocks."""
    found: list[pa.Table] = []
    for asked, part in _meetings(questions, blocks):
        found.append(_score_block(asked, part, mix))
        if len(found) > MERGE_EVERY:
            found = [_keep_best(found, mix.best_n)]
    return _keep_best(found, mix.best_n) if found else None


def _range_of(questions: pa.Table, blocks) -> pa.Table | None:
    """Least and greatest sparse score per question over an iterator of chunk blocks."""
    low: dict[int, np.ndarray] = {}
    scopes: dict[int, pa.Table] = {}
    for asked, part in _meetings(questions, blocks):
        raw = _raw_scores(asked, part)
        edge = np.stack([raw.min(axis=1), -raw.max(axis=1)])
        low[id(asked)] = np.minimum(low[id(asked)], edge) if id(asked) in low else edge
        scopes[id(asked)] = asked
    tables = [t.select(["scope", "query_id"]).append_column("low", pa.array(low[i][0])).append_column("high", pa.array(-low[i][1])) for i, t in scopes.items()]
    return pa.concat_tables(tables) if tables else None


def _output_schema(questions: DataFrame, chunks: DataFrame) -> str:
    q, k = questions.schema["query_id"].dataType.simpleString(), chunks.schema["chunk_key"].dataType.simpleString()
    v = chunks.schema["vec"].dataType.simpleString()
    return (
        f"scope string, query_id {q}, chunk_key {k}, dense_raw double, bm25_raw double, bm25_01 double, "
        f"fused double, recency double, final double, vec {v}"
    )


def best_candidates(questions: DataFrame, chunks: DataFrame, mix: Mix) -> DataFrame:
    """Ranked best ``mix.best_n`` chunks per question, exact.

    ``questions``: scope, query_id, vec, low, high, and for sparse scores terms
    and weights. ``chunks``: scope, chunk_key, vec, recency, and for sparse
    scores terms and gains.
    """
    questions = questions.select(*[c for c in ("scope", "query_id", "vec", "low", "high", "terms", "weights") if c in questions.columns])
    chunks = chunks.select(*[c for c in ("scope", "chunk_key", "vec", "recency", "terms", "gains") if c in chunks.columns])
    scored = _met(questions, chunks, lambda q, blocks: _best_of(q, blocks, mix), _output_schema(questions, chunks))
    place = Window.partitionBy("query_id").orderBy(F.round("final", SCORE_DIGITS).desc(), "chunk_key")
    return scored.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= mix.best_n)


def sparse_ranges(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(scope, query_id, low, high): range of the sparse scores of a question over all chunks of its scope, zeros included."""
    kind = questions.schema["query_id"].dataType.simpleString()
    asked, posted = questions.select("scope", "query_id", "terms", "weights"), chunks.select("scope", "chunk_key", "terms", "gains")
    parts = _met(asked, posted, _range_of, f"scope string, query_id {kind}, low double, high double")
    return parts.groupBy("scope", "query_id").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def _met(questions: DataFrame, chunks: DataFrame, fold, schema: str) -> DataFrame:
    """fold(questions, chunk blocks) in every task.

    Up to QUESTIONS_PER_BLOCK questions travel to the tasks as a broadcast and
    the chunk table is scanned in place. More are cut, with the chunks, into
    blocks of bounded size that meet in a shuffle. Results are the same.
    """
    spark = chunks.sparkSession
    small = questions.limit(QUESTIONS_PER_BLOCK + 1).toArrow()
    if small.num_rows > QUESTIONS_PER_BLOCK:
        return _shuffled_blocks(questions, chunks, fold, schema)
    shared = spark.sparkContext.broadcast(small)

    def scan(batches):
        found = fold(shared.value, (pa.Table.from_batches([b]) for b in batches))
        if found is not None:
            yield from found.to_batches()

    return chunks.mapInArrow(scan, schema)


def sparse_scores(questions: DataFrame, chunks: DataFrame) -> DataFrame | None:
    """(scope, query_id, chunk_key, bm25_raw) of all pairs that share a term, summed in tasks that scan the chunks.

    None if there are more than QUESTIONS_PER_BLOCK questions.
    """
    asked = questions.select("scope", "query_id", "terms", "weights")
    small = asked.limit(QUESTIONS_PER_BLOCK + 1).toArrow()
    if small.num_rows > QUESTIONS_PER_BLOCK:
        return None
    shared = chunks.sparkSession.sparkContext.broadcast(small)

    def scan(batches):
        for q, c in _meetings(shared.value, (pa.Table.from_batches([b]) for b in batches)):
            raw, seen = np.zeros(q.num_rows * c.num_rows), np.zeros(q.num_rows * c.num_rows, dtype=bool)
            for at, value in _matches(q, c):
                raw += np.bincount(at, value, len(raw))
                seen[at] = True
            found = np.flatnonzero(seen)
            for a in range(0, len(found), ROWS_PER_OUTPUT):
                at = found[a : a + ROWS_PER_OUTPUT]
                row, column = at // c.num_rows, at % c.num_rows
                out = {"scope": q["scope"].take(row), "query_id": q["query_id"].take(row), "chunk_key": c["chunk_key"].take(column)}
                yield from pa.table(out | {"bm25_raw": pa.array(raw[at])}).to_batches()

    kind = lambda df, c: df.schema[c].dataType.simpleString()
    schema = f"scope string, query_id {kind(questions, 'query_id')}, chunk_key {kind(chunks, 'chunk_key')}, bm25_raw double"
    return chunks.select("scope", "chunk_key", "terms", "gains").mapInArrow(scan, schema)


def _found_gains(part: pa.Table, terms: pa.Array, ids: np.ndarray, avg_len: float, k1: float, b: float, every: bool) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """(rows that have a known term, or every row; the ids of their known terms; their gains)."""
    found = part["found"].combine_chunks()
    entries = found.flatten()
    at = pc.index_in(entries.field("term"), value_set=terms)
    hit = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
    row = np.repeat(np.arange(part.num_rows), np.asarray(found.value_lengths().fill_null(0)))[hit]
    tf = entries.field("tf").to_numpy(zero_copy_only=False)[hit].astype(np.float64)
    fade = k1 * (1 - b + b * part["len"].to_numpy(zero_copy_only=False)[row] / avg_len)
    sizes = np.bincount(row, minlength=part.num_rows)
    rows = np.arange(part.num_rows) if every else np.flatnonzero(sizes)
    ends = pa.array(np.concatenate([[0], np.cumsum(sizes[rows])]).astype(np.int32))
    known = ids[at.take(pa.array(hit)).to_numpy(zero_copy_only=False)]
    return rows, pa.ListArray.from_arrays(ends, pa.array(known)), pa.ListArray.from_arrays(ends, pa.array(tf * (k1 + 1) / (tf + fade)))


def known_gains(lists: DataFrame, known: DataFrame, key: str, k1: float, b: float, keep: list[str] | None = None) -> DataFrame | None:
    """(scope, key, terms, gains) of each row of ``lists`` that has a term of ``known(scope, term, id, avg_len)``; no shuffle.

    With ``keep`` every row comes, with these columns; terms are NULL in a scope without known ones. None if more than TERMS_IN_TASKS terms are known.
    """
    small = known.select("scope", "term", "id", "avg_len").limit(TERMS_IN_TASKS + 1).toArrow()
    if small.num_rows > TERMS_IN_TASKS:
        return None
    shared = lists.sparkSession.sparkContext.broadcast(small)

    def scan(batches):
        table, own = shared.value, {}
        for scope in pc.unique(table["scope"]):
            t = table.filter(pc.equal(table["scope"], scope))
            own[scope.as_py()] = t["term"].combine_chunks(), t["id"].to_numpy(), t["avg_len"][0].as_py()
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_PER_SLICE):
                part = pa.Table.from_batches([batch.slice(start, ROWS_PER_SLICE)])
                for scope in pc.unique(part["scope"]):
                    rows = part.filter(pc.is_null(part["scope"]) if scope.as_py() is None else pc.equal(part["scope"], scope))
                    if scope.as_py() in own:
                        at, terms, gains = _found_gains(rows, *own[scope.as_py()], k1, b, keep is not None)
                    elif keep is not None:
                        at, terms, gains = np.arange(rows.num_rows), *(pa.nulls(rows.num_rows, pa.list_(t)) for t in (pa.int64(), pa.float64()))
                    else:
                        continue
                    out = {c: rows[c].take(at) for c in ("scope", key)} | {"terms": terms, "gains": gains}
                    yield from pa.table(out | {c: rows[c].take(at) for c in keep or []}).combine_chunks().to_batches()

    kind = lambda c: f"{c} {lists.schema[c].dataType.simpleString()}"
    wanted = lists.select("scope", key, "len", "found", *(keep or []))
    schema = ", ".join(["scope string", kind(key), "terms array<bigint>", "gains array<double>", *map(kind, keep or [])])
    return wanted.mapInArrow(scan, schema)


def _shuffled_blocks(questions: DataFrame, chunks: DataFrame, fold, schema: str) -> DataFrame:
    n_q = -(-questions.count() // QUESTIONS_PER_BLOCK)
    n_c = max(-(-chunks.count() // CHUNKS_PER_BLOCK), 1)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    left = questions.withColumn("qb", block("query_id", n_q)).withColumn("cb", every(n_c))
    right = chunks.withColumn("cb", block("chunk_key", n_c)).withColumn("qb", every(n_q))
    empty = to_arrow_schema(chunks.sparkSession.createDataFrame([], schema).schema).empty_table()

    def meet(q: pa.Table, c: pa.Table) -> pa.Table:
        found = fold(q, [c]) if q.num_rows and c.num_rows else None
        return empty if found is None else found

    return left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(meet, schema)
