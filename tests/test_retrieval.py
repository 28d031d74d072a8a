"""Retrieval against plain Python, with both scoring paths and document scopes."""

import math
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trawl.operators import bm25, ranking, retrieve

AS_OF = 1_700_000_000.0
WORDS = "the cat sat on mat dog ran fast red blue 12 7 house tree".split()


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    chunks = []
    for i in range(90):
        words = ["the"] * (i % 3 > 0) + rng.choices(WORDS, k=rng.randint(0, 12))
        v = np.array([rng.gauss(0, 1) for _ in range(6)])
        chunks.append((i, f"d{i % 4}", " ".join(words), (v / np.linalg.norm(v)).tolist(), AS_OF - rng.randint(0, 200) * 86400.0))
    questions = []
    for q in range(7):
        v = np.array([rng.gauss(0, 1) for _ in range(6)])
        questions.append((q, " ".join(rng.choices(WORDS + ["unseen"], k=5)), (v / np.linalg.norm(v)).tolist(), "" if q % 2 else "d01"))
    return chunks, questions


def frames(spark, corpus):
    chunks, questions = corpus
    return (
        spark.createDataFrame(chunks, "chunk_key bigint, doc_name string, text string, vec array<double>, upload_timestamp double"),
        spark.createDataFrame(questions, "query_id bigint, query_text string, vec array<double>, scope string"),
    )


def bm25_by_hand(texts, query):
    docs = [re.findall(r"[a-z]+|\d+", t) for t in texts]
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    df = {}
    for d in docs:
        for t in set(d):
            df[t] = df.get(t, 0) + 1
    idf = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {t: 0.25 * mean if x < 0 else x for t, x in idf.items()}
    return [
        sum(idf.get(t, 0) * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for t in re.findall(r"[a-z]+|\d+", query))
        for d in docs
    ]


def hybrid_by_hand(chunks, question, k, alpha, lam, w):
    _, text, vec, scope = question
    pool = [c for c in chunks if not scope or c[1] in ("d0", "d1")]
    raw = bm25_by_hand([c[2] for c in pool], text)
    lo, hi = min(raw), max(raw)
    scored = []
    for c, r in zip(pool, raw):
        dense = float(np.dot(c[3], vec))
        fused = (1 - alpha) * (dense + 1) / 2 + alpha * ((r - lo) / (hi - lo) if hi - lo > 1e-12 else 0)
        recency = math.exp(-(AS_OF - c[4]) / 86400 / 30)
        scored.append(((1 - w) * fused + w * recency, c, dense))
    top = sorted(scored, key=lambda s: (-round(s[0], 9), s[1][0]))[: 3 * k]
    chosen = []
    while len(chosen) < min(k, len(top)):
        rest = [s for s in top if s not in chosen]
        gain = [round(lam * s[2] - (1 - lam) * max([0.0] + [float(np.dot(s[1][3], c[1][3])) for c in chosen]), 9) for s in rest]
        chosen.append(rest[gain.index(max(gain))])
    return [s[1][0] for s in chosen]


def picks(df):
    out = {}
    for r in df.orderBy("query_id", "pick").collect():
        out.setdefault(r.query_id, []).append(r.chunk_key)
    return out


SCOPES = [("d01", "d0"), ("d01", "d1")]


@pytest.mark.parametrize("blocks", [None, (3, 20, 7)])
def test_hybrid_retrieve(spark, corpus, blocks, monkeypatch):
    """``blocks`` forces the shuffled path with several blocks and slices."""
    if blocks:
        for name, value in zip(("QUESTIONS_PER_BLOCK", "CHUNKS_PER_BLOCK", "ROWS_PER_SLICE"), blocks):
            monkeypatch.setattr(ranking, name, value)
        monkeypatch.setattr(ranking, "MERGE_EVERY", 1)
    chunks, questions = frames(spark, corpus)
    scopes = spark.createDataFrame(SCOPES, "scope string, doc_name string")
    got = picks(retrieve.hybrid_retrieve(questions, chunks, AS_OF, scopes, 4, 0.5, 0.6, 0.3))
    assert got == {q[0]: hybrid_by_hand(corpus[0], q, 4, 0.5, 0.6, 0.3) for q in corpus[1]}


def test_bm25_and_its_range(spark, corpus):
    chunks, questions = frames(spark, corpus)
    questions = questions.drop("scope")
    scores = bm25.bm25_scores(questions, chunks)
    got = {(r.query_id, r.chunk_key): r.bm25_raw for r in scores.collect()}
    limits = {r.query_id: (r.low, r.high) for r in bm25.bm25_range(scores, chunks).collect()}
    for q in corpus[1]:
        want = bm25_by_hand([c[2] for c in corpus[0]], q[1])
        assert [got.get((q[0], c[0]), 0.0) for c in corpus[0]] == pytest.approx(want)
        assert limits[q[0]] == pytest.approx((min(want), max(want)))


def test_negative_scores_reach_the_range(spark):
    """In a tiny corpus the idf floor can be negative, and so can scores."""
    chunks = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "a")], "chunk_key bigint, text string")
    questions = spark.createDataFrame([(1, "a b")], "query_id bigint, query_text string")
    scores = bm25.bm25_scores(questions, chunks)
    want = bm25_by_hand(["a b", "a b", "a"], "a b")
    limit = bm25.bm25_range(scores, chunks).first()
    assert min(want) < 0 and (limit.low, limit.high) == pytest.approx((min(want), max(want)))


def test_mmr_with_full_weight_is_top_k(spark, corpus):
    chunks, questions = frames(spark, corpus)
    top = retrieve._cosine_best(questions.drop("scope"), chunks, 12)
    chosen = picks(retrieve.mmr_select(top.select("query_id", "rank", "chunk_key", "dense_raw", "vec"), 5, 1.0))
    ranked = {}
    for r in top.filter("rank <= 5").orderBy("query_id", "rank").collect():
        ranked.setdefault(r.query_id, []).append(r.chunk_key)
    assert chosen == ranked


def test_vector_search_filters_after_top_k(spark, corpus):
    chunks, questions = frames(spark, corpus)
    questions = questions.drop("scope")
    every = retrieve.vector_search(questions, chunks, 5, 0.5)
    allowed = spark.createDataFrame([("d1",)], "doc_name string")
    some = retrieve.vector_search(questions, chunks, 5, 0.5, allowed)
    key = lambda df: {(r.query_id, r.chunk_key) for r in df.collect()}
    assert key(some) == key(every.filter("doc_name = 'd1'"))


def test_wrong_vector_length(spark, corpus):
    chunks, questions = frames(spark, corpus)
    short = questions.withColumn("vec", F.slice("vec", 1, 3)).drop("scope")
    assert retrieve.vector_search(short, chunks, 5, 0.5).count() == 0
    with pytest.raises(Exception, match="vector length differs"):
        retrieve.dense_scores(short, chunks).collect()


def test_bm25_scores_sum_term_matches_inside_tasks(spark):
    """Equal to the join that more questions take, without a row for each term match."""
    words = ["ape", "bee", "cat", "dog", "eel"]
    chunks = spark.createDataFrame([(i, " ".join(words[j % 5] for j in range(i, 2 * i + 1))) for i in range(12)] + [(3, "ape ape")], "chunk_key bigint, text string")
    questions = spark.createDataFrame([(i, " ".join(words[: i + 1]) + " ape") for i in range(4)], "query_id bigint, query_text string")
    inside = bm25.bm25_scores(questions, chunks)
    plan = inside._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "salt" not in plan
    more = questions.unionByName(spark.range(100, 1200).selectExpr("id AS query_id", "'ape' AS query_text"))
    joined = {(r.query_id, r.chunk_key): r.bm25_raw for r in bm25.bm25_scores(more, chunks).filter("query_id < 4").collect()}
    got = {(r.query_id, r.chunk_key): r.bm25_raw for r in inside.collect()}
    assert got.keys() == joined.keys() and all(abs(got[k] - joined[k]) < 1e-12 for k in got)


def test_term_rows_of_chunks_are_not_shuffled(spark, corpus, monkeypatch):
    """Looked up row by row, a chunk's gains equal those of the join that more terms take, also in scopes and for repeated keys."""
    chunks, questions = frames(spark, corpus)
    pool = retrieve.scope_chunks(chunks.unionByName(chunks.filter("chunk_key < 9")), spark.createDataFrame(SCOPES, "scope string, doc_name string"))
    gains = lambda df: {(r.scope, r.chunk_key): sorted(round(g, 12) for g in r.gains) for r in df.collect()}
    _, looked_up = bm25.sparse_sides(questions, pool)
    plan = looked_up._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan and "Join" not in plan
    got = gains(looked_up)
    monkeypatch.setattr(ranking, "TERMS_IN_TASKS", 2)
    assert got == gains(bm25.sparse_sides(questions, pool)[1])
    assert got == gains(bm25.sparse_sides(questions, pool, postings=bm25.chunk_terms(pool))[1])


def test_terms_counted_in_batches_equal_the_columns(spark):
    """Letters, digits and case of Latin-1 as the columns tell them, other scripts by the columns, wrong bytes and NULL included."""
    texts = ["", " ", "a1b 22B,b\xa0É\u00c7 é,É", "ªµº ß² ×÷ÿ Þþ", "İstanbul iİ", "ΑΣ ας 日本 ab", "e\u0301x", "x_y-z 007 ٣4", "ab cd" * 700, "Ab aB", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "chunk_key bigint, text string")
    rows = rows.unionByName(spark.sql("SELECT 50L AS chunk_key, cast(X'61C328E9' AS string) AS text"))
    split = rows.select("chunk_key", bm25.tokenize_terms(F.col("text")).alias("t")).collect()
    want = {r.chunk_key: (len(r.t), sorted((t, r.t.count(t)) for t in set(r.t))) for r in split}
    lists = bm25.chunk_term_lists(rows, wanted=pa.array(["ab", "é"])).collect()
    assert {r.chunk_key: (r.len, sorted(map(tuple, r.found))) for r in lists} == want and len(want[8][1]) == 3
    for r in lists:
        assert {p.term for p in r.found} >= {p.term for p in r.asked} >= {p.term for p in r.found} & {"ab", "é"}
    assert [[tuple(p) for p in r.asked] for r in lists if r.chunk_key in (2, 9)] == [[("é", 2)], [("ab", 2)]]


def test_rows_of_the_scorer_are_not_shuffled_for_their_terms(spark, corpus, monkeypatch):
    """Gains are put beside a chunk's vector where it lies, and equal those of a join by key, also for repeated and NULL keys."""
    chunks, questions = frames(spark, corpus)
    odd = chunks.unionByName(chunks.filter("chunk_key < 9")).unionByName(chunks.filter("chunk_key < 5").withColumn("chunk_key", F.lit(None).cast("bigint")))
    scopes = spark.createDataFrame(SCOPES, "scope string, doc_name string")
    row = lambda r: (r.scope, r.chunk_key, tuple(r.vec), tuple(sorted(round(g, 12) for g in r.gains or [])))
    for rows, plain in ((chunks, True), (odd, False)):
        pool = bm25.stage_table(retrieve.scope_chunks(rows, scopes).select("scope", "chunk_key", "text", "vec"))
        lists = bm25.stage_table(bm25.chunk_term_lists(pool, keep=["vec"], wanted=bm25.asked_terms(questions)))
        _, ready = bm25.scored_sides(questions, lists)
        if plain:
            plan = ready._jdf.queryExecution().executedPlan().toString()
            assert "MapInArrow" in plan and "Exchange" not in plan and "Join" not in plan
        by = ["scope", "chunk_key"]
        want = sorted(map(row, pool.join(bm25.sparse_sides(questions, pool)[1], by, "left").collect()), key=repr)
        assert sorted(map(row, ready.collect()), key=repr) == want
        monkeypatch.setattr(ranking, "TERMS_IN_TASKS", 2)
        assert sorted(map(row, bm25.scored_sides(questions, lists)[1].collect()), key=repr) == want
        monkeypatch.undo()


def test_scorer_memory_stays_small():
    """The scorer of a task holds small matrices, however many questions and chunks meet."""
    rng = np.random.default_rng(2)

    def rows(n, values, **more):
        lists = pa.ListArray.from_arrays(np.arange(0, 20 * n + 1, 20, dtype=np.int32), pa.array(rng.integers(0, 300, 20 * n)))
        amounts = pa.ListArray.from_arrays(np.arange(0, 20 * n + 1, 20, dtype=np.int32), pa.array(rng.random(20 * n)))
        vec = pa.ListArray.from_arrays(np.arange(0, 8 * n + 1, 8, dtype=np.int32), pa.array(rng.random(8 * n)))
        return pa.table({"scope": [""] * n, "vec": vec, "terms": lists, values: amounts} | more)

    questions = rows(1024, "weights", query_id=np.arange(1024), low=np.zeros(1024), high=np.ones(1024))
    chunks = rows(4096, "gains", chunk_key=np.arange(4096), recency=np.ones(4096))
    tracemalloc.start()
    best = ranking._best_of(questions, [chunks], ranking.Mix(0.5, 0.2, 30))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert best.num_rows == 1024 * 30 and peak < 80e6, peak
