"""Retrieval: BM25, dense, fusion, recency, MMR."""

from __future__ import annotations

from pyspark.sql import functions as F

from trawl.catalog.inputs import (
    AS_OF, CHUNKS_SQL, QUESTIONS_SQL, RANGE_SQL, TEXT_CHUNKS_SQL, TEXT_QUESTIONS_SQL, big, bm25_sql, bm25_stats_sql, chunks, mmr_sql,
    questions, r6, ranked_sql, scored_sql, table, text_chunks, vector_questions,
)
from trawl.catalog.registry import query
from trawl.functions.vectors import cosine01, dot, l2_normalize
from trawl.operators import bm25, retrieve
from trawl.operators.ranking import SCORE_DIGITS
from trawl.session import scratch_folder, stage_table
from trawl.sources.corpus_store import CorpusStore

_TEXT = f"WITH {TEXT_CHUNKS_SQL}, {TEXT_QUESTIONS_SQL}, {bm25_sql('text_chunks')}, {RANGE_SQL}"
_STATS = f"WITH {TEXT_CHUNKS_SQL}, {bm25_stats_sql('text_chunks')} "
_HYBRID = (
    f"WITH RECURSIVE {CHUNKS_SQL}, {QUESTIONS_SQL}, {bm25_sql('chunks')}, {RANGE_SQL}, {scored_sql(0.5, 0.3)}"
)


@query(
    "bm25_corpus_stats",
    _STATS + "SELECT n AS n_chunks, round(avg_len, 6) AS avg_len, (SELECT count(*) FROM dfreq) AS n_distinct_terms, "
    "(SELECT sum(tf)::BIGINT FROM tf) AS n_terms, round(mean_idf, 6) AS mean_idf FROM stat",
)
def _(spark, d):
    pool = text_chunks(spark, d)
    frequency = bm25.term_document_frequency(bm25.chunk_terms(pool))
    s = bm25.corpus_stats(pool, frequency)
    return s.select("n_chunks", r6("avg_len").alias("avg_len"), "n_distinct_terms", "n_terms", r6("mean_idf").alias("mean_idf"))


@query("bm25_idf", _STATS + "SELECT term, df, round(idf, 6) AS idf FROM idf")
def _(spark, d):
    pool = text_chunks(spark, d)
    frequency = stage_table(bm25.term_document_frequency(bm25.chunk_terms(pool)))
    return bm25.term_idf(frequency, bm25.corpus_stats(pool, frequency)).select("term", "df", r6("idf").alias("idf"))


_LEFT_OVER = "pool AS (SELECT * FROM text_chunks WHERE NOT (chunk_key % 5 = 0 AND chunk_key % 3 < 2))"


@query(
    "bm25_maintained_stats",
    f"WITH {TEXT_CHUNKS_SQL}, {_LEFT_OVER}, {bm25_stats_sql('pool')} SELECT n AS n_chunks, round(avg_len, 6) AS avg_len, "
    "(SELECT count(*) FROM dfreq) AS n_distinct_terms, (SELECT sum(tf)::BIGINT FROM tf) AS n_terms, round(mean_idf, 6) AS mean_idf FROM stat",
)
def _(spark, d):
    """Statistics after three batches: two thirds come, the rest comes while some go, more go."""
    pool = text_chunks(spark, d)
    third, gone = F.col("chunk_key") % 3, F.col("chunk_key") % 5 == 0
    store = CorpusStore(spark, scratch_folder(spark))
    store.apply(0, added=pool.filter(third < 2))
    store.apply(1, added=pool.filter(third == 2), removed=pool.filter(gone & (third == 0)))
    store.apply(2, removed=pool.filter(gone & (third == 1)))
    s = store.stats()
    return s.select("n_chunks", r6("avg_len").alias("avg_len"), "n_distinct_terms", "n_terms", r6("mean_idf").alias("mean_idf"))


@query("bm25_scores", _TEXT + "SELECT query_id, chunk_key, round(bm25_raw, 6) AS bm25_raw FROM sparse")
def _(spark, d):
    s = bm25.bm25_scores(questions(spark, d), text_chunks(spark, d))
    return s.select("query_id", "chunk_key", r6("bm25_raw").alias("bm25_raw"))


@query(
    "bm25_normalise",
    _TEXT + "SELECT query_id, chunk_key, round(CASE WHEN high - low < 1e-12 THEN 0 ELSE (bm25_raw - low) / (high - low) END, 6) "
    "AS bm25_01 FROM sparse JOIN lim USING (query_id)",
)
def _(spark, d):
    pool = text_chunks(spark, d)
    s = bm25.bm25_normalise(bm25.bm25_scores(questions(spark, d), pool), pool)
    return s.select("query_id", "chunk_key", r6("bm25_01").alias("bm25_01"))


@query(
    "bm25_top_chunks",
    _TEXT + "SELECT query_id, rank, chunk_key, score FROM (SELECT query_id, chunk_key, round(bm25_raw, 6) AS score, "
    "row_number() OVER (PARTITION BY query_id ORDER BY round(bm25_raw, 9) DESC, chunk_key) AS rank FROM sparse) WHERE rank <= 10",
)
def _(spark, d):
    from pyspark.sql import Window

    s = bm25.bm25_scores(questions(spark, d), text_chunks(spark, d))
    w = Window.partitionBy("query_id").orderBy(F.round("bm25_raw", SCORE_DIGITS).desc(), "chunk_key")
    top = s.withColumn("rank", F.row_number().over(w)).filter("rank <= 10")
    return top.select("query_id", big("rank").alias("rank"), "chunk_key", r6("bm25_raw").alias("score"))


@query(
    "l2_normalize",
    "SELECT vec_id, round(list_inner_product(u, u), 6) AS sq, round(u[1], 6) AS first, round(list_sum(u), 6) AS total FROM ("
    "SELECT vec_id, list_transform(w, lambda x: x / (sqrt(list_inner_product(w, w)) + 1e-12)) AS u FROM ("
    "SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * (vec_id + 2)) AS w FROM embeddings))",
)
def _(spark, d):
    e = table(spark, d, "embeddings")
    raw = F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") + 2))
    u = e.select("vec_id", l2_normalize(raw).alias("u"))
    total = F.aggregate("u", F.lit(0.0), lambda a, x: a + x)
    return u.select(
        "vec_id", r6(dot(F.col("u"), F.col("u"))).alias("sq"), r6(F.get("u", F.lit(0))).alias("first"), r6(total).alias("total")
    )


_DENSE = f"WITH RECURSIVE {CHUNKS_SQL}, {QUESTIONS_SQL}, dense AS (SELECT query_id, chunk_key, c.vec, list_inner_product(q.vec, c.vec) AS dense_raw FROM questions q CROSS JOIN chunks c)"


@query(
    "dense_scores",
    _DENSE + f", {ranked_sql('(dense_raw + 1) / 2', 'dense', 10)} SELECT query_id, rank, chunk_key, round(dense_raw, 6) AS dense_raw, "
    "round((dense_raw + 1) / 2, 6) AS dense_01 FROM cand",
)
def _(spark, d):
    s = retrieve.dense_scores(vector_questions(spark, d), chunks(spark, d), 10)
    return s.select(
        "query_id", big("rank").alias("rank"), "chunk_key", r6("dense_raw").alias("dense_raw"), r6("dense_01").alias("dense_01")
    )


@query(
    "cosine01",
    "SELECT d.doc_id, round((list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) + 1) / 2, 6) AS cosine_01 "
    "FROM documents d JOIN embeddings a ON a.vec_id = d.doc_id JOIN embeddings b ON b.vec_id = d.n_chars",
)
def _(spark, d):
    """Each document's vector against the one its length points to."""
    e = table(spark, d, "embeddings")
    a = e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("a"))
    b = e.select(F.col("vec_id").alias("n_chars"), F.col("embedding").alias("b"))
    both = table(spark, d, "documents").select("doc_id", "n_chars").join(a, "doc_id").join(b, "n_chars")
    return both.select("doc_id", r6(cosine01(dot(F.col("a"), F.col("b")))).alias("cosine_01"))


@query(
    "check_dim",
    "SELECT count(*) AS n_kept, count(DISTINCT len(embedding)) AS n_dims, any_value(len(embedding))::BIGINT AS dim FROM embeddings "
    "WHERE len(embedding) = (SELECT len(embedding) FROM embeddings LIMIT 1)",
)
def _(spark, d):
    e = table(spark, d, "embeddings").select(F.col("embedding").alias("vec"))
    kept = retrieve.keep_dim(retrieve.require_dim(e, 64), retrieve.vector_dim(e))
    return kept.agg(
        F.count(F.lit(1)).alias("n_kept"), F.countDistinct(F.size("vec")).alias("n_dims"), big(F.max(F.size("vec"))).alias("dim")
    )


_ALLOWED = """asked AS (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN '["src1.pdf", "src' || (item_id % 20) || '.pdf"]'
  WHEN item_id % 3 = 1 THEN 'src' || (item_id % 20) || '.pdf, src2.pdf,' ELSE '' END AS selected FROM benchmark),
wanted AS (SELECT item_id, unnest(list_distinct(list_filter(list_transform(string_split(
  regexp_replace(selected, '[\\["\\]]', '', 'g'), ','), lambda s: trim(s)), lambda s: s <> ''))) AS doc_name FROM asked)"""


def _selected(spark, d):
    i = F.col("item_id")
    source = F.concat(F.lit("src"), (i % 20).cast("string"), F.lit(".pdf"))
    selected = (
        F.when(i % 3 == 0, F.concat(F.lit('["src1.pdf", "'), source, F.lit('"]')))
        .when(i % 3 == 1, F.concat(source, F.lit(", src2.pdf,"))).otherwise("")
    )
    return table(spark, d, "benchmark").select("item_id", retrieve.parse_allowed(selected).alias("allowed"))


@query(
    "filter_docs",
    f"WITH {TEXT_CHUNKS_SQL}, {_ALLOWED} SELECT chunk_key, doc_name FROM text_chunks WHERE doc_name IN (SELECT doc_name FROM wanted)",
)
def _(spark, d):
    allowed = _selected(spark, d).select(F.explode("allowed").alias("doc_name"))
    return retrieve.filter_docs(text_chunks(spark, d), allowed).select("chunk_key", "doc_name")


@query(
    "parse_allowed",
    f"WITH {_ALLOWED} SELECT a.item_id, string_agg(doc_name, '|' ORDER BY doc_name) AS allowed FROM asked a LEFT JOIN wanted w USING (item_id) GROUP BY ALL",
)
def _(spark, d):
    return _selected(spark, d).select("item_id", F.array_join("allowed", "|").alias("allowed"))


_PARTS = (
    "round(dense_raw, 6) AS dense_raw, round((dense_raw + 1) / 2, 6) AS dense_01, round(bm25_raw, 6) AS bm25_raw, "
    "round(bm25_01, 6) AS bm25_01, round(fused, 6) AS fused, round(recency, 6) AS recency, round(final, 6) AS hybrid_score"
)


def _parts(df, final="hybrid_score"):
    return [
        r6("dense_raw").alias("dense_raw"), r6(cosine01(F.col("dense_raw"))).alias("dense_01"), r6("bm25_raw").alias("bm25_raw"),
        r6("bm25_01").alias("bm25_01"), r6("fused").alias("fused"), r6("recency").alias("recency"), r6(final).alias("hybrid_score"),
    ]


@query(
    "top_candidates",
    _HYBRID + f", {ranked_sql('final', 'final', 30)} SELECT query_id, rank, chunk_key, round(final, 6) AS hybrid_score FROM cand",
)
def _(spark, d):
    s = retrieve.score_candidates(vector_questions(spark, d), chunks(spark, d), AS_OF)
    return s.select("query_id", big("rank").alias("rank"), "chunk_key", r6("final").alias("hybrid_score"))


@query("score_breakdown", _HYBRID + f", {ranked_sql('final', 'final', 30)} SELECT query_id, chunk_key, {_PARTS} FROM cand")
def _(spark, d):
    s = retrieve.score_candidates(vector_questions(spark, d), chunks(spark, d), AS_OF)
    return s.select("query_id", "chunk_key", *_parts(s, "final"))


_FUSE = (
    f"WITH RECURSIVE {CHUNKS_SQL}, {QUESTIONS_SQL}, {bm25_sql('chunks')}, {RANGE_SQL}, {scored_sql(0.6, 0.0)}, "
    f"{ranked_sql('fused', 'final', 30)}"
)


@query("fuse", _FUSE + "SELECT query_id, rank, chunk_key, round(fused, 6) AS fused FROM cand")
def _(spark, d):
    s = retrieve.score_candidates(vector_questions(spark, d), chunks(spark, d), AS_OF, alpha=0.6, recency_weight=0.0)
    return s.select("query_id", big("rank").alias("rank"), "chunk_key", r6("fused").alias("fused"))


@query(
    "mmr_select",
    _DENSE + f", {ranked_sql('(dense_raw + 1) / 2', 'dense', 24)}, {mmr_sql(8, 0.5)} "
    "SELECT query_id, pick, c.chunk_key, round(c.dense_raw, 6) AS dense_raw FROM picked JOIN cand c USING (query_id, rank)",
)
def _(spark, d):
    top = retrieve._cosine_best(vector_questions(spark, d), chunks(spark, d), 24)
    s = retrieve.mmr_select(top.select("query_id", "rank", "chunk_key", "dense_raw", "vec"), 8, 0.5)
    return s.select("query_id", big("pick").alias("pick"), "chunk_key", r6("dense_raw").alias("dense_raw"))


@query(
    "mmr_select_unfloored",
    _DENSE + f", {ranked_sql('(dense_raw + 1) / 2', 'dense', 24)}, {mmr_sql(8, 0.3, False)} "
    "SELECT query_id, pick, c.chunk_key, round(c.dense_raw, 6) AS dense_raw FROM picked JOIN cand c USING (query_id, rank)",
)
def _(spark, d):
    top = retrieve._cosine_best(vector_questions(spark, d), chunks(spark, d), 24)
    s = retrieve.mmr_select(top.select("query_id", "rank", "chunk_key", "dense_raw", "vec"), 8, 0.3, floor_zero=False)
    return s.select("query_id", big("pick").alias("pick"), "chunk_key", r6("dense_raw").alias("dense_raw"))


@query(
    "vector_search",
    _DENSE + f", {ranked_sql('(dense_raw + 1) / 2', 'dense', 24)}, {mmr_sql(8, 0.5, False)}, {_ALLOWED} "
    "SELECT query_id, pick, c.chunk_key, t.doc_name, t.page, round((c.dense_raw + 1) / 2, 6) AS score "
    "FROM picked JOIN cand c USING (query_id, rank) JOIN text_chunks t ON t.chunk_key = c.chunk_key "
    "WHERE t.doc_name IN (SELECT doc_name FROM wanted)",
)
def _(spark, d):
    allowed = _selected(spark, d).select(F.explode("allowed").alias("doc_name"))
    s = retrieve.vector_search(vector_questions(spark, d), chunks(spark, d), 8, 0.5, allowed)
    return s.select("query_id", big("pick").alias("pick"), "chunk_key", "doc_name", "page", r6("score").alias("score"))


@query(
    "vector_search_per_question",
    _DENSE + f", {ranked_sql('(dense_raw + 1) / 2', 'dense', 24)}, {mmr_sql(8, 0.5, False)}, {_ALLOWED} "
    "SELECT query_id, pick, c.chunk_key, t.doc_name, t.page, round((c.dense_raw + 1) / 2, 6) AS score "
    "FROM picked JOIN cand c USING (query_id, rank) JOIN text_chunks t ON t.chunk_key = c.chunk_key "
    "WHERE query_id NOT IN (SELECT item_id FROM wanted) OR (query_id, t.doc_name) IN (SELECT (item_id, doc_name) FROM wanted)",
)
def _(spark, d):
    allowed = _selected(spark, d).select(F.col("item_id").alias("query_id"), F.explode("allowed").alias("doc_name"))
    s = retrieve.vector_search(vector_questions(spark, d), chunks(spark, d), 8, 0.5, allowed)
    return s.select("query_id", big("pick").alias("pick"), "chunk_key", "doc_name", "page", r6("score").alias("score"))


@query(
    "hybrid_retrieve",
    _HYBRID + f", {ranked_sql('final', 'final', 30)}, {mmr_sql(10, 0.6)} "
    f"SELECT query_id, pick, c.chunk_key, t.doc_name, t.page, {_PARTS} "
    "FROM picked JOIN cand c USING (query_id, rank) JOIN text_chunks t ON t.chunk_key = c.chunk_key",
)
def _(spark, d):
    s = retrieve.hybrid_retrieve(vector_questions(spark, d), chunks(spark, d), AS_OF)
    return s.select("query_id", big("pick").alias("pick"), "chunk_key", "doc_name", "page", *_parts(s))
