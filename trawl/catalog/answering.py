"""Rerank, gates, context, prompt, confidence, citations, sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from trawl.catalog.inputs import AS_OF, big, chunks, mmr_sql, r6, ranked_sql, table, vector_questions
from trawl.catalog.registry import query
from trawl.catalog.retrieval import _HYBRID
from trawl.catalog.scalars import BONUS_SQL, SUMMARY_SQL, TYPE_SQL
from trawl.functions import fixed_values as fv
from trawl.operators import citations as ct, passages as ps, retrieve

# Retrieved passages. Scores are scaled by question so that every gate has work,
# every third question asks for a summary, and each fifth passage comes twice.
_SCALE = "(query_id % 5) * 0.2::DOUBLE"
_PASSAGES = _HYBRID + f""", {ranked_sql('final', 'final', 30)}, {mmr_sql(10, 0.6)},
retrieved AS (
  SELECT p.query_id, p.pick, t.doc_name, t.page, t.chunk_id, t.text, c.final * {_SCALE.replace('query_id', 'p.query_id')} AS hybrid_score,
    CASE WHEN p.query_id % 3 = 0 THEN 'Summary: ' || q.query_text ELSE q.query_text END AS query_text,
    c.dense_raw * 4 - 1 AS model_score, c.bm25_01 * {_SCALE.replace('query_id', 'p.query_id')} AS bm25_01
  FROM picked p JOIN cand c USING (query_id, rank) JOIN text_chunks t ON t.chunk_key = c.chunk_key JOIN questions q ON q.query_id = p.query_id),
passages AS (
  SELECT query_id, pick * 2 AS pick, * EXCLUDE (query_id, pick) FROM retrieved
  UNION ALL SELECT query_id, pick * 2 + 1, * EXCLUDE (query_id, pick) FROM retrieved WHERE pick % 5 = 0),
probs AS (SELECT *, CASE WHEN hybrid_score > 0 THEN hybrid_score ELSE 0 END AS prob, {SUMMARY_SQL.format('query_text')} AS is_summary,
  row_number() OVER (PARTITION BY query_id, doc_name, page, chunk_id ORDER BY pick) AS copy,
  row_number() OVER (PARTITION BY query_id ORDER BY pick) AS place0 FROM passages),
counted AS (SELECT *, count(*) FILTER (copy = 1 AND prob >= 0.3) OVER (PARTITION BY query_id) AS n_good,
  row_number() OVER (PARTITION BY query_id ORDER BY copy = 1 DESC, prob DESC, pick) AS best FROM probs),
gated AS (SELECT *, prob AS relevance, CASE WHEN copy = 1 AND prob >= 0.3 THEN 'context'
  WHEN n_good = 0 AND is_summary AND place0 <= 12 THEN 'summary'
  WHEN n_good = 0 AND NOT is_summary AND best = 1 AND prob >= 0.2 THEN 'direct' END AS gate FROM counted),
kept AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(relevance, 9) DESC, pick) AS place FROM gated WHERE gate IS NOT NULL),
context AS (SELECT * FROM kept WHERE place <= CASE WHEN is_summary THEN 12 ELSE 6 END)
"""


def retrieved(spark, d):
    s = retrieve.hybrid_retrieve(vector_questions(spark, d), chunks(spark, d), AS_OF)
    scale = (F.col("query_id") % 5) * 0.2
    asked = vector_questions(spark, d).select(
        "query_id",
        F.when(F.col("query_id") % 3 == 0, F.concat(F.lit("Summary: "), "query_text")).otherwise(F.col("query_text")).alias("query_text"),
    )
    return s.join(asked, "query_id").select(
        "query_id", "pick", "doc_name", "page", "chunk_id", "text", (F.col("hybrid_score") * scale).alias("hybrid_score"), "query_text",
        (F.col("dense_raw") * 4 - 1).alias("model_score"), (F.col("bm25_01") * scale).alias("bm25_01"),
    )


def passages(spark, d):
    s = retrieved(spark, d)
    copies = F.when(F.col("pick") % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return s.withColumn("copy", F.explode(copies)).withColumn("pick", F.col("pick") * 2 + F.col("copy")).drop("copy")


def context(spark, d):
    return ps.context_topk(ps.gate_passages(passages(spark, d)))


_ID = ["query_id", "doc_name", "page"]


@query(
    "rerank_topk",
    _PASSAGES + f", boosted AS (SELECT *, model_score + {BONUS_SQL} AS score, {BONUS_SQL} AS bonus FROM retrieved) "
    "SELECT query_id, doc_name, page, pick, round(score, 6) AS score, round(1 / (1 + exp(-score)), 6) AS relevance, round(bonus, 6) AS logic_bonus "
    "FROM (SELECT * EXCLUDE pick, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, pick) AS pick FROM boosted) "
    f"WHERE pick <= CASE WHEN {SUMMARY_SQL.format('query_text')} THEN 10 ELSE 6 END",
)
def _(spark, d):
    k = F.least(ps.context_size(F.col("query_text")), F.lit(fv.TOP_K))
    s = ps.rerank_topk(retrieved(spark, d), k, "model_score")
    return s.select(*_ID, big("pick").alias("pick"), *[r6(c).alias(c) for c in ("score", "relevance", "logic_bonus")])


@query("rerank_without_model", _PASSAGES + "SELECT query_id, doc_name, page, pick FROM retrieved WHERE pick <= 6")
def _(spark, d):
    return ps.rerank_topk(retrieved(spark, d), 6).select(*_ID, big("pick").alias("pick"))


@query("dedupe_passages", _PASSAGES + "SELECT query_id, doc_name, page, pick FROM probs WHERE copy = 1")
def _(spark, d):
    return ps.dedupe_passages(passages(spark, d)).select(*_ID, big("pick").alias("pick"))


def _gate(name):
    @query(f"gate_{name}", _PASSAGES + f"SELECT query_id, doc_name, page, pick, round(relevance, 6) AS relevance FROM gated WHERE gate = '{name}'")
    def _(spark, d):
        s = getattr(ps, f"gate_{name}")(passages(spark, d))
        return s.select(*_ID, big("pick").alias("pick"), r6("relevance").alias("relevance"))


for _name in ("context", "summary", "direct"):
    _gate(_name)


@query(
    "no_answer",
    _PASSAGES + f"SELECT query_id, '{fv.MSG_NO_ANSWER}' AS answer, 0.0::DOUBLE AS confidence FROM questions WHERE query_id NOT IN (SELECT query_id FROM kept)",
)
def _(spark, d):
    s = ps.no_answer(vector_questions(spark, d), ps.gate_passages(passages(spark, d)))
    return s.select("query_id", "answer", "confidence")


@query("context_topk", _PASSAGES + "SELECT query_id, doc_name, page, pick, place, round(relevance, 6) AS relevance FROM context")
def _(spark, d):
    return context(spark, d).select(*_ID, big("pick").alias("pick"), big("place").alias("place"), r6("relevance").alias("relevance"))


_CONTEXT = _PASSAGES + """, blocks AS (SELECT query_id, string_agg('[' || place || '] ' || doc_name || ':' || page || ' (độ phù hợp ≈ ' ||
  printf('%.2f', relevance) || ')' || chr(10) || CASE WHEN len(body) > 1200 THEN left(body, 1200) || '…' ELSE body END, chr(10) || chr(10) ORDER BY place) AS context
  FROM (SELECT *, regexp_replace(replace(text, chr(10), ' '), '^\\s+|\\s+$', '', 'g') AS body FROM context) GROUP BY query_id)
"""


@query("build_context", _CONTEXT + "SELECT query_id, context FROM blocks")
def _(spark, d):
    return ps.build_context(context(spark, d))


def _prompt_sql():
    q = "asked.query_text"
    guide = f"CASE WHEN {SUMMARY_SQL.format(q)} THEN '{fv.SUMMARY_GUIDE}' ELSE CASE {TYPE_SQL.replace('{}', q)} " + " ".join(
        f"WHEN '{k}' THEN '{g}'" for k, g in fv.REASONING_GUIDES.items()
    ) + " END END"
    layout = f"CASE WHEN {SUMMARY_SQL.format(q)} THEN '{fv.SUMMARY_LAYOUT}' ELSE '{fv.ANSWER_LAYOUT}' END"
    system = fv.SYSTEM_PROMPT.replace("'", "''")
    return _CONTEXT + f""", asked AS (SELECT DISTINCT query_id, query_text FROM passages)
SELECT query_id, {TYPE_SQL.replace('{}', q)} AS question_type, CASE WHEN {SUMMARY_SQL.format(q)} THEN 2048 ELSE 1024 END AS output_budget,
  '{system}' || chr(10) || chr(10) || '{fv.SECTION_CONTEXT}' || chr(10) || context || chr(10) || chr(10) || '{fv.SECTION_QUESTION}' || chr(10) ||
  query_text || chr(10) || chr(10) || '{fv.SECTION_GUIDE}' || chr(10) || {guide} || chr(10) || chr(10) || '{fv.SECTION_LAYOUT}' || chr(10) ||
  {layout} || chr(10) || '{fv.CITATION_NOTE}' AS prompt FROM asked JOIN blocks USING (query_id)"""


@query("build_prompt", _prompt_sql())
def _(spark, d):
    kept = context(spark, d)
    asked = kept.select("query_id", "query_text").distinct()
    return ps.build_prompt(asked, ps.build_context(kept)).select("query_id", "question_type", "output_budget", "prompt")


_CONF = """, best AS (SELECT query_id, list(greatest(0, least(1, greatest(relevance, hybrid_score, bm25_01))) ORDER BY
  greatest(0, least(1, greatest(relevance, hybrid_score, bm25_01))) DESC) AS s FROM context GROUP BY query_id),
parts AS (SELECT query_id, s[1] AS p, CASE WHEN len(s) > 2 THEN (s[2] + s[3]) / 2 WHEN len(s) = 2 THEN s[2] ELSE s[1] END AS u,
  len(list_filter(s, lambda x: x >= 0.6)) / len(s) AS r FROM best)
"""


@query(
    "answer_confidence",
    _PASSAGES + _CONF + "SELECT query_id, round(least(0.99, greatest(0.9 * p, 0.6 * p + 0.25 * u + 0.1 * r + 0.05 * (1 - least(1, abs(p - u))), "
    "CASE WHEN p >= 0.85 THEN 0.92 WHEN p >= 0.75 THEN 0.84 WHEN p >= 0.65 THEN 0.76 ELSE 0 END)), 6) AS confidence FROM parts",
)
def _(spark, d):
    s = ps.answer_confidence(context(spark, d))
    return s.select("query_id", r6("confidence").alias("confidence"))


# Answers made from documents: ranges, reversed ranges, lists and blank pages.
_ANSWERS = """answers AS (SELECT doc_id AS query_id, text || ' [' || source || '.pdf:' || doc_id % 50 || '-' || (doc_id % 50 + 2) || ', 7] and [' ||
  source || '.pdf: 9–4 , x' || '] [other.PDF:3] [src1.pdf : ,] [ src2.pdf:' || doc_id % 9 || ']' AS answer FROM documents)"""


def answers(spark, d):
    i = F.col("doc_id")
    s = lambda c: c.cast("string")
    answer = F.concat(
        "text", F.lit(" ["), "source", F.lit(".pdf:"), s(i % 50), F.lit("-"), s(i % 50 + 2), F.lit(", 7] and ["),
        "source", F.lit(".pdf: 9–4 , x] [other.PDF:3] [src1.pdf : ,] [ src2.pdf:"), s(i % 9), F.lit("]"),
    )
    return table(spark, d, "documents").select(i.alias("query_id"), answer.alias("answer"))


def _citations_sql(ends_only: bool) -> str:
    run = "[lo, hi]" if ends_only else "CASE WHEN lo::BIGINT <= hi::BIGINT THEN list_transform(range(lo::BIGINT, hi::BIGINT + 1), lambda x: x::VARCHAR) ELSE [lo, hi] END"
    return f"""WITH {_ANSWERS}, found AS (SELECT query_id, unnest(regexp_extract_all(answer, '{fv.CITATION_PATTERN}', 1)) AS doc,
  unnest(regexp_extract_all(answer, '{fv.CITATION_PATTERN}', 2)) AS pages FROM answers),
segs AS (SELECT query_id, trim(doc) AS doc_name, unnest(CASE WHEN len(p) = 0 THEN [NULL] ELSE p END) AS seg FROM (
  SELECT *, list_filter(list_transform(string_split(pages, ','), lambda x: trim(x)), lambda x: x <> '') AS p FROM found)),
ranged AS (SELECT *, nullif(regexp_extract(seg, '{fv.PAGE_RANGE_PATTERN}', 1), '') AS lo, nullif(regexp_extract(seg, '{fv.PAGE_RANGE_PATTERN}', 2), '') AS hi FROM segs),
cited AS (SELECT DISTINCT query_id, doc_name, unnest(CASE WHEN lo IS NULL THEN [seg] ELSE {run} END) AS page FROM ranged WHERE doc_name <> '')
"""


@query("extract_citations", _citations_sql(False) + "SELECT query_id, doc_name, page FROM cited")
def _(spark, d):
    return ct.extract_citations(answers(spark, d))


@query("extract_citations_ends", _citations_sql(True) + "SELECT query_id, doc_name, page FROM cited")
def _(spark, d):
    return ct.extract_citations(answers(spark, d), ends_only=True)


# Passages to match: each document answers for itself, as page doc_id % 60 of its file.
_DOC_PASSAGES = """docs AS (SELECT doc_id AS query_id, 1::BIGINT AS place, source || '.pdf' AS doc_name, doc_id % 60 AS page, text,
  coalesce(quality, 1) / 2 + 0.25 AS relevance, doc_id % 7 / 7 AS hybrid_score FROM documents LEFT JOIN labels USING (doc_id)),
matched AS (SELECT d.* FROM docs d WHERE EXISTS (SELECT 1 FROM cited c WHERE c.query_id = d.query_id AND c.doc_name = d.doc_name
  AND (c.page IS NULL OR c.page = '' OR c.page = d.page::VARCHAR)))
"""


def _matched(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select(
        F.col("doc_id").alias("query_id"), F.lit(1).cast("bigint").alias("place"), F.concat("source", F.lit(".pdf")).alias("doc_name"),
        (F.col("doc_id") % 60).alias("page"), "text", (F.coalesce("quality", F.lit(1)) / 2 + 0.25).alias("relevance"),
        (F.col("doc_id") % 7 / 7).alias("hybrid_score"),
    )
    return ct.match_sources(docs, ct.cited_ranges(answers(spark, d)))


@query("match_sources", _citations_sql(False) + ", " + _DOC_PASSAGES + "SELECT query_id, doc_name, page FROM matched")
def _(spark, d):
    return _matched(spark, d).select("query_id", "doc_name", "page")


@query(
    "source_rows",
    _citations_sql(False) + ", " + _DOC_PASSAGES + "SELECT query_id, place, doc_name AS filename, page, round(hybrid_score, 6) AS score, relevance, "
    "CASE WHEN len(text) > 320 THEN left(text, 300) || '…' ELSE text END AS content FROM matched",
)
def _(spark, d):
    s = ct.source_rows(_matched(spark, d))
    return s.select("query_id", "place", "filename", "page", r6("score").alias("score"), "relevance", "content")


@query("unique_source_labels", _citations_sql(False) + ", " + _DOC_PASSAGES + "SELECT DISTINCT query_id % 50 AS query_id, doc_name || ':' || page AS label FROM matched")
def _(spark, d):
    rows = ct.source_rows(_matched(spark, d)).withColumn("query_id", F.col("query_id") % 50)
    return ct.unique_source_labels(rows)
