"""The given tables in the roles the operators expect, for Spark and for SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

AS_OF = 1706659200.0  # 2024-01-31 00:00 UTC


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; one that lies in a single file is spread over the cores."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name == "documents" and len(df.inputFiles()) == 1:
        df = df.repartition(spark.sparkContext.defaultParallelism, "doc_id")
    return df


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def big(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def upload_time(doc_id: Column) -> Column:
    return F.lit(AS_OF) - F.pmod(doc_id, F.lit(400)) * F.lit(86400.0)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of one file per source."""
    return table(spark, sf_dir, "documents").select(
        F.concat("source", F.lit(".pdf")).alias("doc_name"), (F.col("doc_id") + 1).alias("page"), "text"
    )


def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as one chunk, without a vector."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("chunk_key"),
        F.concat("source", F.lit(".pdf")).alias("doc_name"),
        (F.col("doc_id") + 1).alias("page"),
        F.lit(0).cast("bigint").alias("chunk_id"),
        "text",
        upload_time(F.col("doc_id")).alias("upload_timestamp"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with a vector; the vectors are dealt out in turn."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("_vec_id"), F.col("embedding").alias("vec"))
    dealt = F.col("chunk_key") % F.lit(vectors.count())
    return text_chunks(spark, sf_dir).withColumn("_vec_id", dealt).join(vectors, "_vec_id").drop("_vec_id")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))


def vector_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    return questions(spark, sf_dir).join(vectors, "query_id")


PAGES_SQL = "pages_in AS (SELECT source || '.pdf' AS doc_name, doc_id + 1 AS page, text FROM documents)"

TEXT_CHUNKS_SQL = f"""text_chunks AS (
  SELECT doc_id AS chunk_key, source || '.pdf' AS doc_name, doc_id + 1 AS page, 0::BIGINT AS chunk_id, text,
         {AS_OF}::DOUBLE - (doc_id % 400) * 86400.0::DOUBLE AS upload_timestamp
  FROM documents)"""

CHUNKS_SQL = TEXT_CHUNKS_SQL + """,
chunks AS (SELECT c.*, e.embedding::DOUBLE[] AS vec FROM text_chunks c JOIN embeddings e ON e.vec_id = c.chunk_key % (SELECT count(*) FROM embeddings))"""

QUESTIONS_SQL = """questions AS (
  SELECT b.item_id AS query_id, b.text AS query_text, e.embedding::DOUBLE[] AS vec
  FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id)"""

TEXT_QUESTIONS_SQL = "questions AS (SELECT item_id AS query_id, text AS query_text FROM benchmark)"

TERM_RE = r"\p{L}+\p{M}*|\p{Nd}+"


def bm25_stats_sql(source: str) -> str:
    """CTEs from a table of (chunk_key, text) up to the term weights."""
    return rf"""tf AS MATERIALIZED (
  SELECT chunk_key, term, count(*) AS tf FROM (
    SELECT chunk_key, lower(unnest(regexp_extract_all(text, '{TERM_RE}'))) AS term FROM {source}) GROUP BY ALL),
dfreq AS MATERIALIZED (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
size AS (SELECT count(*) AS n FROM {source}),
ridf AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM dfreq, size),
stat AS (SELECT (SELECT n FROM size) AS n, (SELECT sum(tf) FROM tf) / (SELECT n FROM size) AS avg_len,
                (SELECT avg(raw) FROM ridf) AS mean_idf),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * mean_idf ELSE raw END AS idf FROM ridf, stat)"""


def bm25_sql(source: str) -> str:
    """The same and ``questions`` up to sparse scores."""
    return bm25_stats_sql(source) + rf""",
lens AS (SELECT chunk_key, sum(tf) AS len FROM tf GROUP BY ALL),
qt AS (SELECT query_id, term, count(*) AS qn FROM (
  SELECT query_id, lower(unnest(regexp_extract_all(query_text, '{TERM_RE}'))) AS term FROM questions) GROUP BY ALL),
sparse AS (
  SELECT q.query_id, t.chunk_key,
         sum(q.qn * i.idf * t.tf * 2.5 / (t.tf + 1.5 * (0.25 + 0.75 * l.len / s.avg_len))) AS bm25_raw
  FROM qt q JOIN idf i USING (term) JOIN tf t USING (term) JOIN lens l ON l.chunk_key = t.chunk_key, stat s
  GROUP BY ALL)"""


RANGE_SQL = """lim AS (
  SELECT query_id,
         CASE WHEN count(*) < (SELECT n FROM size) THEN least(min(bm25_raw), 0) ELSE min(bm25_raw) END AS low,
         CASE WHEN count(*) < (SELECT n FROM size) THEN greatest(max(bm25_raw), 0) ELSE max(bm25_raw) END AS high
  FROM sparse GROUP BY ALL)"""


def scored_sql(alpha: float, weight: float) -> str:
    return f"""scored AS (
  SELECT q.query_id, c.chunk_key, c.vec,
         list_inner_product(q.vec, c.vec) AS dense_raw,
         coalesce(s.bm25_raw, 0) AS bm25_raw,
         CASE WHEN coalesce(high - low, 0) < 1e-12 THEN 0 ELSE (coalesce(s.bm25_raw, 0) - low) / (high - low) END AS bm25_01,
         CASE WHEN c.upload_timestamp > 0 THEN exp(-({AS_OF} - c.upload_timestamp) / 86400.0::DOUBLE / 30) ELSE 0.5 END AS recency
  FROM questions q CROSS JOIN chunks c
  LEFT JOIN sparse s ON s.query_id = q.query_id AND s.chunk_key = c.chunk_key
  LEFT JOIN lim ON lim.query_id = q.query_id),
mixed AS (SELECT *, {1 - alpha} * (dense_raw + 1) / 2 + {alpha} * bm25_01 AS fused FROM scored),
final AS (SELECT *, {1 - weight} * fused + {weight} * recency AS final FROM mixed)"""


def ranked_sql(score: str, source: str, n: int) -> str:
    return f"""cand AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round({score}, 9) DESC, chunk_key) AS rank FROM {source})
  WHERE rank <= {n})"""


def mmr_sql(k: int, lam: float, floor_zero: bool = True) -> str:
    """CTEs from ``cand`` to ``picked(query_id, pick, rank)``; needs WITH RECURSIVE."""
    worst = "list_max(list_transform(s.chosen, lambda j: c.sims[j]))"
    penalty = f"greatest(0, coalesce({worst}, 0))" if floor_zero else f"coalesce({worst}, 0)"
    return f"""sims AS (
  SELECT a.query_id, a.rank, any_value(a.dense_raw) AS dense_raw,
         list(list_inner_product(a.vec, b.vec) ORDER BY b.rank) AS sims
  FROM cand a JOIN cand b ON a.query_id = b.query_id GROUP BY a.query_id, a.rank),
steps AS (
  SELECT query_id, 0 AS n, []::BIGINT[] AS chosen FROM sims GROUP BY query_id
  UNION ALL
  SELECT query_id, n + 1, list_append(any_value(chosen), min(choice).r) FROM (
    SELECT s.query_id, s.n, s.chosen,
           {{'g': -round({lam} * c.dense_raw - {1 - lam} * {penalty}, 9), 'r': c.rank}} AS choice
    FROM steps s JOIN sims c ON c.query_id = s.query_id
    WHERE s.n < {k} AND NOT list_contains(s.chosen, c.rank)) GROUP BY query_id, n),
picked AS (
  SELECT query_id, unnest(range(1, len(chosen) + 1)) AS pick, unnest(chosen) AS rank FROM (
    SELECT query_id, arg_max(chosen, n) AS chosen FROM steps GROUP BY query_id))"""
