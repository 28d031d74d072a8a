"""The composed flows and the streaming forms, over the given tables."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from trawl.catalog.documents import _DIST, _EDGES, _REG, _semantic_sql, hash_sql
from trawl.catalog.inputs import AS_OF, big, chunks, mmr_sql, pages, r6, ranked_sql, table, vector_questions
from trawl.catalog.operations import LIMITS, _JOBS, _METRICS, _rounded, as_job_events, as_requests, cases
from trawl.catalog.registry import SQL, query
from trawl.catalog.retrieval import _HYBRID
from trawl.catalog.scalars import SUMMARY_SQL, TYPE_SQL
from trawl.functions import fixed_values as fv
from trawl.operators import answers as an, embedding as em, versions as v
from trawl.operators.chunks import chunk_pages
from trawl.operators.pages import clean_pages
from trawl.plans import steps
from trawl.session import scratch_folder, stage_table
from trawl.sources.registry_store import RegistryStore
from trawl.streaming import streams
from trawl.streaming.documents import DocumentStream

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CITATION = "array<struct<filename:string,page:bigint,score:double,relevance:double,content:string,upload_timestamp:double,document_status:string,document_version:int,recency:double>>"
CACHE = f"k string, answer string, confidence double, citations {CITATION}, ts bigint"
LOG = f"session_id string, chat_id string, turn bigint, role string, content string, timestamp bigint, sources {CITATION}, confidence double"
MANIFEST = "session_id string, doc string, pages bigint, chunks bigint, status string, message string, upload_timestamp double, document_status string, version bigint"


def _embed(batch):
    """Stands in for a model: length and word count of the text."""
    return [[float(len(t)), float(len(t.split()))] for t in batch]


def ingested(spark, d):
    p = pages(spark, d).withColumn("session_id", F.lit("s"))
    files = table(spark, d, "documents").select("source").distinct().select(
        F.lit("s").alias("session_id"), F.concat("source", F.lit(".pdf")).alias("doc_name"), F.sha2("source", 256).alias("file_hash"),
        F.regexp_extract("source", r"(\d+)$", 1).cast("bigint").alias("reg"), F.lit(AS_OF).alias("upload_timestamp"),
    )
    manifest = spark.createDataFrame([], MANIFEST)
    cache = spark.createDataFrame([], "k string, dim int, vec array<float>")
    return steps.ingest(p, files, None, manifest, cache, _embed)


@query(
    "ingest",
    _EDGES.replace("WITH ", "WITH RECURSIVE ", 1) + f", {_semantic_sql('cleaned', 'doc_name, page', 380, 50)}, {hash_sql('cleaned', 'doc_name')}, "
    "regd AS (SELECT *, regexp_extract(doc_name, '\\d+')::BIGINT AS reg FROM hashes), "
    f"near AS (SELECT a.doc_name, {_DIST} AS dist, row_number() OVER (PARTITION BY a.reg ORDER BY {_DIST}, b.reg) AS rn FROM regd a JOIN regd b "
    f"ON b.reg < a.reg AND {_DIST} <= 10) SELECT doc_name AS doc, p.pages, n AS chunks, CASE WHEN dist IS NULL THEN 'new' WHEN dist <= 6 THEN 'duplicate' "
    "ELSE 'updated' END AS status, 1::BIGINT AS version FROM (SELECT doc_name, count(*) AS pages FROM cleaned GROUP BY ALL) p "
    "JOIN (SELECT doc_name, count(*) AS n FROM walk WHERE e >= 0 GROUP BY ALL) c USING (doc_name) LEFT JOIN (SELECT * FROM near WHERE rn = 1) USING (doc_name)",
)
def _(spark, d):
    return ingested(spark, d).manifest.select("doc", "pages", "chunks", "status", "version")


# Uploads into a used store: of the sources, numbers 0 mod 4 are in the manifest, the
# other even ones were registered before from another file and have cached chunks.
_USED = (
    _EDGES.replace("WITH ", "WITH RECURSIVE ", 1) + f", {_semantic_sql('cleaned', 'doc_name, page', 380, 50)}, {hash_sql('cleaned', 'doc_name')}, "
    "num AS (SELECT *, regexp_extract(doc_name, '\\d+')::BIGINT AS n FROM hashes), "
    "ups AS (SELECT n - 1000 AS reg, doc_name AS filename, hi, lo FROM num WHERE n % 2 = 0 UNION ALL SELECT n, doc_name, hi, lo FROM num WHERE n % 4 <> 0), "
    "regd AS (SELECT *, replace(filename, '.pdf', '') AS doc_id, row_number() OVER (PARTITION BY filename ORDER BY reg) AS version, "
    "min(reg) OVER (PARTITION BY filename) AS doc_first FROM ups), " + _REG[_REG.index("prior AS (") :]
    + """, cut AS (SELECT doc_name, page, row_number() OVER (PARTITION BY doc_name ORDER BY page, pos) - 1 AS chunk_id, e - s AS n_tokens,
  array_to_string(k.t[s + 1 : e], '') AS text, num.n AS nr FROM walk JOIN toks k USING (doc_name, page) JOIN num USING (doc_name) WHERE e >= 0),
now AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY status = 'active' DESC, version DESC) AS rn FROM registry) WHERE rn = 1)
"""
)


def _ingested_into_used(spark, d):
    number = F.regexp_extract("doc_name", r"(\d+)", 1).cast("bigint")
    p = pages(spark, d).withColumn("session_id", F.lit("s"))
    files = table(spark, d, "documents").select("source").distinct().select(
        F.lit("s").alias("session_id"), F.concat("source", F.lit(".pdf")).alias("doc_name"), F.sha2("source", 256).alias("file_hash"),
        F.regexp_extract("source", r"(\d+)$", 1).cast("bigint").alias("reg"), F.lit(AS_OF).alias("upload_timestamp"),
    )
    cleaned = stage_table(clean_pages(p.filter(number % 2 == 0)))
    registered = v.simhash128(cleaned, ["session_id", "doc_name"]).select(
        "session_id", (number - 1000).alias("reg"), F.col("doc_name").alias("filename"), F.lit("before").alias("file_hash"), F.lit("").alias("content_hash"),
        "hi", "lo", F.lit(AS_OF - 1).alias("upload_timestamp"), F.lit(1).cast("bigint").alias("page_count"),
    )
    manifest = files.filter("reg % 4 = 0").selectExpr(
        "session_id", "doc_name AS doc", "1L AS pages", "1L AS chunks", "'new' AS status", "'' AS message", "upload_timestamp", "'active' AS document_status", "1L AS version"
    )
    cached = em.with_key(chunk_pages(cleaned.filter(number % 4 == 2))).select("k").distinct()
    cache = cached.select("k", F.lit(2).alias("dim"), F.array(F.lit(3.0), F.lit(4.0)).cast("array<float>").alias("vec"))
    return steps.ingest(p, files, registered, manifest, cache, _embed)


@query(
    "ingest_chunks",
    _USED + "SELECT doc_name, page, chunk_id, n_tokens, status AS document_status, version AS document_version, round(CASE WHEN text IN (SELECT text FROM cut WHERE nr % 4 = 2) THEN 0.6 "
    "ELSE len(text) / sqrt(len(text) ** 2 + n_tokens ** 2) END, 4)::DOUBLE AS v0 FROM cut JOIN now ON now.doc_id = replace(doc_name, '.pdf', '') WHERE nr % 4 <> 0",
)
def _(spark, d):
    c = _ingested_into_used(spark, d).chunks
    first = F.round(F.get("vec", F.lit(0)).cast("double"), 4)
    return c.select("doc_name", "page", "chunk_id", big("n_tokens").alias("n_tokens"), "document_status", big("document_version").alias("document_version"), first.alias("v0"))


@query("ingest_registry", _USED + "SELECT reg, filename, version, result, matched_reg, status, superseded_by FROM registry")
def _(spark, d):
    return _ingested_into_used(spark, d).registry.select("reg", "filename", big("version").alias("version"), "result", "matched_reg", "status", "superseded_by")


@query("ingest_skipped", "SELECT DISTINCT source || '.pdf' AS doc_name FROM documents WHERE regexp_extract(source, '\\d+')::BIGINT % 4 = 0")
def _(spark, d):
    return _ingested_into_used(spark, d).skipped.select("doc_name")


@query(
    "ingest_statistics",
    _USED + ", per AS (SELECT doc_name AS filename, count(*) AS n_chunks FROM cut WHERE nr % 4 <> 0 GROUP BY ALL) SELECT count(*) AS total_documents, "
    "count(*) FILTER (status = 'active') AS active_documents, count(*) FILTER (status = 'superseded') AS superseded_documents, 0::BIGINT AS archived_documents, "
    "coalesce(sum(n_chunks) FILTER (status = 'active'), 0)::BIGINT AS total_chunks, count(DISTINCT doc_id) AS unique_filenames FROM registry LEFT JOIN per USING (filename)",
)
def _(spark, d):
    return _ingested_into_used(spark, d).statistics.drop("session_id")


@query("ingest_stream", SQL["ingest"])
def _(spark, d):
    """The manifest after the pages of all documents came in two micro-batches, every third page in the second."""
    out = scratch_folder(spark)
    p = pages(spark, d).select(F.lit("s").alias("session_id"), "doc_name", "page", "text")
    files = p.groupBy("session_id", "doc_name").agg(F.countDistinct("page").alias("page_count")).select(
        "session_id", "doc_name", F.regexp_extract("doc_name", r"(\d+)", 1).cast("bigint").alias("reg"), F.sha2("doc_name", 256).alias("file_hash"),
        F.lit(AS_OF).alias("upload_timestamp"), "page_count",
    )
    store = RegistryStore(spark, f"{out}/registry", buckets=4, payload="content_hash string, upload_timestamp double, page_count bigint")
    cache = spark.createDataFrame([], "k string, dim int, vec array<float>")
    stream = DocumentStream(spark, f"{out}/tables", stage_table(files), store, spark.createDataFrame([], MANIFEST), cache, _embed)
    late = F.col("page") % 3 == 0
    for n, part in enumerate((p.filter(~late), p.filter(late))):
        part.write.option("compression", "zstd").parquet(f"{out}/in/p{n}")
        stream.start(spark.readStream.schema(p.schema).parquet(f"{out}/in/p*"), f"{out}/checkpoint").awaitTermination()
    return stream.tables().manifest.select("doc", "pages", "chunks", "status", big("version").alias("version"))


def _asked(spark, d):
    q = vector_questions(spark, d).withColumns(
        {"session_id": F.lit("s"), "docs": F.array(F.lit("all")), "selected": F.lit(None).cast("string")}
    )
    cache = spark.createDataFrame([], CACHE)
    return steps.ask(q, chunks(spark, d).withColumn("session_id", F.lit("s")), cache, AS_OF)


_ASK = _HYBRID + f""", {ranked_sql('final', 'final', 30)}, {mmr_sql(10, 0.6)},
context AS (SELECT query_id, t.doc_name, t.page, t.text, c.final AS relevance, row_number() OVER (PARTITION BY query_id ORDER BY round(c.final, 9) DESC, pick) AS place
  FROM picked JOIN cand c USING (query_id, rank) JOIN text_chunks t ON t.chunk_key = c.chunk_key WHERE pick <= 6 AND c.final >= 0.3)
"""


@query("ask", _ASK + "SELECT query_id, doc_name, page, place, round(relevance, 6) AS relevance FROM context")
def _(spark, d):
    return _asked(spark, d).context.select("query_id", "doc_name", "page", big("place").alias("place"), r6("relevance").alias("relevance"))


@query(
    "finish",
    _ASK + ", cited AS (SELECT query_id, doc_name, page FROM context WHERE place IN (1, 3)) SELECT query_id, place, doc_name AS filename, page, round(relevance, 6) AS relevance, "
    "CASE WHEN len(text) > 320 THEN left(text, 300) || '…' ELSE text END AS content FROM context WHERE (query_id, doc_name, page) IN (SELECT (query_id, doc_name, page) FROM cited)",
)
def _(spark, d):
    context = _asked(spark, d).context
    cite = F.concat(F.lit(" ["), "doc_name", F.lit(":"), F.col("page").cast("string"), F.lit("]"))
    lines = context.filter("place IN (1, 3)").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", cite.alias("c")))).alias("l")).select("query_id", F.array_join("l.c", "").alias("answer"))
    asked = lines.join(context.select("query_id", "query_text").distinct(), "query_id").select(
        "query_id", F.lit("s").alias("session_id"), F.concat(F.lit("c"), F.col("query_id").cast("string")).alias("chat_id"),
        F.col("query_id").alias("seq"), "query_text", "answer", F.array(F.lit("all")).alias("docs"), F.lit(int(AS_OF)).cast("bigint").alias("ts"),
    )
    chats = asked.select("session_id", "chat_id", F.lit("Cuộc trò chuyện").alias("title"), F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"))
    done = steps.finish(asked, context, spark.createDataFrame([], LOG), chats, spark.createDataFrame([], CACHE))
    return done.sources.select("query_id", big("place").alias("place"), "filename", "page", r6("relevance").alias("relevance"), "content")


# The same flow with a filled cache and a session without documents: every fourth
# question was answered before, and every fifth of the others asks where nothing is stored.
_MIXED = _ASK + f""", kinds AS (SELECT query_id, query_text, CASE WHEN query_id % 4 = 0 THEN 'hit' WHEN query_id % 5 = 1 THEN 'none' ELSE 'live' END AS kind FROM questions),
live AS (SELECT c.* FROM context c JOIN kinds USING (query_id) WHERE kind = 'live'),
said AS (SELECT query_id, string_agg(' [' || doc_name || ':' || page || ']', '' ORDER BY place) AS answer FROM live WHERE place IN (1, 3) GROUP BY ALL
  UNION ALL SELECT query_id, 'cached ' || query_id FROM kinds WHERE kind = 'hit'
  UNION ALL SELECT query_id, '{fv.MSG_NO_ANSWER}' FROM kinds WHERE kind = 'none')
"""


def _mixed_questions(spark, d):
    none = (F.col("query_id") % 5 == 1) & (F.col("query_id") % 4 != 0)
    return vector_questions(spark, d).withColumns(
        {"session_id": F.when(none, "e").otherwise("s"), "docs": F.array(F.lit("all")), "selected": F.lit(None).cast("string")}
    )


def _filled_cache(spark, d):
    known = an.with_answer_key(_mixed_questions(spark, d).filter("query_id % 4 = 0"))
    answer = F.concat(F.lit("cached "), F.col("query_id").cast("string"))
    return known.select("k", answer.alias("answer"), F.lit(0.5).alias("confidence"), F.array().cast(CITATION).alias("citations"), F.lit(1).cast("bigint").alias("ts"))


def _mixed(spark, d):
    return steps.ask(_mixed_questions(spark, d), chunks(spark, d).withColumn("session_id", F.lit("s")), _filled_cache(spark, d), AS_OF)


@query("ask_hits", _MIXED + "SELECT query_id, answer, 0.5::DOUBLE AS confidence FROM said JOIN kinds USING (query_id) WHERE kind = 'hit'")
def _(spark, d):
    return _mixed(spark, d).hits.select("query_id", "answer", "confidence")


@query("ask_unanswered", _MIXED + "SELECT query_id, answer, 0.0::DOUBLE AS confidence FROM said JOIN kinds USING (query_id) WHERE kind = 'none'")
def _(spark, d):
    return _mixed(spark, d).unanswered.select("query_id", "answer", "confidence")


@query(
    "ask_prompts",
    _MIXED + f"SELECT DISTINCT query_id, {TYPE_SQL.replace('{}', 'query_text')} AS question_type, CASE WHEN {SUMMARY_SQL.format('query_text')} THEN 2048 ELSE 1024 END AS output_budget "
    "FROM kinds JOIN live USING (query_id)",
)
def _(spark, d):
    return _mixed(spark, d).prompts.select("query_id", "question_type", "output_budget")


def _mixed_finished(spark, d):
    asked = _mixed(spark, d)
    cite = F.concat(F.lit(" ["), "doc_name", F.lit(":"), F.col("page").cast("string"), F.lit("]"))
    lines = asked.context.filter("place IN (1, 3)").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", cite.alias("c")))).alias("l"))
    texts = _mixed_questions(spark, d).select(
        "query_id", "query_text", "session_id", F.concat(F.lit("c"), F.col("query_id").cast("string")).alias("chat_id"), F.col("query_id").alias("seq"),
        F.lit(int(AS_OF)).cast("bigint").alias("ts"),
    )
    answers = lines.select("query_id", F.array_join("l.c", "").alias("answer"), F.array(F.lit("all")).alias("docs")).join(texts, "query_id")
    hits = asked.hits.join(texts, "query_id")
    unanswered = asked.unanswered.select("query_id", "answer").join(texts, "query_id")
    chats = texts.select("session_id", "chat_id", F.lit("Cuộc trò chuyện").alias("title"), F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"))
    return steps.finish(answers, asked.context, spark.createDataFrame([], LOG), chats, _filled_cache(spark, d), hits, unanswered)


@query(
    "finish_log",
    _MIXED + "SELECT 'c' || query_id AS chat_id, 0::BIGINT AS turn, 'user' AS role, query_text AS content FROM kinds JOIN said USING (query_id) "
    "UNION ALL SELECT 'c' || query_id, 1, 'assistant', answer FROM said",
)
def _(spark, d):
    return _mixed_finished(spark, d).log.select("chat_id", "turn", "role", "content")


@query("finish_cache", _MIXED + "SELECT answer FROM said JOIN kinds USING (query_id) WHERE kind <> 'none'")
def _(spark, d):
    return _mixed_finished(spark, d).answer_cache.select("answer")


@query("evaluate", SQL["eval_report"])
def _(spark, d):
    q = F.concat_ws("-", "conv_id", "turn")
    c = cases(spark, d).withColumn("q", q)
    answers = c.filter("answer IS NOT NULL").select("q", "answer", F.lit(0.5).alias("confidence"), "latency_ms")
    report, _ = steps.evaluate(c.select("q", "expected"), answers)
    return report.withColumns({"accuracy": r6("accuracy"), "avg_latency_ms": r6("avg_latency_ms")})


# Streams over the event files.


def _events(spark, d):
    """The event table as a stream; the pattern takes a file or a folder of files."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")


@query("request_metrics_stream", f"SELECT event_type AS endpoint, {_METRICS} FROM events GROUP BY ALL")
def _(spark, d):
    out = scratch_folder(spark)
    totals = streams.request_metrics_stream(as_requests(_events(spark, d)), ["endpoint"])
    run = (
        totals.writeStream.outputMode("complete").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/rows"))
        .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return _rounded(spark.read.parquet(f"{out}/rows"))


@query("job_state_stream", _JOBS)
def _(spark, d):
    out = scratch_folder(spark)
    streams.job_state_stream(as_job_events(_events(spark, d)), f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return streams.current_jobs(spark, f"{out}/rows").drop("seq").withColumn("progress", big("progress"))


@query("rate_limit_stream", SQL["rate_limit"])
def _(spark, d):
    out = scratch_folder(spark)
    run = (
        streams.rate_limit_stream(as_requests(_events(spark, d)), LIMITS).writeStream.format("parquet").outputMode("append")
        .option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("request_id", "allowed")
