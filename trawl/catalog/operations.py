"""Rate limits, request metrics, job state, cache counts, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from trawl.catalog.inputs import AS_OF, big, r6, table
from trawl.catalog.records import _EMBED, _ACACHE, _answer_cache, _cache
from trawl.catalog.registry import query
from trawl.operators import ops

LIMITS = {"click": (1, 86400.0), "view": (2, 3 * 86400.0), "purchase": (3, 5 * 86400.0)}


def as_requests(events):
    return events.select(
        F.col("event_id").alias("request_id"), F.col("user_id").cast("string").alias("client"), F.col("event_type").alias("endpoint"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), F.col("value").alias("response_ms"),
        (F.col("event_type") != "error").alias("success"),
    )


def requests(spark, d):
    return as_requests(table(spark, d, "events"))


@query(
    "rate_limit",
    """WITH RECURSIVE lim AS (SELECT * FROM (VALUES ('click', 1, 86400.0::DOUBLE), ('view', 2, 259200.0), ('purchase', 3, 432000.0)) t(event_type, m, w)),
seqd AS (SELECT event_id, user_id, event_type, epoch_us(ts) / 1e6 AS t, m, w, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn
  FROM events JOIN lim USING (event_type)),
walk AS (SELECT user_id, event_type, rn, event_id, [t] AS kept, true AS allowed FROM seqd WHERE rn = 1
  UNION ALL SELECT user_id, event_type, rn, event_id, CASE WHEN len(live) < m THEN list_append(live, t) ELSE live END, len(live) < m FROM (
    SELECT s.*, list_filter(k.kept, lambda x: s.t - x < s.w) AS live FROM walk k JOIN seqd s ON s.user_id = k.user_id AND s.event_type = k.event_type AND s.rn = k.rn + 1))
SELECT event_id AS request_id, coalesce(w.allowed, true) AS allowed FROM events LEFT JOIN walk w USING (event_id)""",
)
def _(spark, d):
    return ops.rate_limit(requests(spark, d), LIMITS).select("request_id", "allowed")


_METRICS = (
    "count(*) AS request_count, count(*) FILTER (event_type = 'error') AS error_count, round(count(*) FILTER (event_type = 'error') / count(*), 6) AS error_rate, "
    "round(avg(value), 6) AS avg_response_time, max(value) AS max_response_time, min(value) AS min_response_time"
)


def _rounded(m):
    return m.withColumns({"error_rate": r6("error_rate"), "avg_response_time": r6("avg_response_time")})


@query("request_metrics", f"SELECT event_type AS endpoint, {_METRICS} FROM events GROUP BY ALL")
def _(spark, d):
    return _rounded(ops.request_metrics(requests(spark, d), ["endpoint"]))


@query("request_metrics_total", f"SELECT {_METRICS} FROM events")
def _(spark, d):
    return _rounded(ops.request_metrics(requests(spark, d)))


def as_job_events(events):
    kind = F.col("event_type")
    event = F.when(kind == "signup", "created").when(kind == "purchase", "done").when(kind == "error", "failed").otherwise("progress")
    return events.select(
        F.concat(F.lit("job-"), F.col("user_id").cast("string")).alias("job_id"), F.concat(F.lit("s"), (F.col("user_id") % 9).cast("string")).alias("session_id"),
        F.col("event_id").alias("seq"), event.alias("event"), (F.col("value") - 20).alias("progress"), F.col("props").alias("result"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"),
    )


def job_events(spark, d):
    return as_job_events(table(spark, d, "events"))


_JOBS = """SELECT 'job-' || user_id AS job_id, any_value('s' || user_id % 9) AS session_id,
  coalesce(arg_max(CASE event_type WHEN 'signup' THEN 'pending' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' END, event_id)
    FILTER (event_type IN ('signup', 'purchase', 'error')), 'pending') AS status,
  coalesce(arg_max(CASE event_type WHEN 'signup' THEN 0 WHEN 'purchase' THEN 100 ELSE greatest(0, least(100, trunc(value - 20))) END, event_id)
    FILTER (event_type <> 'error'), 0)::BIGINT AS progress,
  arg_max(props, event_id) FILTER (event_type IN ('purchase', 'error')) AS result, min(epoch_us(ts) // 1000) AS ts_created, max(epoch_us(ts) // 1000) AS ts_updated
FROM events GROUP BY user_id"""


@query("job_state", _JOBS)
def _(spark, d):
    return ops.job_state(job_events(spark, d)).drop("seq").withColumn("progress", big("progress"))


@query("job_status", f"SELECT job_id, status FROM ({_JOBS}) WHERE job_id IN (SELECT 'job-' || c_custkey FROM customer WHERE c_custkey % 3 = 0)")
def _(spark, d):
    wanted = table(spark, d, "customer").filter("c_custkey % 3 = 0").select(F.concat(F.lit("job-"), F.col("c_custkey").cast("string")).alias("job_id"))
    return ops.job_status(ops.job_state(job_events(spark, d)), wanted).select("job_id", "status")


@query(
    "cache_stats",
    f"WITH {_EMBED}, {_ACACHE} SELECT 'embed' AS cache, count(*) AS entries FROM cache UNION ALL SELECT 'answer', count(DISTINCT k) FROM keyed",
)
def _(spark, d):
    return ops.cache_stats(_cache(spark, d), _answer_cache(spark, d, "true"))


# Evaluation cases: the question of an exchange, its answer, and the question's words to look for.
_CASES = r"""cases AS (SELECT u.conv_id, u.turn, a.text AS answer, regexp_extract_all(upper(u.text), '\S+') AS expected, len(u.text)::DOUBLE AS latency_ms
  FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'),
judged AS (SELECT *, answer IS NOT NULL AND len(list_filter(expected, lambda x: contains(lower(answer), lower(x)))) > 0 AS matched FROM cases)"""


def cases(spark, d):
    c = table(spark, d, "conversations")
    a = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    words = F.regexp_extract_all(F.upper("text"), F.lit(r"(\S+)"), F.lit(1))
    return c.filter("role = 'user'").join(a, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "answer", words.alias("expected"), F.length("text").cast("double").alias("latency_ms")
    )


@query("keyword_match", f"WITH {_CASES} SELECT conv_id, turn, matched FROM judged")
def _(spark, d):
    return ops.match_keywords(cases(spark, d)).select("conv_id", "turn", "matched")


@query(
    "eval_report",
    f"WITH {_CASES}, t AS (SELECT count(*) AS total, count(*) FILTER (matched AND answer IS NOT NULL) AS passed, avg(latency_ms) FILTER (answer IS NOT NULL) AS l FROM judged) "
    "SELECT total, passed, round(l, 6) AS avg_latency_ms, round(passed * 100 / total, 6) AS accuracy, CASE WHEN passed * 100 / total >= 60 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM t",
)
def _(spark, d):
    r = ops.eval_report(ops.match_keywords(cases(spark, d)))
    return r.withColumns({"accuracy": r6("accuracy"), "avg_latency_ms": r6("avg_latency_ms")})
