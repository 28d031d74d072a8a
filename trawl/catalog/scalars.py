"""Column functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from trawl.catalog.inputs import AS_OF, big, r6, table
from trawl.catalog.registry import query
from trawl.functions import fixed_values as fv, scores, text
from trawl.functions.scores import rescale01

_SAFE = r"regexp_replace(string_split({}, '/')[-1], '[^a-zA-Z0-9_.-]+', '_', 'g')"


def any_sql(column: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({column}, '{p}')" for p in phrases) + ")"


SUMMARY_SQL = any_sql("lower({0})", fv.SUMMARY_PHRASES)
TYPE_SQL = "CASE " + " ".join(
    f"WHEN {any_sql('lower({})', words)} THEN '{name}'" for name, words in fv.QUESTION_TYPES.items()
) + " ELSE 'general' END"


@query("sanitize_filename", f"SELECT page_id, {_SAFE.format('url')} AS safe FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", text.sanitize_filename(F.col("url")).alias("safe"))


@query("doc_id", f"SELECT page_id, regexp_replace({_SAFE.format('url')}, '^(\\.*[^.].*)\\.[^.]*$', '\\1') AS doc_id FROM pages")
def _(spark, d):
    safe = text.sanitize_filename(F.col("url"))
    return table(spark, d, "pages").select("page_id", text.stem(safe).alias("doc_id"))


_RAW_SID = "CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN '  ' || md5(url) || ' ' WHEN 2 THEN ' s..' || page_id ELSE ' s' || page_id || ' ' END"


@query(
    "normalize_session_id",
    f"SELECT page_id, CASE WHEN s = '' OR contains(s, '..') OR contains(s, '/') OR contains(s, chr(92)) THEN NULL ELSE s END AS sid "
    f"FROM (SELECT page_id, trim({_RAW_SID}) AS s FROM pages)",
)
def _(spark, d):
    p, m = F.col("page_id").cast("string"), F.col("page_id") % 4
    raw = (
        F.when(m == 0, F.col("url")).when(m == 1, F.concat(F.lit("  "), F.md5("url"), F.lit(" ")))
        .when(m == 2, F.concat(F.lit(" s.."), p)).otherwise(F.concat(F.lit(" s"), p, F.lit(" ")))
    )
    return table(spark, d, "pages").select("page_id", text.normalize_session_id(raw).alias("sid"))


@query(
    "validate_question",
    f"""SELECT conv_id, turn, CASE WHEN trim(regexp_replace(t, '\\s+', ' ', 'g')) = '' THEN '{fv.MSG_BLANK_QUESTION}'
  WHEN len(regexp_replace(t, '^\\s+|\\s+$', '', 'g')) > 1000 THEN '{fv.MSG_LONG_QUESTION}'
  WHEN turn % 3 = 2 THEN '{fv.MSG_BAD_SESSION}' END AS error
FROM (SELECT *, CASE WHEN conv_id % 10 = 0 THEN '  ' ELSE text END AS t FROM conversations)""",
)
def _(spark, d):
    q = F.when(F.col("conv_id") % 10 == 0, "  ").otherwise(F.col("text"))
    session = F.when(F.col("turn") % 3 == 2, "../x").otherwise("abc")
    return table(spark, d, "conversations").select("conv_id", "turn", text.question_error(q, session).alias("error"))


@query("sha_keys", "SELECT doc_id, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents")
def _(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", text.sha1_key(t).alias("sha1"), text.sha256_key(t).alias("sha256"))


@query(
    "minmax01",
    "SELECT event_id, CASE WHEN hi - lo < 1e-12 THEN 0 ELSE round((value - lo) / (hi - lo), 6) END AS scaled FROM events "
    "JOIN (SELECT user_id, min(value) AS lo, max(value) AS hi FROM events GROUP BY ALL) USING (user_id)",
)
def _(spark, d):
    e = table(spark, d, "events")
    limits = e.groupBy("user_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return e.join(limits, "user_id").select("event_id", r6(rescale01(F.col("value"), F.col("lo"), F.col("hi"))).alias("scaled"))


_V = "CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 3 = 0 THEN value / 400 WHEN event_id % 3 = 1 THEN value - 60 ELSE -value / 200 END"


def _values(spark, d):
    i, v = F.col("event_id"), F.col("value")
    mixed = F.when(i % 11 == 0, None).when(i % 3 == 0, v / 400).when(i % 3 == 1, v - 60).otherwise(-v / 200)
    return table(spark, d, "events").select("event_id", mixed.alias("v"))


_SIG = "CASE WHEN v >= 50 THEN 1 WHEN v <= -50 THEN 0 ELSE 1 / (1 + exp(-v)) END"


@query(
    "sigmoid",
    f"SELECT event_id, round({_SIG}, 6) AS sig, round(CASE WHEN v IS NULL THEN 0 ELSE {_SIG} END, 6) AS sig0 FROM (SELECT event_id, {_V} AS v FROM events)",
)
def _(spark, d):
    v = F.col("v")
    return _values(spark, d).select("event_id", r6(scores.sigmoid(v)).alias("sig"), r6(scores.sigmoid(v, True)).alias("sig0"))


_PROB = (
    "CASE WHEN {0} IS NULL THEN 0 WHEN {0} >= 50 THEN 1 WHEN {0} <= -50 THEN 0 WHEN {0} BETWEEN 0 AND 1 THEN {0} "
    "WHEN {0} > 1 THEN 1 / (1 + exp(-{0})) ELSE greatest(0, least(1, ({0} + 1) / 2)) END"
)


@query("score_to_probability", f"SELECT event_id, round({_PROB.format('v')}, 6) AS prob FROM (SELECT event_id, {_V} AS v FROM events)")
def _(spark, d):
    return _values(spark, d).select("event_id", r6(scores.score_to_probability(F.col("v"))).alias("prob"))


@query(
    "chunk_probability",
    f"SELECT event_id, round(coalesce(nullif(greatest(pa, 0), 0), nullif(greatest(pb, 0), 0), pc), 6) AS prob FROM ("
    f"SELECT event_id, {_PROB.format('v')} AS pa, {_PROB.format('w')} AS pb, {_PROB.format('u')} AS pc FROM ("
    f"SELECT event_id, {_V} AS v, -{_V} AS w, value AS u FROM events))",
)
def _(spark, d):
    v = _values(spark, d).join(table(spark, d, "events").select("event_id", "value"), "event_id")
    none = F.lit(None).cast("double")
    p = scores.chunk_probability(F.col("v"), -F.col("v"), none, none, F.col("value"))
    return v.select("event_id", r6(p).alias("prob"))


_ORDER_AS_OF = 1009843200.0  # 2002-01-01, behind all orders
_AGE = f"({_ORDER_AS_OF}::DOUBLE - epoch(o_orderdate)) / 86400.0::DOUBLE"


def _orders(spark, d):
    ts = F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("double")
    return table(spark, d, "orders").select("o_orderkey", ts.alias("ts"))


@query(
    "recency_score",
    f"""SELECT o_orderkey, round(CASE WHEN unknown THEN 0.5 ELSE exp(-a / 30) END, 6) AS exponential,
  round(CASE WHEN unknown THEN 0.5 ELSE greatest(0, 1 - a / 90) END, 6) AS linear,
  round(CASE WHEN unknown THEN 0.5 WHEN a <= 7 THEN 1 WHEN a <= 30 THEN 0.8 WHEN a <= 90 THEN 0.5 ELSE 0.2 END, 6)::DOUBLE AS step,
  CASE WHEN unknown THEN 0.5 ELSE 1 END::DOUBLE AS none
FROM (SELECT o_orderkey, o_orderkey % 9 = 0 AS unknown, {_AGE} AS a FROM orders)""",
)
def _(spark, d):
    o = _orders(spark, d)
    ts = F.when(F.col("o_orderkey") % 9 == 0, None).otherwise(F.col("ts"))
    modes = ("exponential", "linear", "step", "none")
    return o.select("o_orderkey", *[r6(scores.recency_score(ts, F.lit(_ORDER_AS_OF), m)).alias(m) for m in modes])


@query(
    "recency_decay",
    f"""SELECT o_orderkey, round(least(1, greatest(0, exp(-a / 45))), 6) AS exponential,
  round(CASE WHEN a >= 135 THEN 0 ELSE 1 - a / 135 END, 6) AS linear,
  CASE WHEN a <= 7 THEN 1 WHEN a <= 30 THEN 0.8 WHEN a <= 90 THEN 0.5 WHEN a <= 365 THEN 0.2 ELSE 0.05 END::DOUBLE AS step
FROM (SELECT o_orderkey, {_AGE} AS a FROM orders)""",
)
def _(spark, d):
    now = F.lit(_ORDER_AS_OF)
    modes = ("exponential", "linear", "step")
    return _orders(spark, d).select("o_orderkey", *[r6(scores.recency_decay(F.col("ts"), now, m, 45.0)).alias(m) for m in modes])


@query(
    "age_bucket",
    f"""SELECT o_orderkey, CASE WHEN d = 0 THEN 'today' WHEN d = 1 THEN 'yesterday' WHEN d < 7 THEN 'days' WHEN d < 30 THEN 'weeks'
  WHEN d < 365 THEN 'months' ELSE 'years' END AS unit,
  CASE WHEN d < 7 THEN d WHEN d < 30 THEN d // 7 WHEN d < 365 THEN d // 30 ELSE d // 365 END AS n
FROM (SELECT o_orderkey, floor({_AGE})::BIGINT AS d FROM orders)""",
)
def _(spark, d):
    b = scores.age_bucket(F.col("ts"), F.lit(_ORDER_AS_OF))
    return _orders(spark, d).select("o_orderkey", b["unit"].alias("unit"), b["n"].alias("n"))


@query(
    "recency_boost",
    f"SELECT event_id, round(0.7 * value / 500 + 0.3 * exp(-({AS_OF}::DOUBLE - epoch(ts)) / 86400 / 30), 6) AS boosted FROM events",
)
def _(spark, d):
    ts = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    boosted = scores.recency_boost(F.col("value") / 500, scores.recency_score(ts, F.lit(AS_OF)))
    return table(spark, d, "events").select("event_id", r6(boosted).alias("boosted"))


@query("is_summary_question", f"SELECT conv_id, turn, {SUMMARY_SQL.format('t')} AS is_summary FROM (SELECT *, CASE WHEN turn % 4 = 2 THEN 'SUMMARIZE ' || text ELSE text END AS t FROM conversations)")
def _(spark, d):
    q = F.when(F.col("turn") % 4 == 2, F.concat(F.lit("SUMMARIZE "), "text")).otherwise(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", text.is_summary_question(q).alias("is_summary"))


_KINDS = "(SELECT conv_id, turn, list_value('', 'Khác nhau? ', 'Quy trình? ', 'Là gì? ', 'Bao nhiêu? ')[conv_id % 5 + 1] || text AS q FROM conversations)"


def _kinds(spark, d):
    lead = F.get(F.array(*[F.lit(x) for x in ("", "Khác nhau? ", "Quy trình? ", "Là gì? ", "Bao nhiêu? ")]), (F.col("conv_id") % 5).cast("int"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.concat(lead, "text").alias("q"))


@query("question_type", "SELECT conv_id, turn, " + TYPE_SQL.replace("{}", "q") + f" AS kind FROM {_KINDS}")
def _(spark, d):
    return _kinds(spark, d).select("conv_id", "turn", text.question_type(F.col("q")).alias("kind"))


_GUIDES = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{g}'" for k, g in fv.REASONING_GUIDES.items()) + " END"


@query("reasoning_guide", f"SELECT conv_id, turn, {_GUIDES} AS guide FROM (SELECT conv_id, turn, " + TYPE_SQL.replace("{}", "q") + f" AS kind FROM {_KINDS})")
def _(spark, d):
    return _kinds(spark, d).select("conv_id", "turn", text.reasoning_guide(text.question_type(F.col("q"))).alias("guide"))


@query(
    "truncate_text",
    "SELECT doc_id, CASE WHEN len(text) > 1200 THEN left(text, 1200) || '…' ELSE text END AS context_text, "
    "CASE WHEN len(text) > 320 THEN left(text, 300) || '…' ELSE text END AS source_text FROM documents",
)
def _(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id", text.truncate(t, fv.CONTEXT_CHARS).alias("context_text"),
        text.truncate(t, fv.SOURCE_CHARS, fv.SOURCE_KEEP).alias("source_text"),
    )


BONUS_SQL = (
    f"(CASE WHEN {any_sql('lower(text)', fv.REASONING_WORDS)} THEN 0.1 ELSE 0 END + CASE WHEN regexp_matches(text, '\\p{{Nd}}') THEN 0.05 "
    f"ELSE 0 END + CASE WHEN {any_sql('lower(text)', fv.LIST_MARKERS)} THEN 0.05 ELSE 0 END)::DOUBLE"
)


@query("logic_bonus", f"SELECT doc_id, round({BONUS_SQL}, 6) AS bonus FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", r6(scores.logic_bonus(F.col("text"))).alias("bonus"))


@query(
    "answer_key",
    "SELECT conv_id, turn, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) || '||' || CASE WHEN turn = conv_id % 3 THEN 'a' ELSE "
    "array_to_string(list_sort(list_distinct(['d' || turn, 'b', 'd' || conv_id % 3])), ',') END AS k FROM conversations",
)
def _(spark, d):
    a, b = F.concat(F.lit("d"), F.col("turn").cast("string")), F.concat(F.lit("d"), (F.col("conv_id") % 3).cast("string"))
    docs = F.when(F.col("turn") == F.col("conv_id") % 3, F.array(F.lit("a"), F.lit("a"))).otherwise(F.array(a, F.lit("b"), b))
    return table(spark, d, "conversations").select("conv_id", "turn", text.answer_key(F.col("text"), docs).alias("k"))
