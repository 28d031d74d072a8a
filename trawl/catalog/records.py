"""Files, tables, caches, chats, sessions and manifests."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from trawl.catalog.documents import _REG, uploads
from trawl.catalog.inputs import AS_OF, TEXT_CHUNKS_SQL, big, r6, table, text_chunks
from trawl.catalog.registry import query
from trawl.functions.text import sha1_key
from trawl.functions.vectors import dot
from trawl.operators import answers as an, chat_changes as cc, chats as ch, embedding as em, sessions as se, versions as v
from trawl.session import scratch_folder
from trawl.sources import files as fi, tables as tb

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Files and tables.


@query(
    "scan_files",
    "SELECT 'bucket=' || page_id % 16 AS session_id, sum(strlen(translate(html, chr(10) || chr(13), '  ')) + 1)::BIGINT AS size FROM pages GROUP BY ALL",
)
def _(spark, d):
    """Pages written as one text file per bucket, found by name pattern; sizes come from the files' metadata."""
    folder = scratch_folder(spark)
    lines = table(spark, d, "pages").select((F.col("page_id") % 16).alias("bucket"), F.translate("html", "\n\r", "  ").alias("value"))
    lines.repartition("bucket").write.partitionBy("bucket").text(folder)
    return fi.scan_files(spark, folder, "*.[tT][xX][tT]").select("session_id", "size")


@query(
    "validate_files",
    """WITH ups AS (SELECT page_id, page_id // 7 AS batch_id, 'page ' || page_id || CASE WHEN page_id % 5 = 0 THEN '.html' ELSE '.PDF' END AS filename,
  CASE WHEN page_id % 10 = 0 THEN 'application/pdf' ELSE 'text/html' END AS content_type,
  CASE WHEN page_id % 3 = 0 THEN html ELSE '%PDF-1.4 ' || html END AS content, count(*) OVER (PARTITION BY page_id // 7) AS n FROM pages)
SELECT page_id, regexp_replace(filename, '[^a-zA-Z0-9_.-]+', '_', 'g') AS safe_name, CASE WHEN n > 6 THEN 'Tối đa 6 file / lần'
  WHEN NOT (contains(content_type, 'pdf') OR ends_with(lower(filename), '.pdf')) THEN 'File không phải PDF'
  WHEN NOT contains(left(content, 4096), '%PDF') THEN 'Tệp không phải PDF hợp lệ (thiếu chữ ký %PDF)' END AS error
FROM (SELECT * EXCLUDE n, CASE WHEN batch_id % 2 = 0 THEN 1 ELSE n END AS n FROM ups)""",
)
def _(spark, d):
    p = F.col("page_id")
    batch = F.floor(p / 7)
    ups = table(spark, d, "pages").select(
        "page_id", F.when(batch % 2 == 0, -p - 1).otherwise(batch).alias("batch_id"),
        F.concat(F.lit("page "), p.cast("string"), F.when(p % 5 == 0, ".html").otherwise(".PDF")).alias("filename"),
        F.when(p % 10 == 0, "application/pdf").otherwise("text/html").alias("content_type"),
        F.when(p % 3 == 0, F.col("html")).otherwise(F.concat(F.lit("%PDF-1.4 "), "html")).cast("binary").alias("content"),
    )
    return fi.validate_files(ups, max_files=6).select("page_id", "safe_name", "error")


@query(
    "validate_scanned_files",
    """WITH f AS (SELECT page_id % 16 AS bucket, sum(strlen(translate(html, chr(10) || chr(13), '  ')) + 1 + CASE WHEN page_id % 16 % 3 = 0 THEN 9 ELSE 0 END)::BIGINT AS size FROM pages GROUP BY ALL), n AS (SELECT *, count(*) OVER (PARTITION BY bucket // 7) AS n FROM f)
SELECT 'bucket=' || bucket AS session_id, size, CASE WHEN n > 6 THEN 'Tối đa 6 file / lần' WHEN bucket % 5 = 0 THEN 'File không phải PDF'
  WHEN bucket % 3 > 0 THEN 'Tệp không phải PDF hợp lệ (thiếu chữ ký %PDF)' WHEN size > 1048576 THEN 'File vượt quá 1 MB' END AS error FROM n""",
)
def _(spark, d):
    """Pages written as one file per bucket and checked by size and first bytes; no file is read whole."""
    folder = scratch_folder(spark)
    b = F.col("page_id") % 16
    line = F.concat(F.when(b % 3 == 0, "%PDF-1.4 ").otherwise(""), F.translate("html", "\n\r", "  "))
    table(spark, d, "pages").select(b.alias("bucket"), line.alias("value")).repartition("bucket").write.partitionBy("bucket").text(folder)
    found = fi.scan_heads(spark, folder, "*.[tT][xX][tT]")
    bucket = F.substring_index("session_id", "=", -1).cast("int")
    ups = found.withColumns({"batch_id": F.floor(bucket / 7), "content_type": F.when(bucket % 5 == 0, "text/html").otherwise("application/pdf")})
    return fi.validate_files(ups, max_mb=1, max_files=6).select("session_id", "size", "error")


def _items(spark, d):
    return text_chunks(spark, d).select(
        (F.concat(F.lit("s"), (F.col("chunk_key") % 4).cast("string"))).alias("session_id"), "doc_name",
        F.col("page").cast("int").alias("page"), F.col("chunk_id").cast("int").alias("chunk_id"), "text",
        F.length("text").alias("n_tokens"), "upload_timestamp", F.lit("active").alias("document_status"),
        F.lit(1).alias("document_version"),
    )


@query(
    "items_round_trip",
    f"WITH {TEXT_CHUNKS_SQL} SELECT 's' || chunk_key % 4 AS session_id, doc_name, page, chunk_id, sha256(text) AS digest, len(text) AS n_tokens, "
    "upload_timestamp, 'active' AS document_status, 1::BIGINT AS document_version FROM text_chunks",
)
def _(spark, d):
    path = scratch_folder(spark)
    fi.write_items(_items(spark, d), path)
    s = fi.read_items(spark, path)
    ints = [big(c).alias(c) for c in ("page", "chunk_id", "n_tokens", "document_version")]
    return s.select("session_id", "doc_name", *ints, F.sha2("text", 256).alias("digest"), "upload_timestamp", "document_status")


@query(
    "fingerprints_round_trip",
    _REG + "SELECT doc_id, filename, file_hash, version, upload_timestamp, chunk_count, status, superseded_by, supersedes FROM registry",
)
def _(spark, d):
    r = v.register(uploads(spark, d)).withColumns(
        {
            "content_hash": F.col("file_hash"), "semantic_hash": v.simhash_hex(F.col("hi"), F.col("lo")),
            "chunk_ids": F.array().cast("array<string>"),
        }
    )
    path = scratch_folder(spark)
    fi.write_fingerprints(r, path)
    s = fi.read_fingerprints(spark, path)
    return s.select(
        "doc_id", "filename", "file_hash", big("version").alias("version"), "upload_timestamp", big("chunk_count").alias("chunk_count"),
        "status", "superseded_by", F.array_join("supersedes", "|").alias("supersedes"),
    )


_MANIFEST = """manifest AS (SELECT 's' || source[-1:] AS session_id, source || '.pdf' AS doc, count(*) AS pages, sum(n_chars)::BIGINT AS chunks,
  min(doc_id) AS upload_timestamp, 'new' AS status, source AS message, 'active' AS document_status, 1::BIGINT AS version FROM documents GROUP BY source)"""


def manifest(spark, d):
    docs = table(spark, d, "documents").groupBy("source").agg(
        F.count(F.lit(1)).alias("pages"), F.sum("n_chars").alias("chunks"), F.min("doc_id").cast("double").alias("upload_timestamp")
    )
    return docs.select(
        F.concat(F.lit("s"), F.right("source", F.lit(1))).alias("session_id"), F.concat("source", F.lit(".pdf")).alias("doc"), "pages",
        "chunks", F.lit("new").alias("status"), F.col("source").alias("message"), "upload_timestamp",
        F.lit("active").alias("document_status"), F.lit(1).cast("bigint").alias("version"),
    )


@query(
    "manifest_round_trip",
    f"WITH {_MANIFEST} SELECT session_id, doc, pages, chunks, status, message, upload_timestamp::DOUBLE AS upload_timestamp, document_status, version FROM manifest",
)
def _(spark, d):
    path = scratch_folder(spark)
    fi.write_manifest(manifest(spark, d), path, int(AS_OF))
    s = fi.read_manifest(spark, path)
    return s.drop("ts").withColumns({"pages": big("pages"), "version": big("version")})


@query(
    "append_vectors",
    "SELECT 's' || label AS session_id, count(*) AS n, round(sum(embedding[1]::DOUBLE), 6) AS total FROM (SELECT * FROM embeddings UNION ALL "
    "SELECT * FROM embeddings) GROUP BY label",
)
def _(spark, d):
    rows = table(spark, d, "embeddings").select(
        F.concat(F.lit("s"), F.col("label").cast("string")).alias("session_id"), "vec_id", F.col("embedding").alias("vec")
    )
    path = scratch_folder(spark)
    tb.append_vectors(spark, path, rows)
    tb.append_vectors(spark, path, rows)
    total = F.sum(F.get("vec", F.lit(0)).cast("double"))
    return spark.read.parquet(path).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), r6(total).alias("total"))


@query(
    "incremental_ingest",
    f"WITH {_MANIFEST} SELECT d.doc_id, CASE WHEN m.doc IS NULL THEN 'new' ELSE 'skipped' END AS outcome FROM documents d LEFT JOIN "
    "(SELECT * FROM manifest WHERE upload_timestamp >= 5) m ON m.doc = d.source || '.pdf'",
)
def _(spark, d):
    known = manifest(spark, d).filter("upload_timestamp >= 5")
    docs = table(spark, d, "documents").select(
        "doc_id", F.concat(F.lit("s"), F.right("source", F.lit(1))).alias("session_id"), F.concat("source", F.lit(".pdf")).alias("doc_name")
    )
    new, skipped = se.split_new_documents(docs, known)
    mark = lambda df, x: df.select("doc_id", F.lit(x).alias("outcome"))
    return mark(new, "new").unionByName(mark(skipped, "skipped"))


@query("remove_doc", "SELECT source || '.pdf' AS doc_name, doc_id AS chunk_key FROM documents WHERE source <> 'src3'")
def _(spark, d):
    return tb.remove_doc(text_chunks(spark, d), "src3.pdf").select("doc_name", "chunk_key")


@query("removed_counts", "SELECT source || '.pdf' AS doc_name, count(*) AS removed FROM documents WHERE source = 'src3' GROUP BY ALL")
def _(spark, d):
    pool = text_chunks(spark, d)
    return tb.removed_counts(pool, tb.remove_doc(pool, "src3.pdf"))


@query(
    "replace_sessions",
    "SELECT 's' || (conv_id % 20) AS session_id, conv_id, turn, role FROM conversations WHERE NOT (conv_id % 20 < 5 AND role = 'system')",
)
def _(spark, d):
    """A stored table after five of its sessions were written again without their system rows."""
    rows = table(spark, d, "conversations").select(
        F.concat(F.lit("s"), (F.col("conv_id") % 20).cast("string")).alias("session_id"), "conv_id", "turn", "role"
    )
    path = scratch_folder(spark)
    tb.replace_sessions(rows, path)
    tb.replace_sessions(rows.filter("conv_id % 20 < 5 AND role <> 'system'"), path)
    return spark.read.schema(rows.schema).parquet(path).select("session_id", "conv_id", "turn", "role")


@query(
    "drop_sessions",
    "SELECT 's' || conv_id AS session_id, turn FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')",
)
def _(spark, d):
    c = table(spark, d, "conversations").withColumn("session_id", F.concat(F.lit("s"), F.col("conv_id").cast("string")))
    return tb.drop_sessions(c, c.filter("role = 'system'")).select("session_id", "turn")


@query("list_docs", "SELECT DISTINCT source || '.pdf' AS doc_name FROM documents")
def _(spark, d):
    return tb.list_docs(text_chunks(spark, d))


@query("index_size", "SELECT count(*) AS size FROM documents")
def _(spark, d):
    return tb.index_size(text_chunks(spark, d))


# Embedding cache: vectors of documents by the hash of their text.
_EMBED = """cache AS (SELECT k, arg_min(vec, vec_id) AS vec FROM (SELECT sha1(text) AS k, embedding AS vec, vec_id FROM documents JOIN embeddings
  ON vec_id = doc_id) GROUP BY k)"""


def _cache(spark, d, shift=0):
    e = table(spark, d, "embeddings").select((F.col("vec_id") + shift).alias("doc_id"), F.col("embedding").alias("vec"))
    keyed = table(spark, d, "documents").join(e, "doc_id").select(sha1_key(F.col("text")).alias("k"), "doc_id", "vec")
    return keyed.groupBy("k").agg(F.min_by("vec", "doc_id").alias("vec")).select("k", F.size("vec").alias("dim"), "vec")


@query("cache_lookup", f"WITH {_EMBED} SELECT doc_id, sha1(text) AS k, len(vec) AS dim, round(vec[1]::DOUBLE, 6) AS first FROM documents LEFT JOIN cache ON k = sha1(text)")
def _(spark, d):
    s = em.cache_lookup(table(spark, d, "documents").select("doc_id", "text"), _cache(spark, d))
    return s.select("doc_id", "k", big("dim").alias("dim"), r6(F.get("vec", F.lit(0)).cast("double")).alias("first"))


@query("cache_misses", f"WITH {_EMBED} SELECT DISTINCT sha1(text) AS k, len(text) AS n_chars FROM documents WHERE sha1(text) NOT IN (SELECT k FROM cache)")
def _(spark, d):
    s = em.cache_misses(table(spark, d, "documents").select("doc_id", "text"), _cache(spark, d))
    return s.select("k", big(F.length("text")).alias("n_chars"))


@query(
    "cache_upsert",
    f"WITH {_EMBED}, fresh AS (SELECT k, arg_min(vec, doc_id) AS vec FROM (SELECT sha1(text) AS k, embedding AS vec, doc_id FROM documents "
    "JOIN embeddings ON vec_id + 100 = doc_id) GROUP BY k) SELECT k, round(coalesce(f.vec, c.vec)[1]::DOUBLE, 6) AS first "
    "FROM cache c FULL JOIN fresh f USING (k)",
)
def _(spark, d):
    s = em.cache_upsert(_cache(spark, d), _cache(spark, d, 100))
    return s.select("k", r6(F.get("vec", F.lit(0)).cast("double")).alias("first"))


def _toy_model(batch):
    """Stands in for a model: length, count of the letter e, and one."""
    return [[float(len(t)), float(t.count("e")), 1.0] for t in batch]


@query(
    "embed_column",
    """WITH hits AS (SELECT DISTINCT sha1(text) AS k FROM documents JOIN labels USING (doc_id) WHERE quality = 1),
raw AS (SELECT doc_id, CASE WHEN k IS NOT NULL THEN [3.0, 4.0, 0.0]::DOUBLE[] ELSE
  [len(text), len(text) - len(replace(text, 'e', '')), 1]::DOUBLE[] END AS u FROM documents LEFT JOIN hits ON k = sha1(text))
SELECT doc_id, round(u[1] / (sqrt(list_inner_product(u, u)) + 1e-12), 6) AS x, round(u[2] / (sqrt(list_inner_product(u, u)) + 1e-12), 6) AS y FROM raw""",
)
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    good = docs.join(table(spark, d, "labels").filter("quality = 1"), "doc_id")
    vec = F.array(F.lit(3.0), F.lit(4.0), F.lit(0.0)).cast("array<float>")
    cache = good.select(sha1_key(F.col("text")).alias("k")).distinct().select("k", F.lit(3).alias("dim"), vec.alias("vec"))
    out, _ = em.embed_column(docs, cache, _toy_model)
    return out.select("doc_id", r6(F.get("vec", F.lit(0))).alias("x"), r6(F.get("vec", F.lit(1))).alias("y"))


# Exchanges: a user turn and the assistant turn right after it.
_EXCHANGES = """ex AS (SELECT 's' || u.conv_id % 25 AS session_id, 'c' || u.conv_id AS chat_id, u.conv_id, u.turn, u.conv_id * 1000 + u.turn AS seq,
  u.text AS question, a.text AS answer, 1700000000 + u.conv_id * 1000 + u.turn AS timestamp FROM conversations u JOIN conversations a
  ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND u.role = 'user' AND a.role = 'assistant'),
log AS (SELECT 's' || conv_id % 25 AS session_id, 'c' || conv_id AS chat_id, turn, role, text AS content, 1700000000::BIGINT AS timestamp
  FROM conversations WHERE role = 'system'),
chats AS (SELECT DISTINCT 's' || conv_id % 25 AS session_id, 'c' || conv_id AS chat_id, CASE conv_id % 4 WHEN 0 THEN 'Cuộc trò chuyện ' || conv_id
  WHEN 1 THEN ' cuộc trò chuyện' WHEN 2 THEN 'Riêng' END AS title, 1700000000 + conv_id AS created_at,
  CASE WHEN conv_id % 5 > 0 THEN 1700000000 + conv_id % 7 END AS updated_at, conv_id FROM conversations)"""


def _ids(c="conv_id"):
    return [F.concat(F.lit("s"), (F.col(c) % 25).cast("string")).alias("session_id"), F.concat(F.lit("c"), F.col(c).cast("string")).alias("chat_id")]


_SOURCES = "array<struct<filename:string,page:int>>"


def exchanges(spark, d):
    c = table(spark, d, "conversations")
    a = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    seq = F.col("conv_id") * 1000 + F.col("turn")
    cited = F.struct(F.lit("a.pdf").alias("filename"), F.col("turn").cast("int").alias("page"))
    sources = F.when(F.col("turn") % 4 == 0, F.array(cited)).otherwise(F.array().cast(_SOURCES))
    return c.filter("role = 'user'").join(a, ["conv_id", "turn"]).select(
        *_ids(), "conv_id", "turn", seq.alias("seq"), F.col("text").alias("question"), "answer", sources.alias("sources"),
        F.lit(0.5).alias("confidence"), (1700000000 + seq).alias("timestamp"),
    )


def log(spark, d, roles=("system",)):
    c = table(spark, d, "conversations").filter(F.col("role").isin(*roles))
    return c.select(
        *_ids(), "turn", "role", F.col("text").alias("content"), F.lit(1700000000).cast("bigint").alias("timestamp"),
        F.lit(None).cast(_SOURCES).alias("sources"), F.lit(None).cast("double").alias("confidence"),
    )


def chats(spark, d):
    i = F.col("conv_id")
    title = F.when(i % 4 == 0, F.concat(F.lit("Cuộc trò chuyện "), i.cast("string"))).when(i % 4 == 1, " cuộc trò chuyện").when(i % 4 == 2, "Riêng")
    return table(spark, d, "conversations").select("conv_id").distinct().select(
        *_ids(), title.alias("title"), (1700000000 + i).alias("created_at"), F.when(i % 5 > 0, 1700000000 + i % 7).alias("updated_at")
    )


@query(
    "append_exchange",
    f"WITH {_EXCHANGES}, placed AS (SELECT *, coalesce((SELECT max(turn) + 1 FROM log l WHERE l.chat_id = ex.chat_id), 0) + 2 * "
    "(row_number() OVER (PARTITION BY chat_id ORDER BY seq) - 1) AS t FROM ex) SELECT chat_id, turn, role, content, timestamp FROM log UNION ALL "
    "SELECT chat_id, t, 'user', question, timestamp FROM placed UNION ALL SELECT chat_id, t + 1, 'assistant', answer, timestamp FROM placed",
)
def _(spark, d):
    s = ch.append_exchange(log(spark, d), exchanges(spark, d))
    return s.select("chat_id", "turn", "role", "content", "timestamp")


@query(
    "auto_title",
    f"WITH {_EXCHANGES}, f AS (SELECT chat_id, arg_min(question, seq) AS q, max(timestamp) AS t FROM ex GROUP BY ALL) SELECT c.chat_id, "
    "CASE WHEN q IS NOT NULL AND conv_id % 4 IN (0, 1) AND c.chat_id NOT IN (SELECT chat_id FROM log) THEN left(trim(q), 60) ELSE title END AS title, "
    "coalesce(t, updated_at) AS updated_at FROM chats c LEFT JOIN f USING (chat_id)",
)
def _(spark, d):
    return ch.auto_title(chats(spark, d), log(spark, d), exchanges(spark, d)).select("chat_id", "title", "updated_at")


_EVERY = ("user", "assistant", "system")


@query(
    "list_chats",
    f"WITH {_EXCHANGES} SELECT session_id, chat_id, coalesce(title, 'Cuộc trò chuyện') AS title, created_at, updated_at, "
    "(SELECT count(*) FROM conversations v WHERE v.conv_id = c.conv_id) AS message_count FROM chats c",
)
def _(spark, d):
    return ch.list_chats(chats(spark, d), log(spark, d, _EVERY))


@query(
    "chat_transcripts",
    f"WITH {_EXCHANGES} SELECT c.chat_id, 0::BIGINT AS part, coalesce(title, 'Cuộc trò chuyện') AS title, coalesce(updated_at, 1706659200) AS updated_at, "
    "count(*) AS n, sha256(string_agg(role || ':' || text, '|' ORDER BY turn)) AS digest FROM chats c JOIN conversations v USING (conv_id) GROUP BY ALL",
)
def _(spark, d):
    s = ch.chat_transcripts(chats(spark, d), log(spark, d, _EVERY), int(AS_OF))
    lines = F.transform("messages", lambda m: F.concat_ws(":", m["role"], m["content"]))
    return s.select(
        "chat_id", "part", "title", "updated_at", big(F.size("messages")).alias("n"), F.sha2(F.array_join(lines, "|"), 256).alias("digest")
    )


_CHANGES = _EXCHANGES + """, acts AS (SELECT conv_id * 1000 + turn AS seq, 's' || conv_id % 25 AS session_id, CASE turn WHEN 1 THEN 'rename' WHEN 3 THEN 'delete'
  WHEN 5 THEN 'create' WHEN 7 THEN 'create_session' ELSE 'rename' END AS action, CASE WHEN turn IN (5, 7) THEN 'n' || conv_id || '-' || turn WHEN turn = 4 THEN NULL
  WHEN turn = 3 AND conv_id % 3 > 0 THEN 'none' ELSE 'c' || conv_id END AS chat_id,
  CASE WHEN turn = 2 THEN '  ' WHEN turn IN (5, 7) AND conv_id % 2 = 0 THEN '' ELSE ' T' || turn || text || ' ' END AS title, 1800000000 + turn AS timestamp
  FROM conversations)"""


def changes(spark, d):
    i, t = F.col("conv_id"), F.col("turn")
    action = F.when(t == 3, "delete").when(t == 5, "create").when(t == 7, "create_session").otherwise("rename")
    own = F.concat(F.lit("c"), i.cast("string"))
    new = F.concat(F.lit("n"), i.cast("string"), F.lit("-"), t.cast("string"))
    chat = F.when(t.isin(5, 7), new).when(t == 4, None).when((t == 3) & (i % 3 > 0), "none").otherwise(own)
    title = F.when(t == 2, "  ").when(t.isin(5, 7) & (i % 2 == 0), "").otherwise(F.concat(F.lit(" T"), t.cast("string"), F.col("text"), F.lit(" ")))
    return table(spark, d, "conversations").select(
        (i * 1000 + t).alias("seq"), F.concat(F.lit("s"), (i % 25).cast("string")).alias("session_id"), action.alias("action"),
        chat.alias("chat_id"), title.alias("title"), (1800000000 + t).alias("timestamp"),
    )


@query(
    "apply_chat_changes",
    "WITH " + _CHANGES + """, newest AS (SELECT session_id, arg_min(chat_id, {'a': -coalesce(updated_at, 0), 'c': chat_id}) AS nc FROM chats GROUP BY ALL),
a AS (SELECT seq, session_id, action, CASE WHEN chat_id IS NULL AND action = 'rename' THEN nc ELSE chat_id END AS chat_id,
  nullif(regexp_replace(title, '^\\s+|\\s+$', '', 'g'), '') AS title, timestamp FROM acts LEFT JOIN newest USING (session_id)),
cr AS (SELECT *, (SELECT count(*) FROM chats c WHERE c.session_id = a.session_id) + row_number() OVER (PARTITION BY session_id ORDER BY seq) AS no
  FROM a WHERE action = 'create'),
cs AS (SELECT *, CASE WHEN title IS NULL THEN (SELECT coalesce(max(CASE WHEN regexp_extract(title, '^Cuộc trò chuyện.*\\s(\\d+)\\s*$', 1) <> '' THEN
  regexp_extract(title, '^Cuộc trò chuyện.*\\s(\\d+)\\s*$', 1)::BIGINT WHEN trim(title) = 'Cuộc trò chuyện' THEN 1 END), 0) FROM chats) +
  row_number() OVER (PARTITION BY title IS NULL ORDER BY seq) END AS no FROM a WHERE action = 'create_session'),
made AS (SELECT session_id, chat_id, coalesce(title, 'Cuộc trò chuyện ' || no) AS title, timestamp FROM (SELECT * FROM cr UNION ALL SELECT * FROM cs)),
base AS (SELECT session_id, chat_id, title, created_at, updated_at FROM chats UNION ALL SELECT session_id, chat_id, title, timestamp, timestamp FROM made),
ren AS (SELECT session_id, chat_id, arg_max(title, seq) FILTER (title IS NOT NULL) AS nt, arg_max(timestamp, seq) AS na FROM a WHERE action = 'rename' GROUP BY ALL)
SELECT session_id, chat_id, coalesce(nt, title) AS title, created_at, coalesce(na, updated_at) AS updated_at FROM base LEFT JOIN ren USING (session_id, chat_id)
WHERE (session_id, chat_id) NOT IN (SELECT (session_id, chat_id) FROM a WHERE action = 'delete')""",
)
def _(spark, d):
    return ch.apply_chat_changes(chats(spark, d), changes(spark, d))


@query(
    "apply_chat_changes_in_order",
    "WITH " + _CHANGES + """, a AS (SELECT seq, session_id, action, chat_id, nullif(regexp_replace(title, '^\\s+|\\s+$', '', 'g'), '') AS title, timestamp AS ts FROM acts),
ev AS (SELECT -1::BIGINT AS seq, 'base' AS action, session_id, chat_id, title, updated_at AS ts FROM chats UNION ALL
  SELECT seq, action, session_id, chat_id, title, ts FROM a WHERE chat_id IS NOT NULL),
lf AS (SELECT *, coalesce(last_value(CASE action WHEN 'delete' THEN false WHEN 'rename' THEN NULL ELSE true END IGNORE NULLS) OVER
    (PARTITION BY session_id, chat_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS alive,
  coalesce(min(CASE WHEN action = 'delete' THEN seq END) OVER
    (PARTITION BY session_id, chat_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 9000000000000000000) AS ends FROM ev),
ef AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq, CASE WHEN action = 'base' THEN coalesce(ts, 0) END, chat_id DESC) AS place,
  CASE WHEN action = 'delete' THEN -1 WHEN action = 'rename' OR alive THEN 0 ELSE 1 END AS delta FROM lf WHERE alive OR action NOT IN ('rename', 'delete')),
implied AS (SELECT u.seq, u.action, u.session_id, arg_max(e.chat_id, e.place) AS chat_id, any_value(u.title) AS title, any_value(u.ts) AS ts FROM a u JOIN ef e
  ON e.session_id = u.session_id AND e.action <> 'delete' AND e.seq < u.seq AND e.ends > u.seq WHERE u.chat_id IS NULL AND u.action = 'rename' GROUP BY ALL),
told AS (SELECT seq, action, session_id, chat_id, CASE WHEN action = 'create' THEN coalesce(title, 'Cuộc trò chuyện ' || (1 + coalesce(sum(delta) OVER
    (PARTITION BY session_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) ELSE title END AS title, ts FROM ef
  UNION ALL SELECT seq, action, session_id, chat_id, title, ts FROM implied),
num AS (SELECT *, coalesce(max(CASE WHEN action = 'delete' THEN NULL WHEN regexp_extract(title, '^Cuộc trò chuyện.*\\s(\\d+)\\s*$', 1) <> '' THEN
    try_cast(regexp_extract(title, '^Cuộc trò chuyện.*\\s(\\d+)\\s*$', 1) AS BIGINT) WHEN trim(title) = 'Cuộc trò chuyện' THEN 1 END) OVER
  (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top FROM told),
wait AS (SELECT seq, top, row_number() OVER (ORDER BY seq) AS k FROM num WHERE action = 'create_session' AND title IS NULL),
given AS (SELECT seq, k + 1 + max(top - k) OVER (ORDER BY seq) AS no FROM wait),
full_ AS (SELECT t.* REPLACE (coalesce(title, 'Cuộc trò chuyện ' || no) AS title) FROM told t LEFT JOIN given USING (seq)),
born AS (SELECT session_id, chat_id, arg_max(title, seq) FILTER (title IS NOT NULL AND action <> 'delete') AS title, arg_max(ts, seq) FILTER (action <> 'delete') AS updated_at,
  arg_max(action, seq) FILTER (action NOT IN ('rename', 'delete')) AS birth, arg_max(ts, seq) FILTER (action NOT IN ('rename', 'delete')) AS born_at,
  arg_max(action, seq) FILTER (action <> 'rename') AS last_life FROM full_ GROUP BY ALL)
SELECT b.session_id, b.chat_id, b.title, CASE WHEN birth = 'base' THEN c.created_at ELSE born_at END AS created_at, b.updated_at
FROM born b LEFT JOIN chats c USING (session_id, chat_id) WHERE last_life <> 'delete'""",
)
def _(spark, d):
    return cc.apply_chat_changes_in_order(chats(spark, d), changes(spark, d))


@query(
    "resolve_chat",
    f"WITH {_EXCHANGES}, newest AS (SELECT session_id, arg_min(chat_id, {{'a': -coalesce(updated_at, 0), 'c': chat_id}}) AS nc FROM chats GROUP BY ALL), "
    "q AS (SELECT conv_id, turn, 's' || conv_id % 30 AS session_id, CASE turn % 3 WHEN 0 THEN ' c' || conv_id || ' ' WHEN 1 THEN ' ' ELSE 'zz' END AS chat_id FROM conversations) "
    "SELECT q.conv_id, q.turn, r AS resolved_chat_id, r IS NULL AS must_create FROM (SELECT q.*, CASE turn % 3 WHEN 0 THEN c.chat_id WHEN 1 THEN nc END AS r "
    "FROM q LEFT JOIN chats c ON c.session_id = q.session_id AND c.chat_id = trim(q.chat_id) LEFT JOIN newest n ON n.session_id = q.session_id) q",
)
def _(spark, d):
    i, t = F.col("conv_id"), F.col("turn")
    chat = F.when(t % 3 == 0, F.concat(F.lit(" c"), i.cast("string"), F.lit(" "))).when(t % 3 == 1, " ").otherwise("zz")
    q = table(spark, d, "conversations").select(
        "conv_id", "turn", F.concat(F.lit("s"), (i % 30).cast("string")).alias("session_id"), chat.alias("chat_id")
    )
    return ch.resolve_chat(q, chats(spark, d)).select("conv_id", "turn", "resolved_chat_id", "must_create")


_SUMMARY = f"""WITH {_EXCHANGES}, {_MANIFEST}, ss AS (SELECT DISTINCT 's' || doc_id % 40 AS session_id FROM documents),
counted AS (SELECT c.*, (SELECT count(*) FROM conversations v WHERE v.conv_id = c.conv_id) AS message_count FROM chats c),
nw AS (SELECT session_id, unnest(arg_min(counted, {{'a': -coalesce(updated_at, 0), 'c': chat_id}}), max_depth := 2) FROM counted GROUP BY session_id),
dc AS (SELECT session_id, count(*) AS doc_count, min(doc) AS fd FROM manifest GROUP BY ALL)
SELECT ss.session_id, coalesce(nullif(n.title, ''), fd, 'Phiên ' || left(ss.session_id, 6)) AS title, n.created_at, n.updated_at,
  coalesce(n.message_count, 0) AS message_count, n.chat_id, coalesce(doc_count, 0) AS doc_count
FROM ss LEFT JOIN (SELECT DISTINCT ON (session_id) * FROM counted ORDER BY session_id, coalesce(updated_at, 0) DESC, chat_id) n USING (session_id)
LEFT JOIN dc USING (session_id)"""
_SUMMARY = _SUMMARY.replace(_SUMMARY[_SUMMARY.index("nw AS"):_SUMMARY.index("dc AS")], "")


def _sessions(spark, d):
    return table(spark, d, "documents").select(F.concat(F.lit("s"), (F.col("doc_id") % 40).cast("string")).alias("session_id")).distinct()


def _counted(spark, d):
    return ch.list_chats(chats(spark, d), log(spark, d, _EVERY)).drop("title").join(chats(spark, d).select("chat_id", "title"), "chat_id")


@query("session_summary", _SUMMARY)
def _(spark, d):
    return se.session_summary(_sessions(spark, d), _counted(spark, d), manifest(spark, d))


@query("list_sessions", _SUMMARY)
def _(spark, d):
    return se.list_sessions(_sessions(spark, d), _counted(spark, d), manifest(spark, d))


_FILES = "files AS (SELECT 's' || doc_id % 10 AS session_id, 'src' || doc_id % 25 || '.pdf' AS name, sum(n_chars)::BIGINT AS size FROM documents GROUP BY ALL)"


def _files(spark, d):
    i = F.col("doc_id")
    return table(spark, d, "documents").groupBy(
        F.concat(F.lit("s"), (i % 10).cast("string")).alias("session_id"), F.concat(F.lit("src"), (i % 25).cast("string"), F.lit(".pdf")).alias("filename")
    ).agg(F.sum("n_chars").alias("size"))


@query(
    "session_files",
    f"WITH {_MANIFEST}, {_FILES} SELECT f.session_id, f.name, f.size, coalesce(pages, 0) AS pages, coalesce(chunks, 0) AS chunks, "
    "CASE WHEN m.doc IS NULL THEN 'uploaded' ELSE 'ingested' END AS status, upload_timestamp::DOUBLE AS upload_timestamp, "
    "coalesce(document_status, 'active') AS document_status, coalesce(version, 1) AS document_version, message AS status_message "
    "FROM files f LEFT JOIN manifest m ON m.session_id = f.session_id AND m.doc = f.name",
)
def _(spark, d):
    return se.session_files(_files(spark, d), manifest(spark, d))


@query(
    "session_snapshot",
    f"WITH {_MANIFEST}, {_FILES}, ss AS (SELECT DISTINCT 's' || doc_id % 40 AS session_id FROM documents), vc AS (SELECT DISTINCT 's' || label % 7 AS session_id FROM embeddings), "
    "fc AS (SELECT f.session_id, count(m.doc) AS n_ingested, count(*) AS n_files FROM files f LEFT JOIN manifest m ON m.session_id = f.session_id AND m.doc = f.name GROUP BY ALL) "
    "SELECT session_id, coalesce(n_ingested, 0) AS n_ingested, coalesce(n_files, 0) AS n_files, session_id IN (SELECT session_id FROM vc) AS has_vectors, "
    "session_id IN (SELECT session_id FROM vc) AND coalesce(n_files, 0) > 0 AS can_ask FROM ss LEFT JOIN fc USING (session_id)",
)
def _(spark, d):
    vectors = table(spark, d, "embeddings").select(F.concat(F.lit("s"), (F.col("label") % 7).cast("string")).alias("session_id"))
    return se.session_snapshot(_sessions(spark, d), _files(spark, d), manifest(spark, d), vectors)


@query(
    "last_sourced_answer",
    f"WITH {_EXCHANGES} SELECT chat_id, max(turn) AS page FROM ex WHERE turn % 4 = 0 GROUP BY ALL",
)
def _(spark, d):
    s = ch.last_sourced_answer(ch.append_exchange(log(spark, d), exchanges(spark, d)))
    return s.select("chat_id", big(F.get("sources", F.lit(0))["page"]).alias("page"))


@query(
    "doc_summary",
    _REG + ", pgs AS (SELECT source AS doc_id, count(*) AS pages, count(*) FILTER (doc_id % 3 > 0) AS chunks FROM documents GROUP BY source) "
    "SELECT doc_id || '.pdf' AS doc, pages, chunks, result AS status, status AS document_status, version, upload_timestamp FROM pgs JOIN "
    "(SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY status = 'active' DESC, version DESC) AS rn FROM registry) USING (doc_id) WHERE rn = 1",
)
def _(spark, d):
    pages = text_chunks(spark, d).withColumn("session_id", F.lit(""))
    current = v.document_metadata(v.register(uploads(spark, d)))
    s = se.doc_summary(pages, pages.filter("chunk_key % 3 > 0"), current)
    return s.select("doc", "pages", "chunks", "status", "document_status", "version", "upload_timestamp")


_MERGE = f"WITH {_MANIFEST}, nw AS (SELECT * REPLACE (chunks * 2 AS chunks) FROM manifest WHERE upload_timestamp % 2 = 0), merged AS (SELECT m.session_id, m.doc, coalesce(n.chunks, m.chunks) AS chunks FROM manifest m LEFT JOIN nw n USING (session_id, doc))"


def _merged(spark, d):
    m = manifest(spark, d)
    return se.merge_manifest(m, m.filter("upload_timestamp % 2 = 0").withColumn("chunks", F.col("chunks") * 2))


@query("merge_manifest", _MERGE + " SELECT * FROM merged")
def _(spark, d):
    return _merged(spark, d).select("session_id", "doc", "chunks")


@query("manifest_totals", _MERGE + " SELECT session_id, count(*) AS n_docs, sum(chunks)::BIGINT AS total_chunks FROM merged GROUP BY ALL")
def _(spark, d):
    return se.manifest_totals(_merged(spark, d))


# Answer cache, filled from the exchanges.
_ACACHE = _EXCHANGES + r""", keyed AS (SELECT *, lower(trim(regexp_replace(question, '\s+', ' ', 'g'))) || '||b' || conv_id % 5 AS k FROM ex)"""


def _keyed(spark, d):
    e = exchanges(spark, d).withColumnRenamed("question", "query_text")
    return an.with_answer_key(e.withColumn("docs", F.array(F.concat(F.lit("b"), (F.col("conv_id") % 5).cast("string")))))


def _answer_cache(spark, d, where):
    k = _keyed(spark, d).filter(where).withColumnRenamed("timestamp", "ts").withColumnRenamed("sources", "citations")
    rows = k.select("k", "answer", "confidence", "citations", "ts")
    return an.cache_put(rows.limit(0), rows)


@query("cache_probe", f"WITH {_ACACHE} SELECT q.seq, c.answer, q.k IN (SELECT k FROM keyed WHERE conv_id % 3 > 0) AS hit FROM keyed q LEFT JOIN (SELECT k, arg_max(answer, timestamp) AS answer FROM keyed WHERE conv_id % 3 > 0 GROUP BY k) c USING (k)")
def _(spark, d):
    asked, cache = _keyed(spark, d).select("seq", "k"), _answer_cache(spark, d, "conv_id % 3 > 0")
    hits = an.cache_hits(asked, cache).select("seq", "answer", F.lit(True).alias("hit"))
    misses = an.cache_misses(asked, cache).select("seq", F.lit(None).cast("string").alias("answer"), F.lit(False).alias("hit"))
    return hits.unionByName(misses)


@query("cache_put", f"WITH {_ACACHE} SELECT k, arg_max(answer, timestamp) AS answer, max(timestamp) AS ts FROM keyed GROUP BY k")
def _(spark, d):
    s = an.cache_put(_answer_cache(spark, d, "conv_id % 2 = 0 AND turn < 2"), _answer_cache(spark, d, "true"))
    return s.select("k", "answer", "ts")
