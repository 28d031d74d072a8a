"""The user-facing flows: ingest, ask, finish, evaluate.

Each takes and returns tables for many documents or questions at once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from trawl.functions import fixed_values as fv
from trawl.functions.text import normalize_session_id, question_error, strip
from trawl.operators import answers as an, chats as ch, citations as ct, embedding as em, ops, passages as ps
from trawl.operators import retrieve, sessions as se, versions as v
from trawl.operators.chunks import chunk_pages
from trawl.operators.pages import clean_pages, document_digests
from trawl.session import stage, stage_table, with_session


@dataclass
class Ingested:
    chunks: DataFrame
    registry: DataFrame
    results: DataFrame
    manifest: DataFrame
    skipped: DataFrame
    cache: DataFrame
    statistics: DataFrame


def document_uploads(pages: DataFrame, files: DataFrame) -> DataFrame:
    """One upload per file with hashes of its cleaned text; ``content_hash`` is the SHA-256 of the document text."""
    doc = ["session_id", "doc_name"]
    content = document_digests(pages).drop("n_chars")
    n_pages = pages.groupBy(*doc).agg(F.countDistinct("page").alias("page_count"))
    hashes = v.simhash128(pages, doc)
    joined = files.join(hashes, doc).join(content, doc).join(n_pages, doc)
    return joined.withColumnRenamed("doc_name", "filename")


def ingest(
    pages: DataFrame, files: DataFrame, registered: DataFrame | None, manifest: DataFrame, cache: DataFrame,
    embed: em.EmbedBatch, size: int = fv.CHUNK_SIZE, overlap: int = fv.CHUNK_OVERLAP, skip_duplicates: bool = False,
) -> Ingested:
    """New documents to chunks with vectors, fingerprints and manifest rows.

    ``pages``: session_id, doc_name, page, text. ``files``: session_id, doc_name,
    reg (unique upload order), file_hash, upload_timestamp. ``registered``:
    earlier uploads in the columns of ``uploads`` below, or None. Documents
    already in the manifest are skipped. Duplicates are chunked all the same
    unless ``skip_duplicates``.
    """
    pages, files = with_session(pages), with_session(files)
    new_files, skipped = se.split_new_documents(files, manifest)
    doc = ["session_id", "doc_name"]
    new_files = stage_table(new_files)
    cleaned = stage_table(clean_pages(pages.join(new_files.select(*doc), doc, "left_semi")))
    columns = [
        "session_id", "reg", "filename", "file_hash", "content_hash", "hi", "lo", "upload_timestamp", "page_count",
    ]
    fresh = stage(document_uploads(cleaned, new_files).select(*columns))
    uploads = fresh if registered is None else registered.select(*columns).unionByName(fresh)
    registry = stage(v.register(uploads))
    results = v.upload_results(uploads, registry).join(fresh.select("reg", "session_id"), "reg")
    current = v.document_metadata(registry).select(
        "session_id", "doc_id", F.col("status").alias("document_status"), F.col("version").alias("document_version"), "upload_timestamp"
    )
    wanted = results.withColumn("doc_id", v.stem(F.col("filename"))).join(current, ["session_id", "doc_id"])
    if skip_duplicates:
        wanted = wanted.filter("result <> 'duplicate'")
    state = wanted.select(
        "session_id", F.col("filename").alias("doc_name"), "result", "message", "upload_timestamp", "document_status", "document_version"
    )
    pieces = stage_table(
        chunk_pages(cleaned, size, overlap).join(
            state.select(*doc, "upload_timestamp", "document_status", "document_version"), doc
        )
    )
    chunks, grown = em.embed_column(pieces, cache, embed)
    docs = se.doc_summary(
        cleaned.join(state.select(*doc), doc, "left_semi"), pieces,
        state.select(
            "session_id", F.col("doc_name").alias("filename"), "result", "message", "upload_timestamp",
            F.col("document_status").alias("status"), F.col("document_version").alias("version"),
        ),
    )
    counts = pieces.groupBy(*doc).agg(F.count(F.lit(1)).alias("chunk_count"))
    per_upload = registry.select("reg", "session_id", F.col("filename").alias("doc_name")).join(counts, doc).select("reg", "chunk_count")
    return Ingested(
        chunks, registry, results, se.merge_manifest(manifest.select(*docs.columns), docs), skipped, grown,
        v.document_statistics(registry, per_upload),
    )


@dataclass
class Asked:
    invalid: DataFrame
    hits: DataFrame
    context: DataFrame
    prompts: DataFrame
    unanswered: DataFrame


def ask(
    questions: DataFrame, chunks: DataFrame, answer_cache: DataFrame, as_of: float, embed: em.EmbedBatch | None = None,
    embed_cache: DataFrame | None = None, hybrid: bool = True, model_score=None, k: int = fv.TOP_K, alpha: float = fv.HYBRID_ALPHA,
    mmr_lambda: float = fv.MMR_LAMBDA, recency_weight: float = fv.RECENCY_WEIGHT, recency_mode: str = "exponential",
) -> Asked:
    """Questions to prompts: validate, probe the cache, retrieve, rerank, gate.

    ``questions``: query_id, query_text, session_id, docs (all documents of the
    session, for the cache key), selected (document filter as text), and vec
    unless ``embed`` is given. ``chunks``: session_id, chunk_key, doc_name, page,
    chunk_id, text, vec, upload_timestamp. Each session, and each document
    filter in it, is a scope of its own. ``model_score`` maps passages to a
    frame with a model_score column; None keeps the retrieval order.
    """
    checked = questions.withColumn("error", question_error(F.col("query_text"), F.col("session_id")))
    invalid = checked.filter("error IS NOT NULL").select("query_id", "error")
    valid = checked.filter("error IS NULL").drop("error").withColumns(
        {"query_text": strip(F.col("query_text")), "session_id": normalize_session_id(F.col("session_id"))}
    )
    keyed = an.with_answer_key(valid)
    hits = an.cache_hits(keyed, answer_cache).select("query_id", "answer", "confidence", "citations")
    open_ = an.cache_misses(keyed, answer_cache)
    if embed is not None:
        open_, _ = em.embed_column(open_.withColumn("text", F.col("query_text")), embed_cache, embed)
        open_ = open_.drop("text")
    allowed = retrieve.parse_allowed(F.col("selected"))
    scoped = stage(
        open_.withColumn("_allowed", allowed).withColumn(
            "scope", F.concat_ws("|", "session_id", F.coalesce(F.array_join("_allowed", "|"), F.lit("*")))
        )
    )
    scopes = stage_table(scoped.select("scope", "session_id", "_allowed").distinct())
    whole = scopes.filter("_allowed IS NULL").drop("_allowed")
    named = scopes.select("scope", "session_id", F.explode("_allowed").alias("doc_name"))
    # The chunks are read for kinds of scopes that are there only.
    own = None if named.isEmpty() else chunks.join(named, ["session_id", "doc_name"])
    if own is None or not whole.isEmpty():
        own = chunks.join(whole, "session_id") if own is None else chunks.join(whole, "session_id").unionByName(own)
    asked = scoped.select("scope", "query_id", "query_text", "vec")
    if hybrid:
        best = retrieve.score_scoped(asked, own, as_of, max(3 * k, k), alpha, recency_weight, recency_mode)
        found = retrieve.pick_and_describe(best, chunks, k, mmr_lambda)
    else:
        everything = chunks.withColumn("scope", F.col("session_id"))
        by_session = scoped.select(F.col("session_id").alias("scope"), "query_id", "query_text", "vec", "_allowed")
        found = retrieve.search_scoped(by_session.drop("_allowed"), everything, k, mmr_lambda)
        found = found.join(by_session.select("query_id", "_allowed"), "query_id").filter(
            F.col("_allowed").isNull() | F.array_contains(F.col("_allowed"), F.col("doc_name"))
        ).drop("_allowed")
    found = stage(found.join(asked.select("query_id", "query_text"), "query_id"))
    limit = F.least(ps.context_size(F.col("query_text")), F.lit(k))
    if model_score is None:
        ranked = ps.rerank_topk(found, limit)
    else:
        ranked = ps.rerank_topk(model_score(found), limit, "model_score")
    kept = ps.gate_passages(ranked)
    context = stage(ps.context_topk(kept))
    prompts = ps.build_prompt(asked.select("query_id", "query_text"), ps.build_context(context))
    return Asked(invalid, hits, context, prompts, ps.no_answer(asked.select("query_id", "query_text"), context))


@dataclass
class Finished:
    sources: DataFrame
    confidence: DataFrame
    log: DataFrame
    chats: DataFrame
    answer_cache: DataFrame


def settle_chats(questions: DataFrame, chats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(questions with a chat_id that exists, chats with the new ones).

    ``questions``: query_id, session_id, chat_id (NULL for none), seq, ts. A known
    chat is used, none means the session's newest. Questions that need a new chat
    share one per session and wanted id; it is named after the first of them.
    """
    found = stage(ch.resolve_chat(questions, chats))
    want = F.coalesce(strip(F.col("chat_id")), F.lit(""))
    missing = found.filter("must_create").withColumn("_want", want)
    first = missing.groupBy("session_id", "_want").agg(F.min_by(F.struct("query_id", "seq", "ts"), "seq").alias("q"))
    made = F.concat(F.lit("chat-"), F.col("q.query_id").cast("string"))
    made = stage(first.select("session_id", "_want", made.alias("_made"), "q.seq", "q.ts"))
    creates = made.select(
        "seq", F.lit("create").alias("action"), "session_id", F.col("_made").alias("chat_id"), F.lit(None).cast("string").alias("title"), F.col("ts").alias("timestamp")
    )
    settled = found.withColumn("_want", want).join(made.select("session_id", "_want", "_made"), ["session_id", "_want"], "left")
    chosen = F.when(F.col("must_create"), F.col("_made")).otherwise(F.col("resolved_chat_id"))
    return settled.withColumn("chat_id", chosen).select(*questions.columns), ch.apply_chat_changes(chats, creates)


def finish(
    answers: DataFrame, context: DataFrame, log: DataFrame, chats: DataFrame, answer_cache: DataFrame,
    hits: DataFrame | None = None, unanswered: DataFrame | None = None,
) -> Finished:
    """Answers to sources, confidence, chat log and answer cache.

    ``answers``: generated ones, query_id, session_id, chat_id, seq, query_text,
    answer, docs, ts; ``context``: the passages they were made from. ``hits`` from
    the answer cache (the same without docs, and confidence, citations) and
    ``unanswered`` apologies (the same without docs) go to the chat log as well,
    apologies without sources and with confidence 0. Only generated answers
    enter the answer cache.
    """
    matched = ct.match_sources(context, ct.cited_ranges(answers))
    sources = ct.source_rows(matched)
    confidence = ps.answer_confidence(context)
    record = [c for c in sources.columns if c not in ("query_id", "place")]
    nested = sources.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", F.struct(*record).alias("s")))).alias("o"))
    nested = nested.select("query_id", F.col("o.s").alias("sources"))
    done = answers.join(nested, "query_id", "left").join(confidence, "query_id", "left")
    done = stage(done.withColumn("confidence", F.coalesce("confidence", F.lit(0.0))))
    exchanges = done.select(
        "session_id", "chat_id", "seq", F.col("query_text").alias("question"), "answer", "sources", "confidence", F.col("ts").alias("timestamp")
    )
    columns = ["session_id", "chat_id", "seq", F.col("query_text").alias("question"), "answer"]
    source_type = log.schema["sources"].dataType
    exchanges = exchanges.withColumn("sources", F.col("sources").cast(source_type))
    if hits is not None:
        exchanges = exchanges.unionByName(hits.select(*columns, F.col("citations").cast(source_type).alias("sources"), "confidence", F.col("ts").alias("timestamp")))
    if unanswered is not None:
        none = F.array().cast(source_type).alias("sources")
        exchanges = exchanges.unionByName(unanswered.select(*columns, none, F.lit(0.0).alias("confidence"), F.col("ts").alias("timestamp")))
    exchanges = stage(exchanges)
    cited = answer_cache.schema["citations"].dataType
    answered = an.with_answer_key(done).select(
        "k", "answer", "confidence", F.coalesce("sources", F.array().cast(nested.schema["sources"].dataType)).cast(cited).alias("citations"), "ts"
    )
    return Finished(
        sources, done.select("query_id", "confidence"), ch.append_exchange(log, exchanges), ch.auto_title(chats, log, exchanges),
        an.cache_put(answer_cache.select(*answered.columns), answered),
    )


def evaluate(cases: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(report, results) of cases (q, expected) against answers (q, answer, confidence, latency_ms)."""
    results = ops.match_keywords(cases.join(answers, "q", "left")).withColumn(
        "status", F.when(F.col("answer").isNull(), "ERROR").when(F.col("matched"), "PASS").otherwise("FAIL")
    )
    return ops.eval_report(results), results
