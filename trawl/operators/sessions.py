"""Session summaries and snapshots, document summaries and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trawl.functions import fixed_values as fv
from trawl.operators.chats import newest_chat
from trawl.sources.tables import upsert


def session_summary(sessions: DataFrame, chats: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row per session from its newest chat and its documents.

    ``chats`` carries message_count; ``manifest`` has a row per document.
    """
    newest = newest_chat(chats).select("session_id", "chat_id", "title", "created_at", "updated_at", "message_count")
    docs = manifest.groupBy("session_id").agg(F.count(F.lit(1)).alias("doc_count"), F.min("doc").alias("_first_doc"))
    short = F.concat(F.lit(fv.SESSION_TITLE_PREFIX), F.substring("session_id", 1, 6))
    return (
        sessions.select("session_id").distinct()
        .join(newest, "session_id", "left").join(docs, "session_id", "left")
        .select(
            "session_id", F.coalesce(F.nullif("title", F.lit("")), "_first_doc", short).alias("title"), "created_at", "updated_at",
            F.coalesce("message_count", F.lit(0)).alias("message_count"), "chat_id",
            F.coalesce("doc_count", F.lit(0)).alias("doc_count"),
        )
    )


def list_sessions(sessions: DataFrame, chats: DataFrame, manifest: DataFrame) -> DataFrame:
    summary = session_summary(sessions, chats, manifest)
    return summary.orderBy(F.coalesce("updated_at", F.lit(0)).desc(), "session_id")


def session_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Uploaded files with what the manifest knows of them, defaults filled."""
    known = manifest.select(
        "session_id", F.col("doc").alias("name"), F.col("pages").alias("_pages"), F.col("chunks").alias("_chunks"),
        "upload_timestamp", F.col("document_status").alias("_doc_status"), F.col("version").alias("_version"),
        F.col("message").alias("status_message"), F.lit(True).alias("_known"),
    )
    return files.select("session_id", F.col("filename").alias("name"), "size").join(known, ["session_id", "name"], "left").select(
        "session_id", "name", "size",
        F.coalesce("_pages", F.lit(0)).alias("pages"), F.coalesce("_chunks", F.lit(0)).alias("chunks"),
        F.when(F.col("_known"), "ingested").otherwise("uploaded").alias("status"), "upload_timestamp",
        F.coalesce("_doc_status", F.lit("active")).alias("document_status"),
        F.coalesce("_version", F.lit(1)).alias("document_version"), "status_message",
    )


def session_snapshot(sessions: DataFrame, files: DataFrame, manifest: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per session: file counts by status, has_vectors and can_ask."""
    counts = session_files(files, manifest).groupBy("session_id").agg(
        F.count_if(F.col("status") == "ingested").alias("n_ingested"), F.count(F.lit(1)).alias("n_files")
    )
    vectors = chunks.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_vectors"))
    has_vectors = F.coalesce("n_vectors", F.lit(0)) > 0
    n_files = F.coalesce("n_files", F.lit(0))
    return (
        sessions.select("session_id").distinct().join(counts, "session_id", "left").join(vectors, "session_id", "left")
        .select(
            "session_id", F.coalesce("n_ingested", F.lit(0)).alias("n_ingested"), n_files.alias("n_files"),
            has_vectors.alias("has_vectors"), (has_vectors & (n_files > 0)).alias("can_ask"),
        )
    )


def doc_summary(pages: DataFrame, chunks: DataFrame, registry: DataFrame) -> DataFrame:
    """Manifest rows: page and chunk counts joined with the registration result.

    ``registry``: session_id, filename, result, message, upload_timestamp, status, version.
    """
    doc = ["session_id", "doc_name"]
    n_pages = pages.groupBy(*doc).agg(F.countDistinct("page").alias("pages"))
    n_chunks = chunks.groupBy(*doc).agg(F.count(F.lit(1)).alias("chunks"))
    state = registry.select(
        "session_id", F.col("filename").alias("doc_name"), F.col("result").alias("status"), "message", "upload_timestamp",
        F.col("status").alias("document_status"), "version",
    )
    return n_pages.join(n_chunks, doc, "left").join(state, doc, "left").select(
        "session_id", F.col("doc_name").alias("doc"), "pages", F.coalesce("chunks", F.lit(0)).alias("chunks"), "status", "message",
        "upload_timestamp", "document_status", "version",
    )


def merge_manifest(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Documents of both by name, new rows winning, in name order."""
    return upsert(existing, new, ["session_id", "doc"]).orderBy("session_id", "doc")


def manifest_totals(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("chunks").alias("total_chunks"))


def split_new_documents(files: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new, skipped): files not yet in the manifest, and those already there, by name."""
    known = manifest.select("session_id", F.col("doc").alias("doc_name")).distinct()
    key = ["session_id", "doc_name"]
    return files.join(known, key, "left_anti"), files.join(known, key, "left_semi")
