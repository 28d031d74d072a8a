"""Files: upload scan and checks, chunk items, fingerprints, manifests."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trawl.functions import fixed_values as fv
from trawl.functions.text import sanitize_filename

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes at the start of a file in which its signature must be.
HEAD_BYTES = 4096
ITEM_SCHEMA = (
    "meta STRUCT<doc: STRING, page: INT, chunk_id: INT, filename: STRING, start_token: INT, end_token: INT, "
    "semantic_chunk: BOOLEAN, upload_timestamp: DOUBLE, document_status: STRING, document_version: INT>, text STRING"
)
FINGERPRINT = (
    "STRUCT<filename: STRING, file_hash: STRING, content_hash: STRING, semantic_hash: STRING, upload_timestamp: DOUBLE, "
    "page_count: INT, chunk_count: INT, chunk_ids: ARRAY<STRING>, status: STRING, version: INT, "
    "supersedes: ARRAY<STRING>, superseded_by: STRING>"
)
FINGERPRINT_FIELDS = [
    "filename", "file_hash", "content_hash", "semantic_hash", "upload_timestamp", "page_count", "chunk_count", "chunk_ids",
    "status", "version", "supersedes", "superseded_by",
]
MANIFEST_DOC = (
    "STRUCT<doc: STRING, pages: INT, chunks: BIGINT, status: STRING, message: STRING, upload_timestamp: DOUBLE, "
    "document_status: STRING, version: INT>"
)
MANIFEST_SCHEMA = (
    f"session_id STRING, part BIGINT, docs ARRAY<{MANIFEST_DOC}>, total_chunks BIGINT, ts BIGINT, ocr BOOLEAN, chunk_size INT, chunk_overlap INT, "
    "document_stats STRUCT<total_documents: BIGINT, active_documents: BIGINT, superseded_documents: BIGINT>"
)
PART_ROWS = 10_000


def scan_files(spark: SparkSession, folder: str, names: str = "*.[pP][dD][fF]") -> DataFrame:
    """Files below ``folder``: session_id (parent folder), filename, size, content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", names).option("recursiveFileLookup", "true").load(folder)
    parts = F.split("path", "/")
    return files.select(
        F.element_at(parts, -2).alias("session_id"), F.element_at(parts, -1).alias("filename"),
        F.col("length").alias("size"), "content",
    )


def scan_heads(
    spark: SparkSession, folder: str, names: str = "*.[pP][dD][fF]", where: Column | None = None, head_bytes: int = HEAD_BYTES,
    partitions: int | None = None,
) -> DataFrame:
    """Files below ``folder``: session_id, filename, size, modified, head (the first bytes).

    Spark lists the files; tasks then open each and read ``head_bytes`` of it at
    most, so the work follows the number of files and not their sizes. ``where``
    is tested on session_id, filename, size and modified before a file is opened.
    Files are read by pyarrow, which must know their file system. A file that is
    gone by then has a null head. Spark lists no empty files, here as in `scan_files`.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", names).option("recursiveFileLookup", "true").load(folder)
    parts = F.split("path", "/")
    listed = files.select(
        F.element_at(parts, -2).alias("session_id"), F.element_at(parts, -1).alias("filename"), F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"), "path",
    )
    if where is not None:
        listed = listed.filter(where)
    # The listing is packed into partitions by the files' sizes; opening them is work per file.
    spread = listed.repartition(partitions, F.xxhash64("path")) if partitions else listed.repartition(F.xxhash64("path"))

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        systems: dict[str, fs.FileSystem] = {}
        for batch in batches:
            heads = []
            for uri in batch.column("path").to_pylist():
                scheme, authority, path = re.match("([^:]+):(?://([^/]*))?(.*)", uri, re.DOTALL).groups()
                root = f"{scheme}://{authority or ''}"
                if root not in systems:
                    systems[root] = fs.LocalFileSystem() if scheme == "file" else fs.FileSystem.from_uri(f"{root}/")[0]
                place = path if scheme in ("file", "hdfs") else f"{authority}{path}"
                try:
                    with systems[root].open_input_file(place) as file:
                        heads.append(file.read(head_bytes))
                except FileNotFoundError:
                    heads.append(None)
            kept = [batch.column(c) for c in ("session_id", "filename", "size", "modified")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(heads, pa.binary())], ["session_id", "filename", "size", "modified", "head"])

    return spread.mapInArrow(opened, "session_id string, filename string, size bigint, modified timestamp, head binary")


def validate_files(
    uploads: DataFrame, max_mb: int = fv.MAX_FILE_MB, max_files: int = fv.MAX_FILES, batch: str = "batch_id"
) -> DataFrame:
    """Annotate uploads (batch, filename, content_type, content) with safe_name and error.

    Instead of content, size and head (see `scan_heads`) will do. A NULL error
    means accepted. A batch with too many files is rejected whole.
    """
    whole = "content" in uploads.columns
    start, size = F.col("content" if whole else "head"), F.length("content") if whole else F.col("size")
    name, kind = F.lower(F.coalesce("filename", F.lit(""))), F.lower(F.coalesce("content_type", F.lit("")))
    head = F.decode(F.substring(start, 1, HEAD_BYTES), "ISO-8859-1")
    sizes = uploads.groupBy(batch).agg(F.count(F.lit(1)).alias("_files"))
    error = (
        F.when(F.col("_files") > max_files, fv.MSG_TOO_MANY.format(n=max_files))
        .when(~(kind.contains("pdf") | name.endswith(".pdf")), fv.MSG_NOT_PDF)
        .when((size > 0) & ~head.contains("%PDF"), fv.MSG_NO_SIGNATURE)
        .when(size > max_mb * 1024 * 1024, fv.MSG_TOO_LARGE.format(mb=max_mb))
    )
    return uploads.join(sizes, batch).withColumns(
        {"safe_name": sanitize_filename(F.coalesce("filename", F.lit(""))), "error": error}
    ).drop("_files")


def accepted(checked: DataFrame) -> DataFrame:
    return checked.filter("error IS NULL").drop("error")


def rejected(checked: DataFrame) -> DataFrame:
    return checked.filter("error IS NOT NULL")


def write_items(chunks: DataFrame, path: str, mode: str = "append") -> None:
    """Chunk metadata and text as JSON lines, partitioned by session."""
    meta = F.struct(
        F.col("doc_name").alias("doc"), F.col("page").cast("int").alias("page"), F.col("chunk_id").cast("int").alias("chunk_id"),
        F.col("doc_name").alias("filename"), F.lit(0).alias("start_token"), F.col("n_tokens").cast("int").alias("end_token"),
        F.lit(True).alias("semantic_chunk"), F.col("upload_timestamp").cast("double").alias("upload_timestamp"),
        F.col("document_status").alias("document_status"), F.col("document_version").cast("int").alias("document_version"),
    )
    chunks.select("session_id", meta.alias("meta"), "text").write.mode(mode).partitionBy("session_id").json(path)


def read_items(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(f"{ITEM_SCHEMA}, session_id STRING").json(path)
    return rows.select(
        "session_id", F.col("meta.doc").alias("doc_name"), "meta.page", "meta.chunk_id", "text",
        F.col("meta.end_token").alias("n_tokens"), "meta.upload_timestamp", "meta.document_status", "meta.document_version",
    )


def write_fingerprints(registry: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines {doc_id: [fingerprint, ...]} in version order.

    A document's versions go in parts of PART_ROWS, one line each below the folder
    of its part number, whatever the number of versions, so that no list grows
    without bound. Reading puts the parts side by side again.
    """
    fp = F.struct(*FINGERPRINT_FIELDS)
    part = F.floor((F.col("version") - 1) / PART_ROWS)
    lists = registry.groupBy("session_id", "doc_id", part.alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("version", fp.alias("fp")))).alias("v")
    )
    line = F.to_json(F.create_map("doc_id", F.col("v.fp")))
    lists.select("session_id", "part", line.alias("value")).write.mode(mode).partitionBy("session_id", "part").text(path)


def read_fingerprints(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """Registry rows from files of {doc_id: [fingerprint, ...]} objects.

    ``whole_files`` reads indented files that hold one object each.
    """
    lines = spark.read.text(path, wholetext=whole_files)
    objects = lines.withColumn("o", F.from_json("value", f"MAP<STRING, ARRAY<{FINGERPRINT}>>"))
    session = ["session_id"] if "session_id" in lines.columns else []
    lists = objects.select(*session, F.explode("o").alias("doc_id", "fps"))
    return lists.select(*session, "doc_id", F.explode("fps").alias("fp")).select(*session, "doc_id", "fp.*")


def nest_manifest(docs: DataFrame, ts: int, ocr: bool = False, chunk_size: int = fv.CHUNK_SIZE, chunk_overlap: int = fv.CHUNK_OVERLAP) -> DataFrame:
    """Manifest records: the documents of a session, sorted, nested in ``docs``, with the settings and the session's counts.

    Every record has a part number and holds about PART_ROWS documents, which a
    hash of the name picks; a session of fewer has one, part 0. Totals and counts
    are the session's in each record.
    """
    status = lambda s: F.count_if(F.col("document_status") == s)
    totals = docs.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("chunks").alias("total_chunks"), status("active").alias("_active"), status("superseded").alias("_superseded")
    )
    part = F.pmod(F.xxhash64("doc"), F.ceil(F.col("n") / PART_ROWS))
    record = F.struct(
        "doc", F.col("pages").cast("int").alias("pages"), F.col("chunks").cast("bigint").alias("chunks"), "status", "message",
        "upload_timestamp", "document_status", F.col("version").cast("int").alias("version"),
    )
    return (
        docs.join(totals, "session_id").groupBy("session_id", "total_chunks", "n", "_active", "_superseded", part.cast("bigint").alias("part"))
        .agg(F.array_sort(F.collect_list(record)).alias("docs"))
        .select(
            "session_id", "part", "docs", "total_chunks", F.lit(ts).cast("bigint").alias("ts"), F.lit(ocr).alias("ocr"),
            F.lit(chunk_size).alias("chunk_size"), F.lit(chunk_overlap).alias("chunk_overlap"),
            F.struct(F.col("n").alias("total_documents"), F.col("_active").alias("active_documents"), F.col("_superseded").alias("superseded_documents")).alias("document_stats"),
        )
    )


def write_manifest(docs: DataFrame, path: str, ts: int, mode: str = "overwrite", **settings) -> None:
    nest_manifest(docs, ts, **settings).write.mode(mode).json(path)


def read_manifest(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """One row per document of every manifest below ``path``."""
    records = spark.read.schema(MANIFEST_SCHEMA).json(path, multiLine=multi_line)
    return records.select("session_id", "ts", F.explode("docs").alias("d")).select("session_id", "ts", "d.*")
