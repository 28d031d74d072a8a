"""Ingest as a stream: documents are processed when their last page is in, in upload order.

A stateful operator keeps which pages of each open document have come; texts
pass through it into a log and are never state. A micro-batch then takes the
documents that are complete and that no open document of their session comes
before, and runs the steps of `ingest` on them: cleaning, hashes, registration
against a `RegistryStore`, chunks, vectors through the cache, manifest rows. So
the tables hold the same rows as one `ingest` over all pages, however the pages
fall into micro-batches.

Every table lies below one folder as ``name/batch=n``, and a repeated micro-batch
replaces its own rows. Cleaned pages and chunks without vectors are tables of a
micro-batch that go as soon as its later steps no longer read them.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StructType

from trawl.functions import fixed_values as fv
from trawl.operators import embedding as em, sessions as se, versions as v
from trawl.operators.chunks import chunk_pages
from trawl.operators.pages import clean_pages
from trawl.plans.steps import Ingested, document_uploads
from trawl.session import release_shuffles, stage, use_rocksdb
from trawl.sources.registry_store import RegistryStore

cloudpickle.register_pickle_by_value(sys.modules[__name__])

DOC = ["session_id", "doc_name"]
# Page numbers that share a row of state.
_BLOCK_PAGES = 8192
_EVENTS = "session_id string, doc_name string, kind string, page bigint, text string"


class PageTracker(StatefulProcessor):
    """Pages of one document that have come; tells when all are there, or when none came for too long.

    State: a bit for each page number, in blocks, and their count. A block is read
    and written once in a micro-batch, as each look into the state is a message to
    the engine. It goes with the last page or with the timer, so only open
    documents have any.
    """

    def __init__(self, patience_ms: int) -> None:
        self.patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("blocks", "block bigint", "bits binary")
        self.count = handle.getValueState("count", "n bigint, deadline bigint")

    def _block(self, number: int | None) -> bytearray:
        stored = self.seen.getValue((number,)) if self.seen.containsKey((number,)) else None
        return bytearray(_BLOCK_PAGES // 8 if stored is None else stored[0])

    def _wait_from(self, n: int, now: int) -> None:
        """Move the deadline; one timer at a time."""
        if self.count.exists() and self.count.get()[1] is not None:
            self.handle.deleteTimer(self.count.get()[1])
        deadline = now + self.patience_ms
        self.handle.registerTimer(deadline)
        self.count.update((n, deadline))

    def _close(self) -> None:
        if self.count.exists() and self.count.get()[1] is not None:
            self.handle.deleteTimer(self.count.get()[1])
        self.seen.clear()
        self.count.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        session, doc = key
        n = self.count.get()[0] if self.count.exists() else 0
        total, blocks, changed = None, {}, set()
        for row in rows:
            total = row.page_count
            number, place = (None, 0) if row.page is None else divmod(row.page, _BLOCK_PAGES)
            if number not in blocks:
                blocks[number] = self._block(number)
            bit = 1 << place % 8
            if blocks[number][place // 8] & bit:
                yield Row(session_id=session, doc_name=doc, kind="again", page=row.page, text=None)
                continue
            blocks[number][place // 8] |= bit
            changed.add(number)
            n += 1
            yield Row(session_id=session, doc_name=doc, kind="page", page=row.page, text=row.text)
        if n < total:
            for number in changed:
                self.seen.updateValue((number,), (bytes(blocks[number]),))
        if n >= total:
            self._close()
            yield Row(session_id=session, doc_name=doc, kind="complete", page=None, text=None)
        else:
            self._wait_from(n, timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        session, doc = key
        self.seen.clear()
        self.count.clear()
        yield Row(session_id=session, doc_name=doc, kind="stale", page=None, text=None)

    def close(self) -> None:
        pass


@dataclass
class DocumentStream:
    """Ingest of ``pages`` into tables below ``path``.

    ``files``: session_id, doc_name, reg (upload order), file_hash,
    upload_timestamp, page_count; every document that pages come for. ``manifest``
    and ``cache`` are what was there before; documents in the manifest are skipped.
    ``registry`` may hold earlier uploads as its batch 0; micro-batch n is its batch
    n + 1. ``patience_ms``: a document without a new page for so long is given up,
    listed as stale, and no longer holds back later ones of its session.
    """

    spark: SparkSession
    path: str
    files: DataFrame
    registry: RegistryStore
    manifest: DataFrame
    cache: DataFrame
    embed: em.EmbedBatch
    size: int = fv.CHUNK_SIZE
    overlap: int = fv.CHUNK_OVERLAP
    patience_ms: int = 3_600_000

    def start(self, pages: DataFrame, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
        """Take pages: session_id, doc_name, page, text; of a repeated page number the first to come counts.

        The default runs one micro-batch over all that is there. A steady stream
        gives ``trigger={"processingTime": "1 minute"}``; availableNow would never
        end, since timers always ask for one more batch.
        """
        use_rocksdb(self.spark)
        wanted = self._new_files().select(*DOC, F.col("page_count").cast("bigint"))
        counted = pages.join(wanted, DOC).select(*DOC, F.col("page").cast("bigint").alias("page"), "text", "page_count")
        schema = StructType.fromDDL(_EVENTS)
        events = counted.groupBy(*DOC).transformWithState(PageTracker(self.patience_ms), schema, "append", "processingTime")
        return events.writeStream.foreachBatch(self._put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"once": True})).start()

    def _new_files(self) -> DataFrame:
        return se.split_new_documents(self.files, self.manifest)[0]

    def _write(self, rows: DataFrame, name: str, batch: int, by: str | None = None) -> None:
        writer = rows.write.mode("overwrite").option("compression", "zstd")
        (writer.partitionBy(by) if by else writer).parquet(f"{self.path}/{name}/batch={batch}")

    def _written(self, rows: DataFrame, name: str, batch: int) -> DataFrame:
        """The rows as a table that `_drop` deletes."""
        self._write(rows, name, batch)
        return self.spark.read.schema(rows.schema).parquet(f"{self.path}/{name}/batch={batch}")

    def _drop(self, name: str, batch: int) -> None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/batch={batch}")
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    def _read(self, name: str, schema: str | StructType) -> DataFrame:
        typed = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], StructType(typed.fields).add("batch", LongType()))
        return self.spark.read.schema(StructType(typed.fields).add("batch", LongType())).parquet(f"{self.path}/{name}")

    def _put(self, events: DataFrame, batch: int) -> None:
        self._write(events, "events", batch, "kind")
        log = self._read("events", _EVENTS).filter(F.col("batch") <= batch)
        self._write(log.filter((F.col("batch") == batch) & (F.col("kind") == "page")).select(*DOC).distinct(), "arrivals", batch)
        ready = stage(self._ready(log, batch))
        self._write(ready.select(*DOC), "done", batch)
        if not ready.isEmpty():
            self._process(ready, log, batch)

    def _ready(self, log: DataFrame, batch: int) -> DataFrame:
        """Files that are complete, not processed yet, and not behind an open one of their session."""
        here = log.filter(F.col("batch") == batch).select("session_id").distinct()
        ends = log.filter(F.col("kind").isin("complete", "stale")).groupBy(*DOC, "kind").agg(F.min("batch").alias("batch"))
        closed = ends.groupBy(*DOC).agg(F.min("kind").alias("kind"), F.min_by("batch", "kind").alias("complete_in"))  # complete before stale
        files = self._new_files().join(here, "session_id", "left_semi").join(closed, DOC, "left")
        first_open = files.filter("kind IS NULL").groupBy("session_id").agg(F.min("reg").alias("_open"))
        done = self._read("done", "session_id string, doc_name string").filter(F.col("batch") < batch).select(*DOC)
        ahead = files.filter("kind = 'complete'").join(done, DOC, "left_anti").join(first_open, "session_id", "left")
        return ahead.filter(F.col("_open").isNull() | (F.col("reg") < F.col("_open"))).select(*self.files.columns, "complete_in")

    def _process(self, ready: DataFrame, log: DataFrame, batch: int) -> None:
        """The steps of ingest on some documents, from the parts of the log that hold their pages."""
        until = ready.select(*DOC, "complete_in")  # pages that come later are repeated ones
        arrivals = self._read("arrivals", "session_id string, doc_name string").join(until, DOC).filter("batch <= complete_in")
        batches = [r.batch for r in arrivals.select("batch").distinct().collect()]  # at most one number a micro-batch
        pages = log.filter(F.col("batch").isin(batches) & (F.col("kind") == "page")).join(until, DOC).filter("batch <= complete_in")
        cleaned = self._written(clean_pages(pages.select(*DOC, "page", "text")), "cleaned", batch)
        numbers = self._written(cleaned.select(*DOC, "page"), "numbers", batch)
        payload = ["upload_timestamp", "page_count"]
        uploads = document_uploads(cleaned, ready.drop("page_count"))
        done = self.registry.register(uploads.select("session_id", "reg", "filename", "file_hash", "content_hash", "hi", "lo", *payload), batch + 1)
        results = stage(done.results.join(ready.select("reg", "session_id", "upload_timestamp"), "reg"))
        self._write(results.select("session_id", "reg", "filename", "result", "message"), "results", batch)
        cut = chunk_pages(cleaned, self.size, self.overlap).join(ready.select(*DOC, "upload_timestamp"), DOC)
        pieces = self._written(cut, "pieces", batch)
        self._drop("cleaned", batch)
        release_shuffles(self.spark)
        known = self._cache(batch)
        vectors, grown = em.embed_column(pieces, known, self.embed)
        release_shuffles(self.spark)
        self._write(vectors, "chunks", batch)
        release_shuffles(self.spark)
        self._write(grown.join(known.select("k"), "k", "left_anti"), "cache", batch)
        state = results.withColumns({"status": F.lit(None).cast("string"), "version": F.lit(None).cast("bigint")})
        self._write(se.doc_summary(numbers, pieces, state), "manifest", batch)
        self._drop("pieces", batch)
        self._drop("numbers", batch)

    def _cache(self, before: int) -> DataFrame:
        made = self._read("cache", "k string, dim int, vec array<float>").filter(F.col("batch") < before)
        return em.cache_upsert(self.cache, made.select("k", "dim", "vec"))

    def stale(self) -> DataFrame:
        """(session_id, doc_name) of documents that were given up."""
        return self._read("events", _EVENTS).filter("kind = 'stale'").select(*DOC).distinct()

    def repeated_pages(self) -> DataFrame:
        """(session_id, doc_name, page) of page numbers that came again; the first to come counts."""
        log = self._read("events", _EVENTS)
        ended = log.filter("kind = 'complete'").groupBy(*DOC).agg(F.min("batch").alias("_end"))
        late = log.filter("kind = 'page'").join(ended, DOC).filter("batch > _end")
        return log.filter("kind = 'again'").select(*DOC, "page").unionByName(late.select(*DOC, "page"))

    def tables(self) -> Ingested:
        """All outputs so far, with today's statuses and versions: the same rows as `ingest` gives."""
        registry = self.registry.documents()
        read = lambda name: self.spark.read.parquet(f"{self.path}/{name}").drop("batch")
        results = read("results")
        now = stage(v.document_metadata(registry).select(
            "session_id", "doc_id", F.col("status").alias("document_status"), F.col("version").alias("document_version"), "upload_timestamp"
        ))
        named = lambda rows, name: rows.drop("upload_timestamp").withColumn("doc_id", v.stem(F.col(name))).join(now, ["session_id", "doc_id"]).drop("doc_id")
        chunks = named(read("chunks"), "doc_name")
        rows = named(read("manifest").drop("document_status", "version"), "doc").withColumnRenamed("document_version", "version")
        manifest = se.merge_manifest(self.manifest, rows.select(*self.manifest.columns))
        counts = chunks.groupBy(*DOC).agg(F.count(F.lit(1)).alias("chunk_count"))
        per_upload = registry.select("reg", "session_id", F.col("filename").alias("doc_name")).join(counts, DOC).select("reg", "chunk_count")
        return Ingested(
            chunks, registry, results, manifest, se.split_new_documents(self.files, self.manifest)[1], self._cache(sys.maxsize),
            v.document_statistics(registry, per_upload),
        )
