"""Structured Streaming forms of ingest, rate limit, request metrics and job state."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from trawl.functions import fixed_values as fv
from trawl.operators.ops import CLIENT, Limits, _limit_columns, admitted, job_state, request_metrics
from trawl.operators.chunks import chunk_pages
from trawl.operators.pages import clean_pages
from trawl.session import stage_table, use_rocksdb

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_ALLOWED = "request_id {}, allowed boolean"


class Limiter(StatefulProcessor):
    """One client's limit at one endpoint; the state ends by a timer once nothing in it can refuse a request.

    State: the last accepted times, no more than the endpoint's maximum, the
    latest time, and when the timer is due.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.accepted = handle.getValueState("accepted", "times array<double>, last double, due bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept, last, due = self.accepted.get() if self.accepted.exists() else ([], -np.inf, None)
        parts = list(rows)
        batch = parts[0] if len(parts) == 1 else pd.concat(parts)
        batch = batch.sort_values(["ts", "request_id"])
        watermark = timerValues.getCurrentWatermarkInMs()
        now = max(last, watermark / 1000 if watermark > 0 else -np.inf)  # 0 stands for none yet
        times = np.maximum(batch["ts"].to_numpy(), now)
        most, span = int(batch["max_requests"].iloc[0]), float(batch["window_s"].iloc[0])
        allowed, kept = admitted(times, most, span, [float(t) for t in kept])
        last = float(times[-1])
        if due is not None:
            self.handle.deleteTimer(due)
        due = int(np.ceil((last + span) * 1000)) + 1  # past the rounding of the sum
        self.handle.registerTimer(due)
        self.accepted.update((kept, last, due))
        yield pd.DataFrame({"request_id": batch["request_id"].to_numpy(), "allowed": allowed})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.accepted.clear()
        return iter(())

    def close(self) -> None:
        pass


def rate_limit_stream(requests: DataFrame, limits: Limits = fv.RATE_LIMITS, lateness: str = "10 minutes") -> DataFrame:
    """(request_id, allowed) of a request stream with ts in seconds; every request gets a row.

    The stream's time is the newest ts of a limited request so far less
    ``lateness``. Nothing is too late: a request is judged at its own time, at its
    client's latest one or at the stream's, whichever is last. So the rows equal
    those of `rate_limit` if each client's requests come in time order and none
    lags behind the newest of all by more than ``lateness``. A client's state ends
    when the stream's time has passed its last request by a whole window. Endpoints
    without a limit pass in a branch of their own, stateless.
    """
    use_rocksdb(requests.sparkSession)
    most, span = _limit_columns(limits)
    marked = requests.withColumns({"max_requests": most, "window_s": span})
    kind = requests.schema["request_id"].dataType.simpleString()
    free = marked.filter(F.col("max_requests").isNull()).select("request_id", F.lit(True).alias("allowed"))
    # Only the operator's clock needs the watermark; without its column Spark drops no late row.
    timed = marked.filter(F.col("max_requests").isNotNull()).withColumn("_at", F.timestamp_seconds("ts")).withWatermark("_at", lateness)
    judged = (
        timed.select("request_id", *CLIENT, "ts", "max_requests", "window_s").groupBy(*CLIENT)
        .transformWithStateInPandas(Limiter(), _ALLOWED.format(kind), "append", "eventTime")
    )
    return judged.unionByName(free)


def request_metrics_stream(requests: DataFrame, by: list[str]) -> DataFrame:
    """Running metrics; write with output mode complete or update."""
    return request_metrics(requests, by)


def job_state_stream(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep job states from an event stream; each trigger appends the changed jobs."""

    def put(changed: DataFrame, batch_id: int) -> None:
        target = f"{path}/batch={batch_id}"
        changed.write.mode("overwrite").parquet(target)  # a retried batch replaces itself

    return (
        job_state(events).writeStream.outputMode("update").foreachBatch(put)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def current_jobs(spark: SparkSession, path: str) -> DataFrame:
    """Latest state of every job from the appended changes."""
    changes = spark.read.parquet(path)
    rest = [c for c in changes.columns if c not in ("job_id", "batch")]
    return changes.groupBy("job_id").agg(F.max_by(F.struct(*rest), "batch").alias("j")).select("job_id", "j.*")


def ingest_stream(pages: DataFrame, chunks_path: str, manifest_path: str, checkpoint: str, **chunking) -> StreamingQuery:
    """Chunk arriving pages (session_id, doc_name, page, text), each page number of a document once.

    A document may arrive over several triggers: pages that are new to it are
    chunked, and its chunk numbers go on. Pages it has already are not chunked
    again; they are listed below ``manifest_path`` + "_skipped". Header and footer
    lines are judged by the pages of a trigger. Each batch writes its own folders,
    so a retry replaces them.
    """
    doc = ["session_id", "doc_name"]

    def put(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([*doc, "page"])
        if batch_id:
            seen = _earlier(spark, f"{manifest_path}_pages", batch_id).select(*doc, "page")
            skipped = fresh.join(seen, [*doc, "page"], "left_semi").select(*doc, "page")
            skipped.write.mode("overwrite").parquet(f"{manifest_path}_skipped/batch={batch_id}")
            fresh = fresh.join(seen, [*doc, "page"], "left_anti")
        fresh = stage_table(fresh)
        fresh.select(*doc, "page").write.mode("overwrite").parquet(f"{manifest_path}_pages/batch={batch_id}")
        chunks = chunk_pages(clean_pages(fresh), **chunking)
        if batch_id:
            done = _earlier(spark, manifest_path, batch_id).groupBy("session_id", F.col("doc").alias("doc_name")).agg(F.sum("chunks").alias("_done"))
            chunks = chunks.join(done, doc, "left").withColumn("chunk_id", F.col("chunk_id") + F.coalesce("_done", F.lit(0))).drop("_done")
        chunks.write.mode("overwrite").parquet(f"{chunks_path}/batch={batch_id}")
        made = spark.read.parquet(f"{chunks_path}/batch={batch_id}")
        counts = made.groupBy("session_id", F.col("doc_name").alias("doc")).agg(F.count(F.lit(1)).alias("chunks"))
        n_pages = fresh.groupBy("session_id", F.col("doc_name").alias("doc")).agg(F.count(F.lit(1)).alias("pages"))
        rows = n_pages.join(counts, ["session_id", "doc"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))
        rows.write.mode("overwrite").parquet(f"{manifest_path}/batch={batch_id}")

    return pages.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _earlier(spark: SparkSession, path: str, before: int) -> DataFrame:
    """Rows that earlier batches wrote."""
    return spark.read.parquet(path).filter(F.col("batch") < before)
