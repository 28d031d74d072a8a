"""Rate limits, request metrics, job state, cache counts and evaluation."""

from __future__ import annotations

import sys
import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from trawl.functions import fixed_values as fv
from trawl.functions.text import keyword_match

cloudpickle.register_pickle_by_value(sys.modules[__name__])

Limits = dict[str, tuple[int, float]]
CLIENT = ["client", "endpoint"]


def _limit_columns(limits: Limits) -> tuple[Column, Column]:
    def table(i: int) -> Column:
        return F.create_map(*[F.lit(x) for name, v in limits.items() for x in (name, float(v[i]))])

    return F.try_element_at(table(0), F.col("endpoint")), F.try_element_at(table(1), F.col("endpoint"))


def independent_stretches(requests: DataFrame) -> DataFrame:
    """Add ``stretch``: requests of different stretches cannot affect each other.

    Time is cut into steps of one window length. Where a client skips a whole
    step, everything before it has expired. The steps in use are far fewer than
    the requests, so even a very busy client is cut up without sorting its rows.
    """
    stepped = requests.withColumn("step", F.floor(F.col("ts") / F.col("window_s")))
    steps = stepped.select(*CLIENT, "step").distinct()
    order = Window.partitionBy(*CLIENT).orderBy("step")
    gap = F.col("step") - F.lag("step").over(order)
    cut = steps.withColumn("gap", F.when(gap > 1, 1).otherwise(0)).withColumn("stretch", F.sum("gap").over(order)).drop("gap")
    return stepped.join(cut, [*CLIENT, "step"]).drop("step")


def admitted(times: np.ndarray, most: int, span: float, kept: list[float]) -> tuple[np.ndarray, list[float]]:
    """(allowed, last accepted times) of one client's requests in time order, after accepted ones at ``kept``.

    The next request passes once the most-th last accepted one has left its
    window, so refused runs are skipped by binary search.
    """
    allowed = np.zeros(len(times), bool)
    kept = kept[-most:] if most > 0 else []
    at = 0
    while at < len(times) and most > 0:
        if len(kept) == most:
            first = kept[0]
            at = max(at, int(np.searchsorted(times, first + span)))
            while at < len(times) and times[at] - first < span:  # the sum may be rounded to either side
                at += 1
            while at > 0 and not allowed[at - 1] and times[at - 1] - first >= span:
                at -= 1
            if at == len(times):
                break
            kept.pop(0)
        allowed[at] = True
        kept.append(float(times[at]))
        at += 1
    return allowed, kept


def _admit(batches):
    """Pass over rows sorted by client, stretch and time; holds one stretch's last accepted times.

    Most stretches are a few requests; one that fits whole under its maximum is
    let through without a search.
    """
    current, kept = None, []
    for pdf in batches:
        n = len(pdf)
        if not n:
            continue
        columns = [pdf[c].to_numpy() for c in ("client", "endpoint", "stretch")]
        new = np.zeros(n, bool)
        new[0] = True
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, n)).tolist()
        most = pdf["max_requests"].to_numpy()[starts].astype(np.int64).tolist()
        span = pdf["window_s"].to_numpy()[starts].tolist()
        times = pdf["ts"].to_numpy()
        out = np.ones(n, dtype=bool)
        first, last = (tuple(c[i] for c in columns) for i in (0, -1))
        ends = len(starts) - 1
        for i, (a, size) in enumerate(zip(starts.tolist(), sizes)):
            carried = kept if i == 0 and first == current else []
            if len(carried) + size > most[i]:
                out[a : a + size], after = admitted(times[a : a + size], most[i], span[i], carried)
            elif i == ends:
                after = carried + times[a:].tolist()
        current, kept = last, after
        yield pd.DataFrame({"request_id": pdf["request_id"], "allowed": out})


def rate_limit(requests: DataFrame, limits: Limits = fv.RATE_LIMITS) -> DataFrame:
    """Add ``allowed`` to requests (request_id, client, endpoint, ts in seconds).

    A request passes when fewer than the endpoint's maximum passed within its
    window before; refused requests do not count. An endpoint without a limit
    always passes. Rows stream through each task in time order, so a busy
    stretch needs no more memory than its last accepted times.
    """
    most, span = _limit_columns(limits)
    marked = requests.withColumns({"max_requests": most, "window_s": span})
    limited = marked.filter(F.col("max_requests").isNotNull())
    ordered = (
        independent_stretches(limited)
        .select("request_id", *CLIENT, "stretch", "ts", "max_requests", "window_s")
        .repartition(*CLIENT, "stretch")
        .sortWithinPartitions(*CLIENT, "stretch", "ts", "request_id")
    )
    key_type = requests.schema["request_id"].dataType.simpleString()
    judged = ordered.mapInPandas(_admit, f"request_id {key_type}, allowed boolean")
    return requests.join(judged, "request_id", "left").withColumn("allowed", F.coalesce("allowed", F.lit(True)))


def metric_columns() -> list[Column]:
    n = F.count(F.lit(1))
    errors = F.count_if(~F.col("success"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return [
        n.alias("request_count"), errors.alias("error_count"), zero(errors / F.nullif(n, F.lit(0))).alias("error_rate"),
        zero(F.avg("response_ms")).alias("avg_response_time"), zero(F.max("response_ms")).alias("max_response_time"),
        zero(F.min("response_ms")).alias("min_response_time"),
    ]


def request_metrics(requests: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts, error rate and response times; without ``by`` one row, zeros when empty."""
    grouped = requests.groupBy(*by) if by else requests
    return grouped.agg(*metric_columns())


def job_state(events: DataFrame) -> DataFrame:
    """Latest row per job from events: job_id, session_id, seq, event, progress, result, ts.

    Events: created, progress, done, failed.
    """
    event = F.col("event")
    status = F.when(event == "created", "pending").when(event.isin("done", "failed"), event)
    progress = (
        F.when(event == "created", 0).when(event == "done", 100)
        .when(event == "progress", F.greatest(F.lit(0), F.least(F.lit(100), F.col("progress").cast("int"))))
    )
    result = F.when(event.isin("done", "failed"), F.col("result"))

    def latest(value: Column) -> Column:
        return F.max_by(value, F.when(value.isNotNull(), F.col("seq")))

    return events.groupBy("job_id").agg(
        F.min_by("session_id", "seq").alias("session_id"),
        F.coalesce(latest(status), F.lit("pending")).alias("status"),
        F.coalesce(latest(progress), F.lit(0)).alias("progress"),
        latest(result).alias("result"),
        F.min("ts").alias("ts_created"), F.max("ts").alias("ts_updated"), F.max("seq").alias("seq"),
    )


def job_status(state: DataFrame, wanted: DataFrame) -> DataFrame:
    return state.join(wanted.select("job_id").distinct(), "job_id", "left_semi")


def cache_stats(embed_cache: DataFrame, answer_cache: DataFrame) -> DataFrame:
    count = lambda df, name: df.agg(F.lit(name).alias("cache"), F.count(F.lit(1)).alias("entries"))
    return count(embed_cache, "embed").unionByName(count(answer_cache, "answer"))


def match_keywords(cases: DataFrame) -> DataFrame:
    """Add ``matched``: any expected keyword occurs in the answer, case folded."""
    return cases.withColumn("matched", keyword_match(F.col("answer"), F.col("expected")))


def eval_report(matched: DataFrame, pass_mark: float = 60.0) -> DataFrame:
    """One row: total, passed, accuracy %, mean latency over answered cases, verdict."""
    answered = F.col("answer").isNotNull()
    totals = matched.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("matched") & answered).alias("passed"),
        F.coalesce(F.avg(F.when(answered, F.col("latency_ms"))), F.lit(0.0)).alias("avg_latency_ms"),
    )
    accuracy = F.coalesce(F.col("passed") * 100.0 / F.nullif("total", F.lit(0)), F.lit(0.0))
    return totals.withColumn("accuracy", accuracy).withColumn(
        "verdict", F.when(F.col("accuracy") >= pass_mark, "PASS").otherwise("FAIL")
    )
