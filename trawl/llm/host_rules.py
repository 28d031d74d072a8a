"""Quality rules judged by host: failing rates are shrunk by an empirical beta prior, and bad hosts lose their documents.

Each text is counted once, in a narrow scan. Rule failures are summed by host
with partial aggregation; for every rule the hosts' rates give a beta prior (mean
and spread by the analysis of variance), the prior and a host's own counts give
its posterior rate, and a host is bad when that rate is above a limit beyond
doubt. The verdicts join the documents' counts again; texts are never shuffled.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.session import stage_table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
_SYMBOLS = b"#*$%&|<>"
_INNER_BYTES = bytes(range(0x80, 0xC0))
_SLICE = 1 << 22
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]

#: Rules that reject a document by themselves.
BASE_RULES = {"short": "n_words < 50", "repeats": "100 * n_repeat_words > 50 * n_words"}
#: Further rules whose failures only count against the host.
HOST_RULES = {"symbols": "10 * n_symbols > word_chars", "dup_lines": "10 * n_dup_lines > 3 * n_lines"}


def _slices(text: bytes) -> Iterator[bytes]:
    """Parts of about `_SLICE` bytes that end at white space."""
    start = 0
    while start < len(text):
        stop = min(start + _SLICE, len(text))
        while stop < len(text) and text[stop] not in _SPACES:
            stop += 1
        yield text[start:stop]
        start = stop


def _repeat_words(ids: np.ndarray, n_ids: int) -> int:
    """Words inside three-word windows that occur twice or more."""
    if len(ids) < 3:
        return 0
    a, b, c = ids[:-2], ids[1:-1], ids[2:]
    if n_ids < 1 << 21:
        windows = (a << 42) | (b << 21) | c
    else:
        _, pairs = np.unique((a << 32) | b, return_inverse=True)
        windows = (pairs << 32) | c
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(windows), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    covered = np.zeros(len(ids), bool)
    covered[:-2] |= twice
    covered[1:-1] |= twice
    covered[2:] |= twice
    return int(covered.sum())


def text_counts(text: bytes) -> tuple[int, ...]:
    """`COUNTS` of one text in UTF-8."""
    known: dict[bytes, int] = {}
    parts = [np.fromiter((known.setdefault(w, len(known)) for w in part.split()), np.int64) for part in _slices(text)]
    ids = parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.int64)
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    return (
        len(ids), len(text.translate(None, _SPACES + _INNER_BYTES)), len(text) - len(text.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)), _repeat_words(ids, len(known)), len(lines),
    )


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [text_counts(text or b"") for text in batch.column(2).to_pylist()]
        columns = zip(*rows) if rows else [()] * len(COUNTS)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in columns)], ["_key", "_host", *COUNTS])


def beta_prior(hosts: int, rows: int, fails: int, square_sizes: float, square_fails: float) -> tuple[float, float]:
    """(alpha, beta) of the hosts' failing rates.

    square_sizes is the sum of squared host sizes, square_fails that of
    fails * fails / size. One host, or rates that are all 0 or all 1, tell nothing
    about the spread: the prior then weighs two documents.
    """
    mean = fails / rows if rows else 0.0
    room = rows - square_sizes / rows - (hosts - 1) if rows else 0.0
    if room <= 0 or mean in (0.0, 1.0):
        likeness = 1.0 / 3.0
    else:
        spread = (square_fails - fails * mean) / (mean * (1 - mean))
        likeness = min(max((spread - (hosts - 1)) / room, 1e-4), 0.9999)
    weight = (1 - likeness) / likeness
    return mean * weight, (1 - mean) * weight


def bad_rate(fails: Column, rows: Column, prior: tuple[float, float], most: float, deviations: float) -> Column:
    """True where the posterior rate is above `most` by that many standard deviations, and so is the host's own rate."""
    a, b = fails + F.lit(prior[0]), rows - fails + F.lit(prior[1])
    mean = a / (a + b)
    low = mean - F.lit(deviations) * F.sqrt(mean * (1 - mean) / (a + b + 1))
    return (F.round(low, 9) > most) & (fails > F.lit(most) * rows)


def judge_by_host(
    docs: DataFrame, host: Column, key: str = "doc_id", text: str = "text", base: dict[str, str] | None = None, further: dict[str, str] | None = None,
    most: float = 0.5, deviations: float = 2.0,
) -> DataFrame:
    """(key, host, the six `COUNTS`, base_failed, bad_host, kept): one row per row of docs.

    base and further name SQL conditions over the counts; those of base reject a
    document by themselves, all count against its host. bad_host tells whether any
    rule's posterior failing rate at the host is above `most` beyond `deviations`;
    kept is neither. A null text is empty. Documents without a host belong to
    none: they neither form one nor are judged by one. Repeated rows count as often
    as they come; an empty table gives no rows; other columns are ignored, so
    their names cannot clash. Memory follows the longest text of a batch, eight
    bytes a word and its distinct words.
    """
    base = BASE_RULES if base is None else base
    rules = base | (HOST_RULES if further is None else further)
    kind = docs.schema[key].dataType.simpleString()
    texts = docs.select(F.col(f"`{key}`").alias("_key"), host.cast("string").alias("_host"), F.col(f"`{text}`").cast("binary").alias("_text"))
    counted = stage_table(texts.mapInArrow(_counted, f"_key {kind}, _host string, " + ", ".join(f"{c} bigint" for c in COUNTS)))
    names = list(rules)
    failed = [F.count_if(F.expr(rules[r])).alias(f"_fails_{i}") for i, r in enumerate(names)]
    hosts = stage_table(counted.filter("_host IS NOT NULL").groupBy("_host").agg(F.count(F.lit(1)).alias("_rows"), *failed))
    rows = F.col("_rows").cast("double")
    sums = [F.count(F.lit(1)).alias("hosts"), F.sum("_rows").alias("rows"), F.sum(rows * rows).alias("squares")]
    for i in range(len(names)):
        fails = F.col(f"_fails_{i}")
        sums += [F.sum(fails).alias(f"fails_{i}"), F.sum(fails * fails / rows).alias(f"squares_{i}")]
    total = hosts.agg(*sums).first()
    bad = F.lit(False)
    for i in range(len(names)):
        prior = beta_prior(total.hosts, total.rows or 0, total[f"fails_{i}"] or 0, total.squares or 0.0, total[f"squares_{i}"] or 0.0)
        bad = bad | bad_rate(F.col(f"_fails_{i}"), F.col("_rows"), prior, most, deviations)
    bad_hosts = stage_table(hosts.filter(bad).select("_host", F.lit(True).alias("_bad")))
    base_failed = F.lit(False)
    for condition in base.values():
        base_failed = base_failed | F.expr(condition)
    judged = counted.join(bad_hosts, "_host", "left").withColumns({"base_failed": base_failed, "bad_host": F.coalesce("_bad", F.lit(False))})
    return judged.select(
        F.col("_key").alias(key), F.col("_host").alias("host"), *COUNTS, "base_failed", "bad_host", (~F.col("base_failed") & ~F.col("bad_host")).alias("kept")
    )
