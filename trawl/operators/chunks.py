"""Token windows over page texts, cut at sentence ends where one is near.

Token starts are found once in a page's bytes, in an Arrow batch, and its windows are kept as token
numbers and byte ranges; the text of a chunk is then cut out of the page by its
bytes, in generated code, in time proportional to the chunk.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from trawl.functions import fixed_values as fv
from trawl.operators.prefix import sum_before
from trawl.session import stage_table, with_session

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Values, not the module, so that task code needs no package on the workers.
MARKERS, LOOKAHEAD, MIN_FILL = tuple(fv.BREAK_MARKERS), fv.BREAK_LOOKAHEAD, fv.BREAK_MIN_FILL
# A word with the white space behind it; `_token_offsets` finds their starts.
_WORDS = re.compile(r"\S+\s*", re.ASCII)
SPANS = "array<struct<start:int,end:int,at:bigint,bytes:bigint>>"


def _check(size: int, overlap: int) -> None:
    if not 0 <= overlap < MIN_FILL * size:
        raise ValueError("overlap must be below 0.7 of the chunk size, or windows stop advancing")


def fixed_spans(n: int, size: int, overlap: int) -> list[tuple[int, int]]:
    """Plain windows (start, end) over n tokens; none for 0."""
    starts = [0] if n <= size else range(0, max(0, n - 1 - overlap) + 1, size - overlap)
    return [(s, min(s + size, n)) for s in starts if s < n]


def break_spans(tokens: list[str], size: int, overlap: int, markers=MARKERS, lookahead=LOOKAHEAD, min_fill=MIN_FILL) -> list[tuple[int, int]]:
    """Windows (start, end) over tokens, whose end moves to just behind a break.

    For each marker, in order, only its first occurrence in the text of the
    window and its lookahead counts, wherever the token limits lie; the first
    marker that ends in or with a token past 70 % of the window and before the end
    of the lookahead sets the end. Linear in the tokens, but for the logarithm of
    a search per window.
    """
    return _break_spans(*_joined(tokens), size, overlap, markers, lookahead, min_fill)


def _joined(tokens: list[str]) -> tuple[bytes, np.ndarray]:
    """UTF-8 bytes of the joined tokens, where each starts, and the end."""
    coded = [token.encode() for token in tokens]
    return b"".join(coded), np.cumsum([0, *map(len, coded)])


def _token_offsets(data: bytes) -> np.ndarray:
    """Where each word starts in UTF-8 bytes, and their end; the white space behind a word is its own."""
    codes = np.frombuffer(data, dtype=np.uint8)
    space = (codes == 32) | (codes - np.uint8(9) < 5)
    return np.append(np.flatnonzero(np.diff(space.view(np.int8), prepend=np.int8(1)) < 0), len(codes))


def _break_spans(text: bytes, offsets: np.ndarray, size: int, overlap: int, markers=MARKERS, lookahead=LOOKAHEAD, min_fill=MIN_FILL) -> list[tuple[int, int]]:
    n = len(offsets) - 1
    if n <= size:
        return [(0, n)] if n else []
    offsets = offsets.tolist()
    marks = []
    for marker in map(str.encode, markers):
        places, at = [], text.find(marker)
        while at >= 0:
            places.append(at)
            at = text.find(marker, at + 1)
        if places:
            marks.append((places, len(marker)))
    spans, start = [], 0
    while True:
        end = min(start + size, n)
        if end < n:
            limit = min(end + lookahead, n)
            for places, length in marks:
                i = bisect_left(places, offsets[start])
                if i < len(places) and places[i] + length <= offsets[limit]:
                    behind = bisect_left(offsets, places[i] + length, start, limit + 1)
                    if start + min_fill * size < behind < limit:
                        end = behind
                        break
        spans.append((start, end))
        if end == n:
            return spans
        start = max(0, end - overlap)


def _spans(column: Column, size: int, overlap: int, semantic: bool, tokenised: bool) -> Column:
    """`SPANS` of a text column, or of a column of token arrays; empty for null."""
    _check(size, overlap)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("at", pa.int64()), ("bytes", pa.int64())]))
    cut = _break_spans if semantic else lambda text, offsets, size, overlap: fixed_spans(len(offsets) - 1, size, overlap)

    def row(value) -> list[dict]:
        if tokenised:
            data, offsets = _joined(value or [])
        else:
            data = (value or "").encode()
            offsets = _token_offsets(data)
        return [{"start": s, "end": e, "at": int(offsets[s]), "bytes": int(offsets[e] - offsets[s])} for s, e in cut(data, offsets, size, overlap)]

    def spans(batch: pa.Array) -> pa.Array:
        return pa.array([row(value.as_py()) for value in batch], kind)

    return F.arrow_udf(spans, SPANS)(column)


def _column(tokens: str | None) -> Column:
    return F.col(tokens) if tokens else F.col("text")


def split_pages(
    pages: DataFrame, size: int = fv.CHUNK_SIZE, overlap: int = fv.CHUNK_OVERLAP, semantic: bool = True,
    tokens: str | None = None,
) -> DataFrame:
    """Chunks per page: the page's columns, pos (from 0), start, end, n_tokens, text.

    ``tokens`` names a column with the caller's token array, whose joined tokens
    are then the text; the default tokens are words with the white space behind
    them.
    """
    keep = [c for c in pages.columns if c not in ("text", tokens)]
    return _cut(pages.withColumn("_spans", _spans(_column(tokens), size, overlap, semantic, tokens is not None)), keep, tokens)


def _cut(pages: DataFrame, keep: list[str], tokens: str | None) -> DataFrame:
    """A row for each of the pages' _spans.

    The outer explode keeps Spark from inferring a filter that would run the
    function of _spans a second time.
    """
    data = (F.array_join(tokens, "") if tokens else F.col("text")).cast("binary")
    start, end = F.col("span.start"), F.col("span.end")
    text = F.substring("_data", (F.col("span.at") + 1).cast("int"), F.col("span.bytes").cast("int"))
    return pages.select(*keep, data.alias("_data"), F.posexplode_outer("_spans").alias("pos", "span")).filter("span IS NOT NULL").select(
        *keep, "pos", start.alias("start"), end.alias("end"), (end - start).alias("n_tokens"), text.cast("string").alias("text"),
    )


def chunk_pages(
    pages: DataFrame, size: int = fv.CHUNK_SIZE, overlap: int = fv.CHUNK_OVERLAP, semantic: bool = True,
    tokens: str | None = None,
) -> DataFrame:
    """Chunks of every page, numbered from 0 across each document.

    The numbers come from a running total of chunk counts over pages, which is
    exact and does not gather a long document in one task. Windows are found once
    and written; with the totals beside them they are small enough to be broadcast
    by their known size, and texts stay in place.
    """
    doc = ["session_id", "doc_name"]
    pages = with_session(pages)
    spans = stage_table(pages.select(*doc, "page", _spans(_column(tokens), size, overlap, semantic, tokens is not None).alias("_spans")))
    counts = spans.select(*doc, "page", F.size("_spans").alias("n"))
    offsets = sum_before(counts, doc, "page", F.col("n"), "before").select(*doc, "page", "before")
    found = stage_table(spans.filter(F.size("_spans") > 0).join(offsets, [*doc, "page"]))
    keep = [c for c in pages.columns if c not in ("text", tokens)]
    pieces = _cut(pages.join(found, [*doc, "page"]), [*keep, "before"], tokens)
    return pieces.withColumn("chunk_id", F.col("before") + F.col("pos")).drop("before", "pos", "start", "end")
