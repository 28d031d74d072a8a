"""Page cleaning: repeated header and footer lines, OCR work-list, document text."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from trawl.functions import fixed_values as fv
from trawl.functions.text import normalize_ws, split_lines
from trawl.session import stage_table, with_session

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEGMENT_PAGES = 4096
DOC = ["session_id", "doc_name"]


def line_key(line: Column) -> Column:
    return F.substring(normalize_ws(line), 1, fv.LINE_KEY_CHARS)


# A value, not the module, so that task code needs no package on the workers.
KEY_CHARS = fv.LINE_KEY_CHARS
_EDGE = "struct<n_lines:int,head:string,tail:string>"


def _lines(text: bytes | None) -> list[str]:
    """The non-blank lines, as `split_lines` gives them."""
    return [line for line in (text or b"").decode(errors="replace").splitlines() if line and not line.isspace()]


def _edges(texts: pa.Array) -> pa.Array:
    def edge(lines: list[str]) -> dict:
        head, tail = (" ".join(lines[i].split())[:KEY_CHARS] if lines else None for i in (0, -1))
        return {"n_lines": len(lines), "head": head, "tail": tail}

    kind = pa.struct([("n_lines", pa.int32()), ("head", pa.string()), ("tail", pa.string())])
    return pa.array([edge(_lines(text.as_py())) for text in texts], kind)


def _rebuilt(texts: pa.Array, drop_head: pa.Array, drop_tail: pa.Array) -> pa.Array:
    """Texts in one line, with single spaces, without their first or last non-blank line where told."""
    out = []
    for text, first, last in zip(texts, drop_head.to_numpy(zero_copy_only=False), drop_tail.to_numpy(zero_copy_only=False)):
        text = text.as_py()
        if first or last:
            lines = _lines(text)
            out.append(" ".join(" ".join(lines[int(first) : len(lines) - int(last)]).split()))
        else:
            out.append(" ".join((text or b"").decode(errors="replace").split()))
    return pa.array(out, pa.string())


def page_edges(pages: DataFrame) -> DataFrame:
    """Per page: line count and the keys of its first and last line, NULL without lines."""
    edge = F.arrow_udf(_edges, _EDGE)(F.col("text").cast("binary"))
    return with_session(pages).select(*DOC, "page", edge.alias("edge")).select(*DOC, "page", "edge.*")


def repeated_lines(edges: DataFrame, min_repeat: int = fv.MIN_REPEAT) -> DataFrame:
    """(session_id, doc_name, position, key, n) of first ("head") and last ("tail") lines repeated in a document."""
    sides = F.array(*[F.struct(F.lit(p).alias("position"), F.col(p).alias("key")) for p in ("head", "tail")])
    return (
        edges.select(*DOC, F.inline(sides)).filter("key <> ''")
        .groupBy(*DOC, "position", "key").agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= min_repeat)
    )


def detect_repeated(edges: DataFrame, position: str, min_repeat: int = fv.MIN_REPEAT) -> DataFrame:
    return repeated_lines(edges, min_repeat).filter(F.col("position") == position).drop("position")


def repeated_edges(pages: DataFrame, min_repeat: int = fv.MIN_REPEAT) -> DataFrame:
    """Pages that lose a line: (session_id, doc_name, page, drop_head, drop_tail).

    Works on line keys only, so page texts stay out of the skewed joins. The
    last line is judged after a dropped first line: a one-line page keeps none.
    """
    edges = stage_table(page_edges(pages))  # read twice, and far smaller than the texts
    known = repeated_lines(edges, min_repeat)
    marked = edges
    for position in ("head", "tail"):
        side = known.filter(F.col("position") == position).select(
            *DOC, F.col("key").alias(position), F.lit(True).alias(f"is_{position}")
        )
        marked = marked.join(side, [*DOC, position], "left")
    drop_head = F.coalesce("is_head", F.lit(False))
    left = F.col("n_lines") - drop_head.cast("int")
    drop_tail = F.coalesce("is_tail", F.lit(False)) & (left > 0)
    return marked.select(
        *DOC, "page", drop_head.alias("drop_head"), drop_tail.alias("drop_tail")
    ).filter("drop_head OR drop_tail")


def _judged(pages: DataFrame, min_repeat: int) -> DataFrame:
    """Pages with drop_head and drop_tail.

    The list of pages to cut is written first, so the planner knows its size and
    shuffles the texts only when it is too large to broadcast.
    """
    drops = stage_table(repeated_edges(pages, min_repeat))
    no = F.lit(False)
    return with_session(pages).join(drops, [*DOC, "page"], "left").withColumns(
        {"drop_head": F.coalesce("drop_head", no), "drop_tail": F.coalesce("drop_tail", no)}
    )


def strip_repeated(pages: DataFrame, min_repeat: int = fv.MIN_REPEAT) -> DataFrame:
    """Pages with ``lines``: the non-blank lines left after header and footer removal."""
    first = 1 + F.col("drop_head").cast("int")
    kept = F.size("lines") - F.col("drop_head").cast("int") - F.col("drop_tail").cast("int")
    return (
        _judged(pages, min_repeat)
        .withColumn("lines", split_lines(F.col("text")))
        .withColumn("lines", F.slice("lines", first, kept))
        .drop("drop_head", "drop_tail")
    )


def rebuild_page(lines: Column) -> Column:
    return normalize_ws(F.array_join(lines, " "))


def clean_pages(pages: DataFrame, min_repeat: int = fv.MIN_REPEAT) -> DataFrame:
    """Pages with cleaned text, `rebuild_page` of what `strip_repeated` leaves; an emptied page stays, with ''."""
    rebuilt = F.arrow_udf(_rebuilt, "string")(F.col("text").cast("binary"), "drop_head", "drop_tail")
    return _judged(pages, min_repeat).withColumn("text", rebuilt).drop("drop_head", "drop_tail")


def pages_needing_ocr(pages: DataFrame, ocr: bool = False) -> DataFrame:
    """Work-list for a text recogniser: every page, or the blank ones only."""
    return pages.filter(F.lit(ocr) | (normalize_ws(F.col("text")) == ""))


def document_text(pages: DataFrame, segment_pages: int = SEGMENT_PAGES) -> DataFrame:
    """(session_id, doc_name, segment, text): pages joined with ' ' in page order.

    A document of up to ``segment_pages`` page numbers is one segment 0; a longer
    one is several, whose texts joined with ' ' in order give the whole. No task
    holds more than one segment.
    """
    segment = F.floor((F.col("page") - 1) / segment_pages)
    ordered = F.array_sort(F.collect_list(F.struct("page", "text")))
    return (
        with_session(pages).groupBy(*DOC, segment.alias("segment")).agg(ordered.alias("p"))
        .select(*DOC, "segment", F.array_join(F.col("p.text"), " ").alias("text"))
    )


def _running_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document of sorted pages; only the digest of the open document is held."""
    names = ["session_id", "doc_name", "content_hash", "n_chars"]
    open_, digest, n_chars = None, None, 0
    for batch in batches:
        done = []
        for session, doc, text in zip(*[batch.column(i).to_pylist() for i in range(3)]):
            text = text or ""
            if (session, doc) != open_:
                if open_ is not None:
                    done.append((*open_, digest.hexdigest(), n_chars))
                open_, digest, n_chars = (session, doc), hashlib.sha256(text.encode()), len(text)
            else:
                digest.update(b" " + text.encode())
                n_chars += 1 + len(text)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], pa.int64() if i == 3 else pa.string()) for i in range(4)], names)
    if open_ is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*open_, digest.hexdigest())] + [pa.array([n_chars], pa.int64())], names)


def document_digests(pages: DataFrame) -> DataFrame:
    """(session_id, doc_name, content_hash, n_chars): SHA-256 and length of the pages joined with ' ' in page order.

    One definition for any number of pages: a document's sorted pages stream
    through its task, which keeps a running digest and never the text.
    """
    ordered = with_session(pages).select(*DOC, "text", "page").repartition(*DOC).sortWithinPartitions(*DOC, "page", "text")
    kinds = {f.name: f.dataType for f in ordered.schema}
    assert all(kinds[c].simpleString() == "string" for c in DOC)
    return ordered.select(*DOC, "text").mapInArrow(_running_digests, "session_id string, doc_name string, content_hash string, n_chars bigint")
