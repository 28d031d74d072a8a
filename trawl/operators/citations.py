"""Citations in answers, and the sources they point to."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trawl.functions import fixed_values as fv
from trawl.functions.text import strip, truncate

RANGE_BLOCK = 10_000


def cited_ranges(answers: DataFrame, ends_only: bool = False, pattern: str = fv.CITATION_PATTERN) -> DataFrame:
    """(query_id, doc_name, page, lo, hi) of the citations in ``answer``, as written and with repeats.

    A rising range of pages is one row with lo and hi and no page, however long
    it is. Anything else is a page as a string, NULL for the whole document; a
    reversed range gives its two ends. With ``ends_only`` the name ends at the
    first ':' and every range gives its ends.
    """
    found = answers.select(
        "query_id",
        F.explode(
            F.arrays_zip(
                F.regexp_extract_all("answer", F.lit(pattern), F.lit(1)).alias("doc"),
                F.regexp_extract_all("answer", F.lit(pattern), F.lit(2)).alias("pages"),
            )
        ).alias("c"),
    ).select("query_id", F.col("c.doc").alias("doc"), F.col("c.pages").alias("pages"))
    if ends_only:
        whole = F.concat_ws(":", "doc", "pages")
        found = found.select(
            "query_id", F.split(whole, ":", 2)[0].alias("doc"), F.split(whole, ":", 2)[1].alias("pages")
        )
    parts = F.filter(F.transform(F.split("pages", ","), strip), lambda s: s != "")
    segments = found.select("query_id", strip(F.col("doc")).alias("doc_name"), F.explode_outer(parts).alias("seg"))
    low = F.regexp_extract("seg", fv.PAGE_RANGE_PATTERN, 1)
    high = F.regexp_extract("seg", fv.PAGE_RANGE_PATTERN, 2)
    a, b = low.try_cast("bigint"), high.try_cast("bigint")
    is_range = F.coalesce(F.col("seg").rlike(fv.PAGE_RANGE_PATTERN), F.lit(False))
    rising = is_range & F.coalesce(a <= b, F.lit(False)) & F.lit(not ends_only)
    ends = F.when(rising, F.array(F.lit(None).cast("string"))).when(is_range, F.array(low, high)).otherwise(F.array("seg"))
    return segments.filter("doc_name <> ''").select(
        "query_id", "doc_name", F.explode(ends).alias("page"), F.when(rising, a).alias("lo"), F.when(rising, b).alias("hi")
    )


def extract_citations(answers: DataFrame, ends_only: bool = False, pattern: str = fv.CITATION_PATTERN) -> DataFrame:
    """Distinct (query_id, doc_name, page) cited in ``answer``; page is a string or NULL.

    A range names each of its pages, a reversed one only its two ends. With
    ``ends_only`` the name ends at the first ':' and every range gives its ends.
    A range of very many pages gives as many rows; `match_sources` takes
    `cited_ranges` as they are.
    """
    ranges = cited_ranges(answers, ends_only, pattern).distinct()
    # A long range is unfolded in blocks, so no single array holds all its pages.
    starts = F.when(F.col("lo").isNotNull(), F.sequence("lo", "hi", F.lit(RANGE_BLOCK)))
    blocks = ranges.withColumn("start", F.explode_outer(starts))
    run = F.transform(F.sequence("start", F.least(F.col("start") + RANGE_BLOCK - 1, F.col("hi"))), lambda p: p.cast("string"))
    pages = F.when(F.col("start").isNotNull(), run).otherwise(F.array("page"))
    return blocks.select("query_id", "doc_name", F.explode(pages).alias("page")).distinct()


def match_sources(passages: DataFrame, citations: DataFrame) -> DataFrame:
    """Passages whose document and page, or whole document, was cited; takes `cited_ranges` or `extract_citations`."""
    p, c = passages.alias("p"), citations.alias("c")
    same = (F.col("p.query_id") == F.col("c.query_id")) & (F.col("p.doc_name") == F.col("c.doc_name"))
    own = F.col("p.page").cast("string")
    page = F.col("c.page").isNull() | (F.col("c.page") == "") | (own == F.col("c.page"))
    if "lo" in citations.columns:
        number = own.try_cast("bigint")
        page = F.when(F.col("c.lo").isNotNull(), number.between(F.col("c.lo"), F.col("c.hi"))).otherwise(page)
    return p.join(c, same & page, "left_semi")


def source_rows(matched: DataFrame) -> DataFrame:
    """Source records: name, page, scores, shortened text and document state."""
    optional = {
        "upload_timestamp": "double", "document_status": "string", "document_version": "int", "recency": "double",
    }
    extra = [(F.col(n) if n in matched.columns else F.lit(None)).cast(t).alias(n) for n, t in optional.items()]
    score = F.col("score") if "score" in matched.columns else F.col("hybrid_score")
    return matched.select(
        "query_id", "place", F.col("doc_name").alias("filename"), "page",
        F.coalesce(score, F.lit(0.0)).alias("score"), F.coalesce("relevance", F.lit(0.0)).alias("relevance"),
        truncate(F.col("text"), fv.SOURCE_CHARS, fv.SOURCE_KEEP).alias("content"), *extra,
    )


def unique_source_labels(sources: DataFrame) -> DataFrame:
    """(query_id, label): distinct trimmed ``file:page`` labels."""
    name, page = strip(F.col("filename")), strip(F.coalesce(F.col("page").cast("string"), F.lit("")))
    label = F.when(page == "", name).otherwise(F.concat_ws(":", name, page))
    return sources.filter("filename <> ''").select("query_id", label.alias("label")).distinct().orderBy("query_id", "label")
