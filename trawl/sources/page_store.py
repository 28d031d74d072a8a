"""What is known of documents whose pages come late, are corrected or go, as signed sums.

Hashes, header and footer lines and digests of a document are sums over its
pages, so a change costs its own pages and never the document. Kept per document:
word-digest bit counts of its whole pages, and of their first and last lines by
line key. A line that turns out to be a header takes its words out of the whole
when the sums are read, whichever batch brought it. Sums lie below
``sums/batch=n`` and ``digests/batch=n``; a repeated batch replaces itself, and
`fold` makes one batch of all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from trawl.functions import fixed_values as fv
from trawl.functions.text import split_lines
from trawl.operators.pages import DOC, line_key
from trawl.operators.versions import SUMS, bit_counts, bit_sums, halves_of_sums
from trawl.session import with_session

_WORDS = [f"w{i}" for i in range(8)]
_MOD = 1 << 32


def _parts(pages: DataFrame) -> DataFrame:
    """(session_id, doc_name, sign, kind, key, part): whole pages, and their first and last lines.

    The single line of a page is of a kind of its own, since it can be dropped
    only once.
    """
    lined = pages.withColumn("lines", split_lines(F.col("text")))

    def part(kind: str, at: Column, when: Column) -> Column:
        line = F.get("lines", at)
        return F.when(when, F.struct(F.lit(kind).alias("kind"), line_key(line).alias("key"), line.alias("part")))

    several, last = F.size("lines") > 1, F.size("lines") - 1
    whole = F.struct(F.lit("all").alias("kind"), F.lit("").alias("key"), F.col("text").alias("part"))
    parts = F.array(whole, part("head", F.lit(0), several), part("tail", last, several), part("only", F.lit(0), F.size("lines") == 1))
    return lined.select(*DOC, "sign", F.inline(F.filter(parts, lambda p: p.isNotNull()))).filter("kind = 'all' OR key <> ''")


def _page_words(pages: DataFrame) -> DataFrame:
    """(session_id, doc_name, sign, n_chars, w0 ... w7): the eight 32-bit words of SHA-256 of "page:text"."""
    hexed = F.sha2(F.concat(F.col("page").cast("string"), F.lit(":"), F.col("text")), 256)
    words = [F.conv(F.substring(hexed, 1 + 8 * i, 8), 16, 10).cast("bigint").alias(w) for i, w in enumerate(_WORDS)]
    return pages.select(*DOC, "sign", F.char_length("text").cast("bigint").alias("n_chars"), *words)


@dataclass
class PageStore:
    """Documents by their pages: session_id (optional), doc_name, page, text (NULL: empty).

    A page number is there once per document; to correct a page, remove it with
    the text it was added with and add the new one, in one batch or in two.
    """

    spark: SparkSession
    path: str

    def apply(self, batch: int, added: DataFrame | None = None, removed: DataFrame | None = None) -> None:
        """Count pages that come or go."""
        changes = None
        for pages, sign in ((added, 1), (removed, -1)):
            if pages is not None:
                signed = with_session(pages).select(*DOC, "page", F.coalesce("text", F.lit("")).alias("text"), F.lit(sign).cast("bigint").alias("sign"))
                changes = signed if changes is None else changes.unionByName(signed)
        sign = F.col("sign")
        counts = bit_counts(_parts(changes), [*DOC, "kind", "key", "sign"], "part")
        self._write("sums", bit_sums(counts, [*DOC, "kind", "key"], sign, F.sum("sign").alias("pages")), batch)
        words = _page_words(changes).groupBy(*DOC).agg(*[F.sum(sign * F.col(c)).alias(c) for c in ("n_chars", *_WORDS)], F.sum("sign").alias("pages"))
        self._write("digests", words, batch)

    def _write(self, name: str, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")

    def _sums(self) -> DataFrame:
        """Sums of all batches, the rows of a line key side by side."""
        rows = self.spark.read.parquet(f"{self.path}/sums").drop("batch").repartition(*DOC, "key")
        return bit_sums(rows, [*DOC, "kind", "key"], None, F.sum("pages").alias("pages")).filter("pages <> 0")

    def _lines(self) -> DataFrame:
        """Add to the sums on how many pages a line key comes first (``head``) and last (``tail``)."""
        same = Window.partitionBy(*DOC, "key")
        on = lambda kind: F.sum(F.when(F.col("kind").isin(kind, "only"), F.col("pages")).otherwise(0)).over(same)
        return self._sums().withColumns({"head": on("head"), "tail": on("tail")})

    def repeated_lines(self, min_repeat: int = fv.MIN_REPEAT) -> DataFrame:
        """(session_id, doc_name, position, key, n) as `pages.repeated_lines` of the pages that are there gives."""
        rows = self.spark.read.parquet(f"{self.path}/sums").filter("kind <> 'all'")
        on = lambda kind: F.sum(F.when(F.col("kind").isin(kind, "only"), F.col("pages")).otherwise(0))
        counted = rows.groupBy(*DOC, "key").agg(F.array(*[
            F.struct(F.lit(k).alias("position"), on(k).alias("n")) for k in ("head", "tail")
        ]).alias("p"))
        return counted.select(*DOC, "key", F.inline("p")).filter(F.col("n") >= min_repeat).select(*DOC, "position", "key", "n")

    def hashes(self, min_repeat: int = fv.MIN_REPEAT) -> DataFrame:
        """(session_id, doc_name, pages, hi, lo): `simhash128` of the cleaned pages that are there."""
        head, tail = F.col("head") >= min_repeat, F.col("tail") >= min_repeat
        kind = F.col("kind")
        weight = (
            F.when(kind == "all", 1).when((kind == "head") & head, -1).when((kind == "tail") & tail, -1)
            .when((kind == "only") & (head | tail), -1)
        ).cast("bigint")
        taken = self._lines().withColumn("weight", weight).filter("weight IS NOT NULL")
        pages = F.sum(F.when(kind == "all", F.col("pages"))).alias("pages")
        return halves_of_sums(bit_sums(taken, DOC, F.col("weight"), pages), [*DOC, "pages"])

    def digests(self) -> DataFrame:
        """(session_id, doc_name, pages, n_chars, digest) of the pages as they came.

        ``digest`` is the sum of the pages' SHA-256, word by word modulo 2^32, so
        two documents of the same numbered pages have the same one in whatever
        order and how many batches they came. It stands beside
        `pages.document_digests`, which needs the whole cleaned text in order.
        """
        rows = self.spark.read.parquet(f"{self.path}/digests")
        summed = rows.groupBy(*DOC).agg(*[F.sum(c).alias(c) for c in ("pages", "n_chars", *_WORDS)]).filter("pages <> 0")
        words = [F.lower(F.lpad(F.hex(F.pmod(F.col(w), F.lit(_MOD))), 8, "0")) for w in _WORDS]
        return summed.select(*DOC, "pages", "n_chars", F.concat(*words).alias("digest"))

    def fold(self, into: PageStore) -> None:
        """Write all batches as batch 0 of another, empty store."""
        into._write("sums", self._sums(), 0)
        rows = self.spark.read.parquet(f"{self.path}/digests")
        into._write("digests", rows.groupBy(*DOC).agg(*[F.sum(c).alias(c) for c in ("n_chars", *_WORDS, "pages")]).filter("pages <> 0"), 0)
