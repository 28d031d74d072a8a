"""Document fingerprints, near-duplicates and version tracking.

Registration reads like a loop over uploads, but it is relational: a document
compares with the earlier registered ones whatever their status, so statuses
follow from one nearest-earlier-document join.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType

from trawl.functions import fixed_values as fv
from trawl.functions.text import stem
from trawl.operators.components import components
from trawl.operators.near_hashes import HASH_BITS, HOT_BAND, PRIOR, close_links, close_pairs, nearest_earlier
from trawl.operators.prefix import count_before, min_before
from trawl.session import stage, stage_table, with_session

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class _Digests(dict):
    """MD5 digests of words; those of short ones are kept, up to ``most`` of them."""

    most, longest = 1 << 18, 64

    def __missing__(self, word: str) -> bytes:
        digest = hashlib.md5(word.encode(), usedforsecurity=False).digest()
        if len(word) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[word] = digest
        return digest


# Words expanded to bits at a time, and rows whose bits, a byte each, are summed eight at once without a carry.
_EXPANDED, _NO_CARRY = 1 << 14, 255


def _ones(texts: pa.Array, known: _Digests) -> tuple[np.ndarray, np.ndarray]:
    """Per lower-cased text the number of words, and of digests that set each of the 128 bits."""
    lengths = np.zeros(len(texts), dtype=np.int64)
    ones = np.zeros((len(texts), HASH_BITS), dtype=np.int64)
    for row, text in enumerate(texts):
        words = (text.as_py() or "").split()
        lengths[row] = len(words)
        for at in range(0, len(words), _EXPANDED):
            raw = np.frombuffer(b"".join(map(known.__getitem__, words[at : at + _EXPANDED])), dtype=np.uint8)
            bits = np.unpackbits(raw).reshape(-1, HASH_BITS).view(np.uint64)
            sums = np.add.reduceat(bits, np.arange(0, len(bits), _NO_CARRY), axis=0)
            ones[row] += sums.view(np.uint8).sum(axis=0, dtype=np.int64)
    return lengths, ones


def _lists(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1]
    return pa.ListArray.from_arrays(np.arange(0, rows.size + 1, width, dtype=np.int32), rows.ravel())


def _bit_counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Per lower-cased text its words, and 64 sums: how many digests set bit j (low 32) and bit 64 + j (high 32)."""
    known = _Digests()
    for texts in batches:
        lengths, ones = _ones(texts, known)
        yield _lists(np.concatenate([lengths[:, None], ones[:, :64] + (ones[:, 64:] << 32)], axis=1))


def _halves(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Per lower-cased text the two signed halves of its hash."""
    known = _Digests()
    for texts in batches:
        lengths, ones = _ones(texts, known)
        packed = np.packbits(2 * ones > lengths[:, None], axis=1)
        yield _lists(packed.view(">i8").astype(np.int64))


def _lowered(text: str) -> Column:
    """The text whose words are hashed; lower-casing also replaces bytes that are no UTF-8."""
    return F.lower(F.coalesce(F.col(text), F.lit("")))


def simhash128_rows(texts: DataFrame, text: str = "text") -> DataFrame:
    """Add hi and lo to rows that are whole texts; nothing is shuffled."""
    halves = F.arrow_udf(_halves, ArrayType(LongType()))
    return (
        texts.withColumn("_halves", halves(_lowered(text)))
        .withColumns({"hi": F.get("_halves", F.lit(0)), "lo": F.get("_halves", F.lit(1))}).drop("_halves")
    )


def simhash128(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, hi, lo): 128-bit SimHash of each key's texts as two signed halves.

    Bit counts are additive, so the pages of a document may lie anywhere and are
    summed with partial aggregation; the document text is never put together.
    Two counts share one BIGINT, which halves the aggregation columns.
    """
    return halves_of_sums(bit_sums(bit_counts(texts, keys, text), keys), keys)


SUMS = ["n", *[f"c{j}" for j in range(64)]]


def bit_counts(texts: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """(keep, n, c0 ... c63) of each text: its words, and two to a column how many of their digests set a bit."""
    counts = F.arrow_udf(_bit_counts, ArrayType(LongType()))
    counted = texts.select(*keep, counts(_lowered(text)).alias("c"))
    return counted.select(*keep, *[F.get("c", F.lit(j)).alias(name) for j, name in enumerate(SUMS)])


def bit_sums(counts: DataFrame, keys: list[str], weight: Column | None = None, *more: Column) -> DataFrame:
    """(keys, n, c0 ... c63, more): sums by key, each row taken ``weight`` times."""
    times = (lambda c: F.col(c)) if weight is None else (lambda c: weight * F.col(c))
    return counts.groupBy(*keys).agg(*[F.sum(times(c)).alias(c) for c in SUMS], *more)


def halves_of_sums(sums: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, hi, lo): a bit is set if more than half of the n digests set it."""

    def half(count) -> Column:
        bits = [
            F.when(2 * count(F.col(f"c{j}")) > F.col("n"), F.lit(_signed(1 << (63 - j)))).otherwise(F.lit(0)) for j in range(64)
        ]
        return F.aggregate(F.array(*bits), F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))

    low = lambda c: c.bitwiseAND(F.lit((1 << 32) - 1))
    high = lambda c: F.shiftrightunsigned(c, 32)
    return sums.select(*keep, half(low).alias("hi"), half(high).alias("lo"))


def _signed(v: int) -> int:
    return v - (1 << 64) if v >= 1 << 63 else v


def simhash_hex(hi: Column, lo: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))


def simhash_halves(hexed: Column) -> Column:
    half = lambda start: F.conv(F.substring(hexed, start, 16), 16, -10).cast("bigint")
    return F.struct(half(1).alias("hi"), half(17).alias("lo"))


def hamming(hi_a: Column, lo_a: Column, hi_b: Column, lo_b: Column) -> Column:
    return F.bit_count(hi_a.bitwiseXOR(hi_b)) + F.bit_count(lo_a.bitwiseXOR(lo_b))


def similarity(distance: Column) -> Column:
    return 1.0 - distance / float(HASH_BITS)


def near_hash_pairs(hashes: DataFrame, max_distance: int = fv.MAX_HAMMING, hot: int = HOT_BAND) -> DataFrame:
    """Exact pairs of distinct hashes of a session, 1..max_distance apart.

    Columns session_id, hi_a, lo_a, hi_b, lo_b, distance.
    """
    return close_pairs(with_session(hashes).select("session_id", "hi", "lo").distinct(), max_distance, hot)


def near_duplicate_pairs(docs: DataFrame, max_distance: int = fv.MAX_HAMMING) -> DataFrame:
    """Close pairs of hashes, each hash with its first document and document count.

    Copies with the same hash are one group with a count: their pairs at distance
    0 are not spelled out. The pairs of a crowd of near hashes grow with its square;
    `near_duplicate_documents` tells of the same links in a row for each document.
    """
    groups = stage(
        with_session(docs).groupBy("session_id", "hi", "lo").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n_docs"))
    )
    return close_pairs(groups, max_distance).withColumn("similarity", similarity(F.col("distance")))


def near_duplicate_documents(docs: DataFrame, max_distance: int = fv.MAX_HAMMING, hot: int = HOT_BAND) -> DataFrame:
    """Each of ``docs`` (doc_id, hi, lo) with its class and links to near duplicates; pairs never become rows.

    Two documents of a session are linked if their hashes are at most max_distance
    bits apart. Adds class_id, the smallest doc_id reachable by links; n_copies, other
    documents with the same hash; n_links, those with a hash 1..max_distance away;
    distance and similarity of the closest of these, NULL without one.
    """
    hashed = ["session_id", "hi", "lo"]
    docs = stage_table(with_session(docs))  # read for the groups and for the result
    groups = docs.groupBy(*hashed).agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n_docs"))
    groups = stage(groups.withColumn("node", F.monotonically_increasing_id()))
    found = stage_table(close_links(groups, max_distance, hot))
    links = found.groupBy("node").agg(F.sum("n_links").alias("n_links"), F.min("distance").alias("distance"))
    roots = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    told = stage(
        groups.join(links, "node", "left").join(roots, "node", "left")
        .withColumns({"root": F.coalesce("root", "node"), "n_links": F.coalesce("n_links", F.lit(0))})
    )
    classes = told.groupBy("root").agg(F.min("first_doc").alias("class_id"))
    told = told.join(classes, "root").select(
        *[F.col(c).alias(f"_{c}") for c in hashed], "class_id", (F.col("n_docs") - 1).alias("n_copies"), "n_links", "distance"
    )
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in hashed]
    return docs.join(told, same).drop(*[f"_{c}" for c in hashed]).withColumn("similarity", similarity(F.col("distance")))


_FILE = ["session_id", "doc_id", "file_hash"]


def registered_documents(uploads: DataFrame) -> DataFrame:
    """First upload of every (doc_id, file_hash), with its version number.

    ``uploads``: reg (unique order), filename, file_hash, hi, lo and payload. The
    rows are staged, since hashing texts comes before and the count reads twice.
    """
    named = with_session(uploads).withColumn("doc_id", stem(F.col("filename")))
    rest = [c for c in named.columns if c not in _FILE]
    firsts = stage(
        named.groupBy(*_FILE).agg(F.min_by(F.struct(*rest), "reg").alias("r"))
        .select(*_FILE, "r.*")
    )
    return count_before(firsts, ["session_id", "doc_id"], "reg", "older").withColumn("version", F.col("older") + 1).drop("older")


def exact_duplicates(uploads: DataFrame) -> DataFrame:
    """Uploads whose (doc_id, file_hash) was registered before."""
    named = with_session(uploads).withColumn("doc_id", stem(F.col("filename")))
    first = named.groupBy(*_FILE).agg(F.min("reg").alias("first_reg"))
    return named.join(first, _FILE).filter(F.col("reg") > F.col("first_reg"))


def nearest_prior(registered: DataFrame, max_distance: int = fv.MAX_HAMMING) -> DataFrame:
    """(reg, distance, prior): the closest earlier registered document.

    Ties go to registry order: the document name registered first, then version.
    Equal hashes beat all others, so only the first document of each hash looks
    at other hashes, and there only documents that lower the running registry
    minimum can win. A hash shared by many copies therefore costs one pass.
    A doc_first column, if there is one, tells when each name was first registered.
    """
    registered = with_session(registered)
    if "doc_first" not in registered.columns:
        doc_first = registered.groupBy("session_id", "doc_id").agg(F.min("reg").alias("doc_first"))
        registered = registered.join(doc_first, ["session_id", "doc_id"])
    rows = registered.select("session_id", *PRIOR, "hi", "lo")
    me = F.struct(*PRIOR)
    seen = stage(min_before(rows, ["session_id", "hi", "lo"], "reg", me, "same"))
    same = seen.filter("same IS NOT NULL").select("reg", F.lit(0).alias("distance"), F.col("same").alias("prior"))
    records = seen.filter(F.col("same").isNull() | (me < F.col("same"))).withColumns(
        {"asks": F.col("same").isNull(), "id": F.col("reg"), "turn": F.col("reg")}
    )
    return same.unionByName(nearest_earlier(records, max_distance).withColumnRenamed("id", "reg"))


def classify(sim: Column, filename: Column, matched: Column) -> Column:
    """new / version / duplicate / updated from similarity and the two names."""
    close = sim > fv.VERSION_SIMILARITY
    return (
        F.when(close & (stem(matched) == stem(filename)), "version")
        .when(close, "duplicate")
        .when(sim > fv.UPDATE_SIMILARITY, "updated")
        .otherwise("new")
    )


def registration_message(status: Column, exact: Column, filename: Column, matched: Column, sim: Column) -> Column:
    percent = sim * 100
    return (
        F.when(exact, F.format_string(fv.MSG_EXACT_DUPLICATE, filename))
        .when(status == "version", F.format_string(fv.MSG_VERSION, filename, percent))
        .when(status == "duplicate", F.format_string(fv.MSG_SIMILAR, matched, percent))
        .when(status == "updated", F.format_string(fv.MSG_UPDATED, matched, percent))
        .otherwise(F.format_string(fv.MSG_NEW, filename))
    )


def register(uploads: DataFrame, max_distance: int = fv.MAX_HAMMING) -> DataFrame:
    """The registry after all uploads: one row per registered document.

    Adds doc_id, version, result (new / version / duplicate / updated), message,
    matched_reg, similarity, supersedes, status (active / superseded), superseded_by.
    """
    rows = stage(registered_documents(uploads))  # read by several joins
    prior = stage(nearest_prior(rows, max_distance))  # hashes meet once, for the documents and for what they replace
    return with_status(judged(rows, prior))


def judged(rows: DataFrame, prior: DataFrame) -> DataFrame:
    """Registered documents with what their nearest earlier one (reg, distance, prior) makes of them.

    Adds result, message, matched_reg, matched_name, similarity, supersedes; none
    of it changes when later documents come.
    """
    matched = (
        rows.join(prior, "reg", "left")
        .withColumn("similarity", F.coalesce(similarity(F.col("distance")), F.lit(0.0)))
        .withColumn("matched_reg", F.col("prior.reg"))
        .withColumn("matched_name", F.col("prior.filename"))
        .withColumn("result", classify(F.col("similarity"), F.col("filename"), F.col("matched_name")))
    )
    message = registration_message(F.col("result"), F.lit(False), F.col("filename"), F.col("matched_name"), F.col("similarity"))
    return (
        matched.withColumn("supersedes", F.when(_replaces(), F.array("matched_name")).otherwise(F.array().cast("array<string>")))
        .withColumn("message", message).drop("prior", "distance")
    )


def _replaces() -> Column:
    return F.col("result").isin("version", "updated")


def replacements(matched: DataFrame) -> DataFrame:
    """(reg, doc_id, by): the documents that `judged` ones replace, with the name and number of the newer one."""
    return matched.filter(_replaces()).select(F.col("matched_reg").alias("reg"), "doc_id", F.col("reg").alias("by"))


def with_status(matched: DataFrame, replaced: DataFrame | None = None) -> DataFrame:
    """`judged` documents with status (active / superseded) and superseded_by, the newest that replaces each."""
    replaced = replacements(matched) if replaced is None else replaced
    newest = replaced.groupBy("reg").agg(F.max_by("doc_id", "by").alias("superseded_by"))
    status = F.when(F.col("superseded_by").isNotNull(), "superseded").otherwise("active")
    return matched.join(newest, "reg", "left").withColumn("status", status)


def upload_results(uploads: DataFrame, registry: DataFrame) -> DataFrame:
    """(reg, filename, result, message) of every upload, exact duplicates included."""
    known = registry.select("reg", "filename", "result", "message")
    again = exact_duplicates(uploads).select(
        "reg", "filename", F.lit("duplicate").alias("result"),
        F.format_string(fv.MSG_EXACT_DUPLICATE, F.col("filename")).alias("message"),
    )
    return known.unionByName(again)


def document_metadata(registry: DataFrame) -> DataFrame:
    """Per doc_id its newest active version, else its newest."""
    order = F.struct(F.col("status") == "active", F.col("version"))
    keys = ["session_id", "doc_id"]
    rest = [c for c in registry.columns if c not in keys]
    return registry.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def with_current_status(rows: DataFrame, registry: DataFrame, name: str = "doc_name") -> DataFrame:
    """Replace the status and version a chunk got at ingest by the registry's current ones."""
    now = document_metadata(registry).select(
        "session_id", "doc_id", F.col("status").alias("document_status"), F.col("version").alias("document_version")
    )
    base = with_session(rows.drop("document_status", "document_version")).withColumn("doc_id", stem(F.col(name)))
    return base.join(now, ["session_id", "doc_id"], "left").drop("doc_id")


def active_documents(registry: DataFrame) -> DataFrame:
    return registry.filter(F.col("status") == "active")


def document_statistics(registry: DataFrame, chunk_counts: DataFrame | None = None) -> DataFrame:
    """Totals per session; ``chunk_counts(reg, chunk_count)`` supplies real chunk counts."""
    rows = registry.drop("chunk_count").join(chunk_counts, "reg", "left") if chunk_counts is not None else registry
    is_status = lambda s: F.count_if(F.col("status") == s)
    return rows.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("total_documents"),
        is_status("active").alias("active_documents"),
        is_status("superseded").alias("superseded_documents"),
        is_status("archived").alias("archived_documents"),
        F.coalesce(F.sum(F.when(F.col("status") == "active", F.col("chunk_count"))), F.lit(0)).alias("total_chunks"),
        F.countDistinct("doc_id").alias("unique_filenames"),
    )


def backfill_timestamps(docs: DataFrame, as_of: float, name: str = "filename") -> DataFrame:
    """Upload times set by name: v1 / 2024 thirty days back, v2 / 2025 now, first rule wins.

    Adds ``was_updated``; works for manifest rows and for chunk rows.
    """
    n = F.col(name)
    old = F.lower(n).contains("v1") | n.contains("2024")
    new = F.lower(n).contains("v2") | n.contains("2025")
    return docs.withColumns(
        {
            "upload_timestamp": F.when(old, F.lit(as_of - 30 * 86400.0)).when(new, F.lit(as_of)).otherwise(F.col("upload_timestamp")),
            "was_updated": F.coalesce(old | new, F.lit(False)),
        }
    )
