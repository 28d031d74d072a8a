"""SimHash near-duplicates: fingerprints, their segment-popcount grid, groups.

A fingerprint is cut into segments and mapped to its bit count per segment. The
Manhattan distance of two such vectors never exceeds the Hamming distance of the
fingerprints, so a range join on the grid of vectors loses no pair. The grid is
joined by meeting half way: each side enters its own cell and the cells within
half of the allowed distance, and two vectors within the allowed distance share
such a cell. What meets is then verified on the fingerprints.

A 64-bit fingerprint that differs in two bits stands for nearly equal texts only.
`similar_groups` finds texts that share most of their shingles: besides the
fingerprint of the whole text, each text has fingerprints of small samples of its
shingles, drawn alike for all texts; similar texts agree on some of them. All
that meets is verified on the whole sets of shingles.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.llm.components import components
from trawl.llm.memory import release
from trawl.session import shuffled, stage_table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A-Z to a-z, nothing else.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Words hashed at a time, which bounds memory for very long texts.
_BLOCK = 1 << 16


def words_of(text: str | None) -> list[bytes]:
    """UTF-8 words between space, tab, LF, VT, FF and CR, with A-Z lower-cased."""
    return [] if text is None else text.encode().translate(_LOWER).split()


def shingle_hashes(words: list[bytes], size: int, seed: int = 42) -> Iterator[np.ndarray]:
    """XXH64 of each run of `size` words, repeats included, in blocks; a shorter text is one shingle."""
    from xxhash import xxh64_intdigest

    if 0 < len(words) < size:
        yield np.array([xxh64_intdigest(b" ".join(words), seed)], np.uint64)
        return
    for first in range(0, len(words) - size + 1, _BLOCK):
        part = words[first : first + _BLOCK + size - 1]
        ends = np.cumsum([len(w) + 1 for w in part])
        starts = np.concatenate([[0], ends[:-1]]).tolist()
        joined, stops = b" ".join(part), (ends - 1)[size - 1 :].tolist()
        yield np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, stops)], np.uint64)


def fingerprint(text: str | None, size: int, seed: int = 42) -> int:
    """Signed 64-bit SimHash: a bit is 1 if over half of the shingle hashes have it."""
    ones, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(words_of(text), size, seed):
        ones += np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def with_fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Add a BIGINT SimHash of each whole text; a null or wordless text has 0."""

    def hashed(batch: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t.as_py(), words, seed) for t in batch], pa.int64())

    return docs.withColumn(out, F.arrow_udf(hashed, "bigint")(F.col(text)))


def segment_counts(fp: Column, width: int) -> Column:
    """Bit counts of the 64 / width segments, each packed into its own `width` bits; width is 2, 4 or 8."""
    m = F.lit(0x5555555555555555)
    odd, even = F.shiftrightunsigned(fp, 1).bitwiseAND(m), fp.bitwiseAND(m)
    c = F.shiftleft(odd.bitwiseAND(even), 1).bitwiseOR(odd.bitwiseXOR(even))
    if width >= 4:
        m = F.lit(0x3333333333333333)
        c = c.bitwiseAND(m) + F.shiftrightunsigned(c, 2).bitwiseAND(m)
    if width == 8:
        c = (c + F.shiftrightunsigned(c, 4)).bitwiseAND(F.lit(0x0F0F0F0F0F0F0F0F))
    return c


def _neighbours(cells: Column, width: int) -> Column:
    """The cells and all that differ by one in one segment; counts stay within 0 and width."""

    def around(cell: Column) -> Column:
        def step(i: Column) -> Column:
            at = i * width
            count = F.call_function("shiftrightunsigned", cell, at).bitwiseAND(F.lit((1 << width) - 1))
            rest = cell.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit((1 << width) - 1).cast("bigint"), at)))

            def put(n: Column) -> Column:
                return rest.bitwiseOR(F.call_function("shiftleft", n, at))

            return F.array(F.when(count < width, put(count + 1)), F.when(count > 0, put(count - 1)))

        steps = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(64 // width - 1)), step))
        return F.concat(F.array(cell), F.filter(steps, lambda x: x.isNotNull()))

    return F.array_distinct(F.flatten(F.transform(cells, around)))


def linked_fingerprints(fingerprints: DataFrame, max_bits: int, width: int = 2) -> DataFrame:
    """(a, b), a < b: pairs of the distinct BIGINTs of column `fp` that differ in at most max_bits bits.

    With two-bit segments a fingerprint enters 49 cells on average at
    max_bits = 2, and a cell gathers only fingerprints that are equal up to
    swaps inside segments, so a large group of copies does not crowd a cell.
    """
    cells = F.array(segment_counts(F.col("fp"), width))
    for _ in range((max_bits + 1) // 2):
        cells = _neighbours(cells, width)
    keyed = fingerprints.select("fp", F.explode(cells).alias("cell"))
    left, right = keyed.select("cell", F.col("fp").alias("a")), keyed.select("cell", F.col("fp").alias("b"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    met = shuffled(left).join(shuffled(right), (left["cell"] == right["cell"]) & near).select("a", "b")
    return met.distinct()


def near_duplicate_groups(docs: DataFrame, words: int = 3, max_bits: int = 2, key: str = "doc_id", text: str = "text", width: int = 2) -> DataFrame:
    """(key, fingerprint BIGINT, component): one row per row of docs.

    component is the smallest key reachable over links between fingerprints that
    differ in at most max_bits bits; nulls are passed over, so it is null only if
    all keys of the component are. Exact copies meet as one fingerprint before
    anything is paired. Null and wordless texts have fingerprint 0 and link like
    any other; repeated rows stay repeated; an empty table gives no rows; other
    columns of docs, whatever their names, are ignored.
    """
    hashed = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    rows = stage_table(with_fingerprints(hashed, words, text="t", out="fp").select("k", "fp"))
    distinct = stage_table(rows.groupBy("fp").agg(F.min("k").alias("least")))
    found = components(linked_fingerprints(distinct, max_bits, width))
    rooted = distinct.join(shuffled(found.withColumnRenamed("node", "fp")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = stage_table(rooted)
    grouped = rooted.groupBy("root").agg(F.min("least").alias("component"))
    named = rooted.join(grouped, "root").select("fp", "component")
    return rows.join(shuffled(named), "fp").select(F.col("k").alias(key), F.col("fp").alias("fingerprint"), "component")


#: Sampled fingerprints of a text, and shingles in each sample.
VIEWS, SAMPLE = 20, 4
_SEEDS = np.random.default_rng(20).integers(1, 1 << 63, VIEWS * SAMPLE, dtype=np.uint64)[:, None]


def sampled_fingerprints(text: str | None, size: int) -> list[int]:
    """The SimHash of the whole text and of VIEWS samples: the shingles that come first under SAMPLE random orders each."""
    first = np.full(VIEWS * SAMPLE, np.iinfo(np.uint64).max, np.uint64)
    ones, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(words_of(text), size):
        ones += np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
        n += len(hashes)
        for at in range(0, len(hashes), 2048):
            mixed = (hashes[None, at : at + 2048] ^ _SEEDS) * np.uint64(0x9E3779B97F4A7C15)
            np.minimum(first, mixed.min(axis=1), out=first)
    bits = np.unpackbits(first.astype(">u8").view(np.uint8)).reshape(VIEWS, SAMPLE, 64).sum(axis=1) * 2 > SAMPLE
    rows = np.packbits(np.concatenate([(2 * ones > n)[None, :], bits]), axis=1)
    return rows.view(">i8").ravel().tolist()


def _shingle_sets(size: int):
    def sets(batch: pa.Array) -> pa.Array:
        out = []
        for text in batch:
            parts = list(shingle_hashes(words_of(text.as_py()), size))
            out.append(np.unique(np.concatenate(parts)).view(np.int64) if parts else np.zeros(0, np.int64))
        found = pa.array(out, pa.list_(pa.int64()))
        release()
        return found

    return F.arrow_udf(sets, "array<bigint>")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets have at least this Jaccard similarity."""
    ends = [shuffled(sets.select(F.col("t").alias(c), F.col("s").alias(f"s{c}"))) for c in "ab"]
    met = pairs.join(ends[0], "a").join(ends[1], "b")
    both = F.size(F.array_intersect("sa", "sb"))
    return met.filter(both >= F.lit(similarity) * (F.size("sa") + F.size("sb") - both)).select("a", "b")


#: Members and bytes of shingle hashes of a bucket that one task compares with as many others.
_BLOCK_MEMBERS, _BLOCK_BYTES = 1024, 4 << 20


def _linked_in_block(similarity: float):
    """Of a block pair's members (t, root, s, block; i and j name the pair), links that join different components.

    Shingles that occur once in the pair are in no intersection; the others make
    a 0/1 matrix, whose products are all intersections. Only links that join two
    components that were apart until then come out, never the pairs.
    """

    def found(rows: pd.DataFrame) -> pd.DataFrame:
        i, j = int(rows["i"].iloc[0]), int(rows["j"].iloc[0])
        rows = rows.sort_values(["block", "t"])
        sets = [np.frombuffer(s, np.int64) for s in rows["s"]]
        sizes, blocks = np.array([len(s) for s in sets]), rows["block"].to_numpy()
        names, roots = rows["t"].tolist(), rows["root"].tolist()
        parent = {r: r for r in roots}

        def top(r: bytes) -> bytes:
            while parent[r] != r:
                parent[r] = parent[parent[r]]
                r = parent[r]
            return r

        values, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        column = np.cumsum(count > 1) - 1
        common = count[place] > 1
        row_of, column_of = np.repeat(np.arange(len(sets)), sizes)[common], column[place[common]]
        width = int(column[-1]) + 1 if len(column) else 0
        left, right = np.flatnonzero(blocks == i), np.flatnonzero(blocks == j)
        shared, matrix = np.zeros((len(left), len(right)), np.float32), None
        at = np.zeros(len(sets), np.int64)
        at[left] = np.arange(len(left))
        for start in range(0, width, 2048):
            part = (column_of >= start) & (column_of < start + 2048)
            matrix = np.zeros((len(sets), min(2048, width - start)), np.float32)
            matrix[row_of[part], column_of[part] - start] = 1
            shared += matrix[left] @ matrix[right].T
        linked = shared >= similarity * (sizes[left][:, None] + sizes[right][None, :] - shared) - 1e-3
        pairs = []
        for x, y in zip(*np.nonzero(linked)):
            a, b, n = left[x], right[y], int(shared[x, y])
            if a != b and n >= similarity * (int(sizes[a]) + int(sizes[b]) - n):
                p, q = top(roots[a]), top(roots[b])
                if p != q:
                    parent[p] = q
                    pairs.append((names[a], names[b]))
        del values, place, count, matrix, shared, linked
        release()
        return pd.DataFrame(pairs, columns=["a", "b"])

    return found


def _links_across(shared: DataFrame, found: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links that the buckets' members have beside those to their leaders, where members are of different components."""
    rooted = shared.filter("n > 2 and not leads").join(shuffled(found.withColumnRenamed("node", "t")), "t", "left").withColumn("root", F.coalesce("root", "t"))
    open_ = rooted.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("bucket")
    packed = F.arrow_udf(lambda batch: pa.array([np.asarray(s.values.to_numpy(zero_copy_only=False), np.int64).tobytes() for s in batch], pa.binary()), "binary")
    members = stage_table(rooted.join(open_, "bucket").join(sets.select("t", F.size("s").alias("m")), "t").select("bucket", "t", "root", "m"))
    blocks = members.groupBy("bucket").agg(
        F.greatest(F.ceil(F.count("*") / _BLOCK_MEMBERS), F.ceil(F.sum(F.col("m") * 8) / _BLOCK_BYTES)).cast("int").alias("blocks")
    ).filter("blocks > 1")  # few, as each of those is full
    placed = members.join(F.broadcast(blocks), "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("t"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    paired = placed.withColumn("other", other).select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "t", "root", "block")
    full = paired.join(shuffled(sets.select("t", packed("s").alias("s"))), "t")
    return full.groupBy("bucket", "i", "j").applyInPandas(_linked_in_block(similarity), "a binary, b binary")


def similar_texts(texts: DataFrame, words: int = 5, similarity: float = 0.8, max_bits: int = 2) -> DataFrame:
    """(node, root): digests of different texts whose word-shingle sets have this Jaccard similarity, directly or over others.

    texts holds (t BINARY digest, text). Copies count once. Who shares a sampled
    fingerprint is compared with the bucket's most central member, the one that
    shares most buckets with others. Buckets that hold several components after
    that are compared in full, in blocks inside tasks.
    """
    def sampled(batch: pa.Array) -> pa.Array:
        found = pa.array([sampled_fingerprints(t.as_py(), words) for t in batch], pa.list_(pa.int64()))
        release()
        return found

    hashed = texts.withColumn("f", F.arrow_udf(sampled, "array<bigint>")("text"))
    signed = stage_table(hashed.select("t", "f").groupBy("t").agg(F.first("f").alias("f")))
    shared = signed.select("t", F.posexplode("f").alias("view", "fp")).select("t", F.xxhash64("view", "fp").alias("bucket"))
    sizes = shared.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    shared = stage_table(shared.join(shuffled(sizes), "bucket"))
    whole = stage_table(signed.select("t", F.get("f", F.lit(0)).alias("fp")).groupBy("fp").agg(F.min("t").alias("t")))
    linked = linked_fingerprints(whole, max_bits)
    ends = whole.select(F.col("fp").alias("a"), F.col("t").alias("ta")), whole.select(F.col("fp").alias("b"), F.col("t").alias("tb"))
    near = stage_table(linked.join(shuffled(ends[0]), "a").join(shuffled(ends[1]), "b").select(F.col("ta").alias("a"), F.col("tb").alias("b")))
    involved = shared.select("t").union(near.select("a")).union(near.select("b")).distinct()
    sets = texts.dropDuplicates(["t"]).join(shuffled(involved), "t", "left_semi").select("t", _shingle_sets(words)("text").alias("s"))
    sets = stage_table(sets)
    central = shared.groupBy("t").agg(F.sum("n").alias("central"))
    weighed = shared.join(shuffled(central), "t")
    lead = weighed.groupBy("bucket").agg(F.max_by("t", F.struct("central", "t")).alias("a"))
    shared = stage_table(shared.join(lead, "bucket").withColumn("leads", F.col("a") == F.col("t")))
    pairs = shared.filter("not leads").select("a", F.col("t").alias("b")).union(near).distinct()
    links = stage_table(_verified(pairs, sets, similarity))
    found = stage_table(components(links))
    across = stage_table(_links_across(shared, found, sets, similarity))
    return components(links.union(across))


def one_of_each_group(docs: DataFrame, words: int = 5, similarity: float = 0.8, max_bits: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay when one row of each group of similar texts does: the one with the smallest key.

    Equal texts are one group, null and empty ones too. A null key comes after
    all others. Of rows with equal key and text any one stays. All columns are
    kept as they are; an empty table stays empty.
    """
    digest = F.unhex(F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")))
    rows = stage_table(docs.select(F.col(f"`{key}`").alias("k"), digest.alias("t")).groupBy("k", "t").agg(F.count("*").alias("n")))
    groups = similar_texts(docs.select(digest.alias("t"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")), words, similarity, max_bits)
    rooted = rows.join(shuffled(groups.withColumnRenamed("node", "t")), "t", "left").withColumn("root", F.coalesce("root", "t"))
    kept = rooted.groupBy("root").agg(F.min(F.struct(F.col("k").isNull().alias("none"), "k", "t", "n")).alias("least"))
    kept = stage_table(kept.select(F.col("least.k").alias("_k"), F.col("least.t").alias("_t"), F.col("least.n").alias("_n")))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])  # so that no column's name meets those used here
    rows = docs.select(whole.alias("row"), F.col(f"`{key}`").alias("key"), digest.alias("digest"))
    staying = rows.join(shuffled(kept), F.col("key").eqNullSafe(F.col("_k")) & (F.col("digest") == F.col("_t")))
    single, repeated = staying.filter("_n = 1"), staying.filter("_n > 1").dropDuplicates(["_k", "_t"])
    return single.union(repeated).select("row.*")
