"""Document fingerprints that tell which paragraphs differ between two versions.

A text is a bag of paragraph pieces: lines, and inside long lines runs of words
that end where a word's hash says so, so that an edit changes few pieces; pieces
of more than 32 KB are cut again inside words. The
pieces' digests, each with its length, go into an invertible Bloom lookup sketch.
Sketches of two versions are subtracted cell by cell; peeling the cells that hold
one digest recovers the digests that differ. If cells are left over, both
sketches are made twice as large and peeled again.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.session import stage_table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Cells in each of a stored sketch's three parts.
STORED = 8
#: A word ends a piece if its hash is divisible by this: pieces of eight words on average.
_WORDS = np.uint64(8)
#: Longer pieces are cut again where the hash of the last bytes says so, 4096 on average, and at this length.
_LONGEST, _WINDOW, _SPOTS = 1 << 15, 64, np.uint64(4096)
#: Bytes cut into pieces at a time, and bytes of text compared together.
_SLICE, _TOGETHER = 1 << 20, 4 << 20

_ODD = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_SALTS = [np.uint64(s) for s in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_CODE = _mixed(np.arange(1, 257, dtype=np.uint64) * _ODD)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    known = _POWERS.get(int(base))
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 14), base, np.uint64)
        known[0] = 1
        known = _POWERS[int(base)] = np.multiply.accumulate(known)
    return known[:n]


def _divided(sums: np.ndarray, back: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """ends, with more of them inside pieces above `_LONGEST` bytes; they depend on the piece alone."""
    cuts = []
    begins = np.concatenate([[0], ends[:-1]])[: len(ends)]
    for i in np.flatnonzero(ends - begins > _LONGEST):
        at, end = int(begins[i]), int(ends[i])
        windows = _mixed((sums[at + _WINDOW : end] - sums[at : end - _WINDOW]) * back[at : end - _WINDOW])
        spots = np.append(np.flatnonzero(windows % _SPOTS == 0) + at + _WINDOW, end)
        while at < end:
            at = min(int(spots[np.searchsorted(spots, min(at + _WINDOW, end))]), at + _LONGEST)
            cuts.append(at)
    return np.unique(np.concatenate([ends, cuts]).astype(np.int64)) if cuts else ends


def _cut(data: np.ndarray, final: bool) -> tuple[np.ndarray, int]:
    """(digests, bytes used) of the pieces of a byte array; without final the last, open one is left."""
    n = len(data)
    space = _SPACE[data]
    word_ends = np.flatnonzero(~space & np.append(space[1:], final)) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_CODE[data] * _powers(_ODD, n), out=sums[1:])
    back = _powers(_INVERSE, n + 1)
    word_starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))[: len(word_ends)]
    words = _mixed((sums[word_ends] - sums[word_starts]) * back[word_starts])
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    ends = word_ends[(words % _WORDS == 0) | np.append(lines[word_starts[1:]] > lines[word_ends[: max(len(word_ends) - 1, 0)]], False)[: len(word_ends)]]
    if final and n and (not len(ends) or ends[-1] < n):
        ends = np.append(ends, n)
    ends = _divided(sums, back, ends)
    begins = np.concatenate([[0], ends[:-1]])[: len(ends)]
    sizes = (ends - begins).astype(np.uint64)
    hashes = _mixed((sums[ends] - sums[begins]) * back[begins] + sizes * _SALTS[1])
    return (hashes << np.uint64(16)) | sizes, int(ends[-1]) if len(ends) else 0


def digests(raw: bytes) -> np.ndarray:
    """64-bit digests of the pieces of a text: 48 bits of content and 16 of length in bytes.

    The n-th copy of a piece has a digest of its own, so equal digests never meet.
    """
    found, at, step = [], 0, _SLICE
    while at < len(raw):
        part = np.frombuffer(raw[at : at + step], np.uint8)
        keys, used = _cut(part, at + step >= len(raw))
        if not used:
            step *= 2
            continue
        found.append(keys)
        at, step = at + used, _SLICE
    keys = np.concatenate(found) if found else np.zeros(0, np.uint64)
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(keys)]
    place = np.arange(len(keys))
    copy = (place - np.maximum.accumulate(np.where(fresh, place, 0))).astype(np.uint64)
    again = copy > 0
    low = np.uint64(0xFFFF)
    ordered[again] = (_mixed(ordered[again] + copy[again] * _SALTS[2]) & ~low) | (ordered[again] & low)
    return ordered


def _cells(keys: np.ndarray, size: int) -> np.ndarray:
    """The cell of each key in each of the three parts."""
    return np.stack([(_mixed(keys * s) & np.uint64(size - 1)).astype(np.int64) + i * size for i, s in enumerate(_SALTS)])


def _check(keys: np.ndarray) -> np.ndarray:
    return _mixed(keys + _SALTS[0]) & np.uint64(0xFFFFFFFF)


def sketch(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(counts, xor of digests, xor of checks) of 3 x size cells; size is a power of two."""
    return _filled(keys, np.ones(len(keys), np.int64), np.zeros(len(keys), np.int64), 1, size)


def _filled(keys: np.ndarray, signs: np.ndarray, owners: np.ndarray, n: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sketches of n owners side by side; a digest with sign -1 is subtracted."""
    cells = (_cells(keys, size) + owners * (3 * size)).ravel()
    counts = np.bincount(cells, np.tile(signs, 3), n * 3 * size).astype(np.int64)
    xors, checks = np.zeros(n * 3 * size, np.uint64), np.zeros(n * 3 * size, np.uint64)
    np.bitwise_xor.at(xors, cells, np.tile(keys, 3))
    np.bitwise_xor.at(checks, cells, np.tile(_check(keys), 3))
    return counts, xors, checks


def peel(counts: np.ndarray, xors: np.ndarray, checks: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, signs, owners, done): digests recovered from subtracted sketches side by side, and which came out empty.

    The arrays are used up.
    """
    keys, signs, owners = [], [], []
    n = len(counts) // (3 * size)
    live = np.flatnonzero(counts != 0)
    while len(live):
        pure = live[(np.abs(counts[live]) == 1) & (_check(xors[live]) == checks[live])]
        if not len(pure):
            break
        key, sign, owner = xors[pure], counts[pure], pure // (3 * size)
        cells = _cells(key, size) + owner * (3 * size)
        single = np.zeros(len(counts), bool)
        single[pure] = True
        twins = np.where(single[cells] & (xors[cells] == key), cells, len(counts))
        first = (twins.min(axis=0) == pure) & (cells == pure).any(axis=0)
        if not first.any():
            break
        key, sign, owner, cells = key[first], sign[first], owner[first], cells[:, first].ravel()
        np.subtract.at(counts, cells, np.tile(sign, 3))
        np.bitwise_xor.at(xors, cells, np.tile(key, 3))
        np.bitwise_xor.at(checks, cells, np.tile(_check(key), 3))
        keys.append(key), signs.append(sign), owners.append(owner)
        single[:] = False  # only cells that were touched can have become pure
        single[cells] = True
        live = np.flatnonzero(single)
        live = live[counts[live] != 0]
    left = (counts != 0) | (xors != 0)
    done = ~left.reshape(n, 3 * size).any(axis=1)
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return join(keys, np.uint64), join(signs, np.int64), join(owners, np.int64), done


def likenesses(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """1 - differing bytes / all bytes of each pair of digest lists, from peeled sketches; 1 for two empty ones."""
    low = np.uint64(0xFFFF)
    total = np.array([int((a & low).sum() + (b & low).sum()) for a, b in pairs], np.float64)
    out = np.ones(len(pairs))
    sizes = np.array([max(STORED, 1 << max(0, (len(a) + len(b)) // 8).bit_length()) for a, b in pairs])
    todo = np.flatnonzero(total > 0)
    while len(todo):
        again = []
        for size in np.unique(sizes[todo]).tolist():
            group = todo[sizes[todo] == size]
            parts = [x for i in group for x in pairs[i]]
            lengths = np.array([len(p) for p in parts])
            owners = np.repeat(np.repeat(np.arange(len(group)), 2), lengths)
            signs = np.repeat(np.tile([1, -1], len(group)), lengths)
            keys, _, found, done = peel(*_filled(np.concatenate(parts), signs, owners, len(group), size), size)
            differing = np.bincount(found, (keys & low).astype(np.float64), len(group))
            out[group[done]] = 1 - differing[done] / total[group[done]]
            sizes[group[~done]] *= 2
            again.append(group[~done])
        todo = np.concatenate(again)
    return np.clip(out, 0.0, 1.0)


def fingerprint(keys: np.ndarray) -> str:
    """The stored sketch of a digest list, with the number of pieces and bytes before it."""
    counts, xors, checks = sketch(keys, STORED)
    packed = counts.astype("<u4").tobytes() + xors.astype("<u8").tobytes() + checks.astype("<u4").tobytes()
    size = int((keys & np.uint64(0xFFFF)).sum())
    return f"{len(keys):x}.{size:x}.{base64.b64encode(packed).decode()}"


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """docs with the fingerprint of each whole text; null counts as empty. A column of that name is replaced."""

    def made(batch: pa.Array) -> pa.Array:
        return pa.array([fingerprint(digests((t.as_py() or "").encode())) for t in batch], pa.string())

    return docs.withColumn(out, F.arrow_udf(made, "string")(F.col(f"`{text}`")))


_SCHEMA = "key {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _edited_rows():
    names = ["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def settle(rows: list[tuple], key_type: pa.DataType) -> pa.RecordBatch:
        own, others, edits, out = [], [], [], []
        last, known = None, None
        for key, text, following in rows:
            n = len(text)
            edited = (text[: n - n // 2] + following[: n // 2]).encode()
            own.append(known if last is text else digests(text.encode()))
            last, known = following, digests(following.encode())
            others.append(known)
            edits.append(digests(edited))
            out.append((key, n, hashlib.sha256(edited).hexdigest()))
        near = likenesses([*zip(own, edits), *zip(own, others)])
        prints, edited_prints = [fingerprint(k) for k in own], [fingerprint(k) for k in edits]
        columns = [[r[0] for r in out], [r[1] for r in out], [r[2] for r in out], prints, edited_prints, near[: len(rows)], near[len(rows) :]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [key_type, *kinds])], names)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        ready: list[tuple] = []
        size, key_type = 0, pa.null()
        for batch in batches:
            key_type = batch.schema.field(2).type
            for bucket, ahead, key, text in zip(*[batch.column(i) for i in range(4)]):
                now = (bucket.as_py(), key.as_py(), text.as_py())
                if held is not None and held[0] == now[0]:
                    ready.append((held[1], held[2], now[2]))
                    size += len(held[2])
                    if size > _TOGETHER or len(ready) >= 2048:
                        yield settle(ready, key_type)
                        ready, size = [], 0
                held = None if ahead.as_py() else now
        if ready:
            yield settle(ready, key_type)

    return rows


def edited_likeness(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next): one row per row of docs.

    The edited text has the last half of its code points, rounded down, replaced
    by the first as many of the next document, or all it has. Documents follow
    one another by key, null first, then by text; after the last comes the first.
    near_edited and near_next are the likenesses to the edited text and to the
    next document. The key is a number. Null texts count as empty; an empty
    table gives no rows; other columns are ignored.

    Texts are shuffled once, to ranges of keys whose bounds are read off the keys
    alone, one range a task and as many as docs has partitions, and each range also gets the first row of the next one.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    ranged = rows.select("k").filter("k is not null").repartitionByRange(parts, "k")
    bounds = [r.low for r in ranged.groupBy(F.spark_partition_id().alias("p")).agg(F.min("k").alias("low")).orderBy("low").collect()][1:]
    edges = np.array(bounds, np.float64 if any(isinstance(b, float) for b in bounds) else np.int64)

    def bucket_of(keys: pa.Array) -> pa.Array:
        place = np.searchsorted(edges, np.array([edges[0] if k is None else k for k in keys.to_pylist()]), "right") if len(edges) else np.zeros(len(keys), int)
        return pa.array(np.where(np.asarray(keys.is_null()), 0, place), pa.int32())

    placed = rows.withColumn("bucket", F.arrow_udf(bucket_of, "int")("k")) if bounds else rows.withColumn("bucket", F.lit(0))
    lowest = placed.filter(F.col("k").isin(bounds) | (F.col("bucket") == 0)) if bounds else placed
    firsts = lowest.groupBy("bucket").agg(F.min(F.struct("k", "t")).alias("least"))
    firsts = stage_table(firsts.select("bucket", "least.k", "least.t"))
    ahead = firsts.select(F.when(F.col("bucket") == 0, len(bounds)).otherwise(F.col("bucket") - 1).cast("int").alias("bucket"), F.lit(True).alias("ahead"), "k", "t")
    both = placed.select("bucket", F.lit(False).alias("ahead"), "k", "t").union(ahead)
    ordered = both.repartitionById(parts, F.col("bucket")).sortWithinPartitions("bucket", "ahead", "k", "t")
    out = ordered.mapInArrow(_edited_rows(), _SCHEMA.format(kind=docs.schema[key].dataType.simpleString()))
    return out.withColumnRenamed("key", key)
