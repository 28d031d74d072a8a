"""128-bit hashes that lie close together, exact, without a row for each candidate.

Two hashes at most r bits apart agree on at least one of r + 1 bands, so a hash is
dealt to one bucket for each band. A bucket of more than ``hot`` rows is cut into
blocks, and each two of its blocks meet in a cell of their own. Cells come to the
tasks sorted and are compared there in small tiles; only pairs, the best row of each
asking one, or what a row's links add up to leave a task.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from trawl.session import stage_table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

HASH_BITS = 128
#: Rows of a bucket that one side of a cell holds.
HOT_BAND = 1 << 16
# A tile's temporaries stay in a core's cache.
_ROWS, _COLUMNS, _PAIRS = 128, 512, 1 << 16
_BUCKET = ["session_id", "band"]
_CELL = [*_BUCKET, "cell"]


def _cuts(max_distance: int) -> list[tuple[int, int]]:
    """First bit and end of each band; bit 0 is the highest of hi. Three at least, so that a key fits a BIGINT."""
    bands = max(max_distance + 1, 3)
    at = [round(i * HASH_BITS / bands) for i in range(bands + 1)]
    return list(zip(at[:-1], at[1:]))


def band_keys(max_distance: int) -> Column:
    """One key for each band of the columns hi and lo; its low seven bits number the band."""
    cut = lambda half, low, width: F.shiftrightunsigned(half, low).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))
    keys = []
    for i, (a, b) in enumerate(_cuts(max_distance)):
        if b <= 64:
            value = cut("hi", 64 - b, b - a)
        elif a >= 64:
            value = cut("lo", 128 - b, b - a)
        else:
            value = cut("hi", 0, 64 - a) * (1 << (b - 64)) + cut("lo", 128 - b, b - 64)
        keys.append(value * 128 + i)
    return F.array(*keys)


def _masks(max_distance: int) -> np.ndarray:
    """The bits of each band, as two halves."""
    bits = np.zeros((max(max_distance + 1, 3), HASH_BITS), dtype=np.uint8)
    for i, (a, b) in enumerate(_cuts(max_distance)):
        bits[i, a:b] = 1
    return np.packbits(bits, axis=1).view(">u8").astype(np.uint64)


def _dealt(rows: DataFrame, max_distance: int, hot: int) -> DataFrame:
    """Rows by cell; ``side`` 0 and 1 are the two blocks of a cell, 2 is a block that meets itself."""
    keyed = rows.dropna(subset=["session_id", "hi", "lo"]).withColumn("band", F.explode(band_keys(max_distance)))
    crowded = keyed.groupBy(*_BUCKET).count().filter(F.col("count") > hot)
    crowded = stage_table(crowded.select(*_BUCKET, F.ceil(F.col("count") / hot).alias("_n")))  # one in `hot` rows at most
    blocks = F.coalesce("_n", F.lit(1))
    placed = keyed.join(F.broadcast(crowded), _BUCKET, "left").withColumn("_own", F.pmod(F.xxhash64("hi", "lo"), blocks))
    met = placed.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
    own, other = F.col("_own"), F.col("_other")
    met = met.withColumns({
        "cell": F.least(own, other) * (1 << 31) + F.greatest(own, other),
        "side": F.when(own == other, 2).when(own < other, 0).otherwise(1),
    }).drop("_n", "_own", "_other")
    spark = rows.sparkSession
    parts = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return met.repartition(parts, *_CELL).sortWithinPartitions(*_CELL)


def _cells(batches):
    """The rows of each cell that has two or more, from batches sorted by cell."""
    rest: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = (t if rest is None else pa.concat_tables([rest, t])).combine_chunks()
        new = np.zeros(max(t.num_rows - 1, 0), dtype=bool)
        for c in _CELL:
            new |= pc.not_equal(t[c][1:], t[c][:-1]).to_numpy()
        starts = np.concatenate([[0], np.flatnonzero(new) + 1])
        for a, b in zip(starts[:-1], starts[1:]):
            if b - a > 1:
                yield t.slice(a, b - a)
        rest = t.slice(starts[-1])
    if rest is not None and rest.num_rows > 1:
        yield rest


def _bits(t: pa.Table) -> np.ndarray:
    return np.stack([t[c].to_numpy().view(np.uint64) for c in ("hi", "lo")])


class _Tile:
    """Distances of the rows of two blocks; the arrays are kept from tile to tile."""

    def __init__(self):
        self.xor = np.empty(_ROWS * _COLUMNS, dtype=np.uint64)
        self.counts = np.empty((2, _ROWS * _COLUMNS), dtype=np.uint8)

    def distances(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        shape = (a.shape[1], b.shape[1])
        size = shape[0] * shape[1]
        xor, counts = self.xor[:size].reshape(shape), self.counts[:, :size].reshape(2, *shape)
        for half in (0, 1):
            np.bitwise_xor(a[half][:, None], b[half][None, :], out=xor)
            np.bitwise_count(xor, out=counts[half])
        return np.add(counts[0], counts[1], out=counts[0])


def _sides(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    side = t["side"].to_numpy()
    return np.flatnonzero(side != 1), np.flatnonzero(side != 0)


def _close_in(t: pa.Table, max_distance: int, masks: np.ndarray):
    """(positions, positions, distances) of a cell's close rows whose first common band is the cell's."""
    bits = _bits(t)
    left, right = _sides(t)
    tile, itself, earlier = _Tile(), t["side"][0].as_py() == 2, masks[: t["band"][0].as_py() % 128]
    for a in range(0, len(left), _ROWS):
        i = left[a : a + _ROWS]
        for b in range(a if itself else 0, len(right), _COLUMNS):
            j = right[b : b + _COLUMNS]
            d = tile.distances(bits[:, i], bits[:, j])
            r, c = np.nonzero(d <= max_distance)
            r, c, d = i[r], j[c], d[r, c]
            keep = (r < c) & (d > 0) if itself else d > 0
            for mask in earlier:
                keep &= (((bits[:, r] ^ bits[:, c]) & mask[:, None]) != 0).any(axis=0)
            if keep.any():
                yield r[keep], c[keep], d[keep]


def _gathered(found):
    """The same positions and distances, many pairs at a time."""
    kept = []
    for pairs in found:
        kept.append(pairs)
        if sum(len(x[0]) for x in kept) >= _PAIRS:
            yield tuple(np.concatenate(x) for x in zip(*kept))
            kept = []
    if kept:
        yield tuple(np.concatenate(x) for x in zip(*kept))


def close_pairs(rows: DataFrame, max_distance: int, hot: int = HOT_BAND) -> DataFrame:
    """All pairs of rows of a session 1..max_distance bits apart, each once.

    ``rows``: session_id, hi, lo (together unique) and others. Result: session_id,
    every other column as _a and _b, distance; a has the smaller (hi, lo).
    """
    rest = [c for c in rows.columns if c != "session_id"]
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(["session_id string", *[f"{c}_{s} {kind[c]}" for s in "ab" for c in rest], "distance int"])
    masks = _masks(max_distance)

    def made(t: pa.Table, r: np.ndarray, c: np.ndarray, d: np.ndarray) -> list[pa.RecordBatch]:
        hi, lo = t["hi"].to_numpy(), t["lo"].to_numpy()
        swap = (hi[r] > hi[c]) | ((hi[r] == hi[c]) & (lo[r] > lo[c]))
        a, b = t.take(np.where(swap, c, r)), t.take(np.where(swap, r, c))
        columns = {"session_id": a["session_id"]} | {f"{c}_{s}": x[c] for s, x in (("a", a), ("b", b)) for c in rest}
        return pa.table(columns | {"distance": pa.array(d.astype(np.int32))}).to_batches(_PAIRS)

    def scan(batches):
        for t in _cells(batches):
            for pairs in _gathered(_close_in(t, max_distance, masks)):
                yield from made(t, *pairs)

    return _dealt(rows, max_distance, hot).mapInArrow(scan, schema)


def _hung(up: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """``up``, the first row that each one reaches, after rows r and c were linked."""
    while True:
        a, b = up[r], up[c]
        apart = a != b
        if not apart.any():
            return up
        r, c, a, b = r[apart], c[apart], a[apart], b[apart]
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while (up != (further := up[up])).any():
            up = further


def close_links(rows: DataFrame, max_distance: int, hot: int = HOT_BAND) -> DataFrame:
    """(node, n_links, distance, other): what each cell adds to the links of a row, never the pairs.

    ``rows``: session_id, hi, lo (together unique), node and n_docs (bigint). A link is
    two rows of a session 1..max_distance bits apart; it counts in one cell. n_links
    sums n_docs of the linked rows, distance is the least one, and other is the node
    that all those hang on which the cell's links connect, so a cell gives one row at
    most for each of its own.
    """
    rows = rows.select("session_id", "hi", "lo", "node", "n_docs")
    masks = _masks(max_distance)

    def scan(batches):
        for t in _cells(batches):
            node, n_docs = t["node"].to_numpy(), t["n_docs"].to_numpy()
            n_links, least, up = np.zeros(len(node), dtype=np.int64), np.full(len(node), HASH_BITS, dtype=np.int32), np.arange(len(node))
            for r, c, d in _gathered(_close_in(t, max_distance, masks)):
                for i, j in ((r, c), (c, r)):
                    np.add.at(n_links, i, n_docs[j])
                    np.minimum.at(least, i, d.astype(np.int32))
                up = _hung(up, r, c)
            hit = np.flatnonzero(least < HASH_BITS)
            if hit.size:
                out = {"node": node[hit], "n_links": n_links[hit], "distance": least[hit], "other": node[up[hit]]}
                yield from pa.table(out).to_batches(_PAIRS)

    return _dealt(rows, max_distance, hot).mapInArrow(scan, "node bigint, n_links bigint, distance int, other bigint")


PRIOR = ["doc_first", "version", "reg", "doc_id", "filename"]


def _best_in(bits: np.ndarray, turn: np.ndarray, rank: np.ndarray, ask: np.ndarray, told: np.ndarray, max_distance: int):
    """(asking positions, distances, ranks) of the closest row of an earlier turn, ties to the smaller rank."""
    ask, told = (x[np.argsort(turn[x], kind="stable")] for x in (ask, told))
    none, tile, rank = len(turn), _Tile(), rank.astype(np.int32)
    for a in range(0, len(ask), _ROWS):
        i = ask[a : a + _ROWS]
        best, place = np.full(len(i), max_distance, dtype=np.uint8), np.full(len(i), none, dtype=np.int32)
        for b in range(0, np.searchsorted(turn[told], turn[i[-1]], "left"), _COLUMNS):
            j = told[b : b + _COLUMNS]
            d = tile.distances(bits[:, i], bits[:, j])
            if turn[j[-1]] >= turn[i[0]]:
                d[turn[j][None, :] >= turn[i][:, None]] = 255
            least = d.min(axis=1)
            r = np.flatnonzero(least <= best)
            tied = np.where(d[r] == least[r, None], rank[j][None, :], np.int32(none)).min(axis=1)
            better = (least[r] < best[r]) | (tied < place[r])
            best[r[better]], place[r[better]] = least[r[better]], tied[better]
        hit = place < none
        if hit.any():
            yield i[hit], best[hit], place[hit]


def nearest_earlier(rows: DataFrame, max_distance: int, hot: int = HOT_BAND) -> DataFrame:
    """(id, distance, prior): for each asking row the closest row of the session with an earlier turn, if one is near.

    ``rows``: session_id, hi, lo, id (bigint), asks (boolean), turn (bigint) and the
    columns of ``PRIOR``, by which ties are settled. No pair leaves a task: a cell
    gives one row at most for each of its asking rows.
    """
    rows = rows.select("session_id", "hi", "lo", "id", "asks", "turn", *PRIOR).dropna(subset=["turn"])
    schema = "id bigint, distance int, doc_first bigint, version bigint, reg bigint, doc_id string, filename string"

    def scan(batches):
        for t in _cells(batches):
            asks = t["asks"].to_numpy()
            if not asks.any():
                continue
            order = pc.sort_indices(t, [(c, "ascending") for c in PRIOR], null_placement="at_start").to_numpy()
            rank = np.empty(len(order), dtype=np.int64)
            rank[order] = np.arange(len(order))
            bits, turn, (left, right) = _bits(t), t["turn"].to_numpy(), _sides(t)
            ways = [(left, right)] if t["side"][0].as_py() == 2 else [(left, right), (right, left)]
            found = [x for p, q in ways for x in _best_in(bits, turn, rank, p[asks[p]], q, max_distance)]
            if found:
                i, d, place = (np.concatenate(x) for x in zip(*found))
                out = {"id": t["id"].take(i), "distance": pa.array(d.astype(np.int32))}
                prior = t.select(PRIOR).take(order[place])
                yield from pa.table(out | {c: prior[c] for c in PRIOR}).to_batches(_PAIRS)

    found = _dealt(rows, max_distance, hot).mapInArrow(scan, schema)
    best = found.groupBy("id").agg(F.min(F.struct("distance", F.struct(*PRIOR).alias("prior"))).alias("b"))
    return best.select("id", "b.distance", "b.prior")
