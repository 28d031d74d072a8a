"""Exact removal of byte strings that occur more than once in a table of texts.

A string of `length` bytes is handed to one place of comparison by its anchor:
of the `anchor`-byte strings inside it, the one with the least hash, leftmost on
ties. Equal strings have equal anchors at equal offsets, so all starts of a
string meet under one anchor, and every start belongs to exactly one. Anchors
that occur once settle all their strings at once. For the others the text around
the anchor, from the first to the last string it owns, is sent to the anchor's
partition, where a Burrows-Wheeler transform over a block of anchors decides:
breadth-first backward extension sets the common prefix of neighbouring suffixes
by increasing value and stops at `length`; what is not set by then is repeated.

Equal texts around an anchor are merged and counted before they are sent, so
copies cost no more. An anchor with more than `HOT` different texts around it is
left out of the blocks: the digests of those texts' strings are counted instead.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.memory import release
from trawl.session import shuffled, stage_table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Different texts around one anchor that are compared in one transform.
HOT = 4096
#: Bytes of text in one transform.
_BLOCK_BYTES = 1 << 20
#: String starts looked at together in a long text.
_STARTS = 1 << 19
#: Bytes of merged contexts held by a task before they are passed on.
_MERGE_BYTES = 8 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_CODE = _mixed(np.arange(1, 257, dtype=np.uint64) * _ODD)


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    known = _POWERS.get(int(base))
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 14), base, np.uint64)
        known[0] = 1
        known = _POWERS[int(base)] = np.multiply.accumulate(known)
    return known[:n]


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of all `size`-byte strings of a byte array, equal for equal strings."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_CODE[data] * _powers(_ODD, n), out=sums[1:])
    return _mixed((sums[size:] - sums[:-size]) * _powers(_INVERSE, n - size + 1))


def _window_minimum(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x) - width + 1
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    rows = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def flat_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, begins, ends) of a string or binary column as one byte array; nulls are empty."""
    wide = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    values = wide.buffers()[2]
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    return data, offsets[:-1], offsets[1:]


def owned_runs(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, length: int, anchor: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(texts, hashes, firsts, counts, places): runs of string starts in `data` that one anchor owns; its place counts from the run.

    Text i is data[begins[i]:ends[i]]; the texts follow one another, and strings
    do not cross them. Long data comes in parts, which may split a run.
    """
    if not len(begins):
        return
    width, low = length - anchor + 1, np.uint64(0xFFFFFF)
    for base in range(int(begins[0]), int(ends[-1]) - length + 1, _STARTS):
        n = min(_STARTS, int(ends[-1]) - length + 1 - base)
        texts = np.arange(np.searchsorted(ends, base, "right"), np.searchsorted(begins, base + n, "left"))
        first, stop = np.maximum(begins[texts] - base, 0), np.minimum(ends[texts] - length + 1 - base, n)
        first, stop = first[first < stop], stop[first < stop]
        if not len(first):
            continue
        hashes = gram_hashes(data[base : base + n + length - 1], anchor)
        places = np.arange(len(hashes), dtype=np.uint64)
        least = _window_minimum((hashes & ~low) | places, width) & low
        turn = np.zeros(n + 1, bool)
        turn[1:n] = least[1:] != least[:-1]
        turn[first] = turn[stop] = turn[n] = True
        inside = np.zeros(n + 1, np.int8)
        np.add.at(inside, first, 1)
        np.add.at(inside, stop, -1)
        turns = np.flatnonzero(turn)
        kept = np.cumsum(inside)[turns] > 0
        starts, counts = turns[kept], np.diff(np.append(turns, n))[kept]
        anchors = least[starts].astype(np.int64)
        yield np.searchsorted(ends, base + starts, "right"), hashes[anchors].view(np.int64), starts + base, counts, anchors - starts


def _anchor_rows(length: int, anchor: int):
    """(k, h, n): the anchors of each text with their number, which keeps texts of one word over and over small."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts, hashes, _, _, _ in owned_runs(*flat_texts(batch.column(0)), length, anchor):
                order = np.lexsort((hashes, texts))
                texts, hashes = texts[order], hashes[order]
                fresh = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (texts[1:] != texts[:-1])]))
                counts = np.diff(np.append(fresh, len(hashes))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(texts[fresh])), pa.array(hashes[fresh]), pa.array(counts)], ["k", "h", "n"])
            release()

    return rows


_CONTEXT = "k binary, first bigint, h bigint, c binary, context binary, place int, n bigint"


def _context_rows(length: int, anchor: int):
    """Per text and repeated anchor: (k, first, c) for each run; per task and context, merged: (h, c, context, place, n)."""
    schema = pa.schema([("k", pa.binary()), ("first", pa.int64()), ("h", pa.int64()), ("c", pa.binary()), ("context", pa.binary()), ("place", pa.int32()), ("n", pa.int64())])

    def merged(held: dict) -> pa.RecordBatch:
        n = len(held)
        hs, cs, xs, places, counts = zip(*[(h, c, *rest) for (h, c), rest in held.items()])
        none = pa.nulls(n)
        return pa.RecordBatch.from_arrays(
            [none.cast(pa.binary()), none.cast(pa.int64()), pa.array(hs, pa.int64()), pa.array(cs, pa.binary()), pa.array(xs, pa.binary()), pa.array(places, pa.int32()), pa.array(counts, pa.int64())],
            schema=schema,
        )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bytes], tuple[bytes, int, int]] = {}
        size, digest = 0, hashlib.md5
        for batch in batches:
            data, begins, ends = flat_texts(batch.column(0))
            wanted = np.unique(batch.column(2).flatten().to_numpy(zero_copy_only=False))
            for texts, hashes, firsts, counts, places in owned_runs(data, begins, ends, length, anchor):
                common = np.isin(hashes, wanted)
                texts, hashes, firsts, counts, places = (x[common] for x in (texts, hashes, firsts, counts, places))
                names = []
                for h, first, stop, place in zip(hashes.tolist(), firsts.tolist(), (firsts + counts + length - 1).tolist(), places.tolist()):
                    context = data[first:stop].tobytes()
                    name = digest(context).digest()
                    names.append(name)
                    old = held.get((h, name))
                    if old is None:
                        held[h, name] = (context, place, 1)
                        size += len(context) + 150
                        if size > _MERGE_BYTES:
                            yield merged(held)
                            held, size = {}, 0
                    else:
                        held[h, name] = (context, place, old[2] + 1)
                none = pa.nulls(len(names))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).take(pa.array(texts)), pa.array(firsts - begins[texts]), none.cast(pa.int64()), pa.array(names, pa.binary()), none.cast(pa.binary()), none.cast(pa.int32()), none.cast(pa.int64())],
                    schema=schema,
                )
        if held:
            yield merged(held)
        held = {}
        release()

    return rows


def sorted_suffixes(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, ranks) of an integer array whose suffixes differ within `depth` symbols, by doubling.

    Only suffixes that are still tied are sorted again.
    """
    n, width = len(data), int(data.max()) + 2
    done = max(1, 62 // width.bit_length())
    key = np.zeros(n, np.int64)
    for i in range(done):
        key = key * width
        key[: n - i] += data[i:] + 1
    order = np.argsort(key)
    rank, places, tied, key = np.empty(n, np.int64), np.arange(n), order, key[order]
    while True:
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[tied] = np.maximum.accumulate(np.where(new, places, 0))
        open_ = ~(new & np.append(new[1:], True))
        tied, places = tied[open_], places[open_]
        if done >= depth or not len(tied):
            return order, rank
        after = np.minimum(tied + done, n)
        key = rank[tied] * np.int64(n + 1) + np.append(rank + 1, 0)[after]
        again = np.argsort(key)
        tied, key = tied[again], key[again]
        order[places] = tied
        done *= 2


def _spread(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of consecutive ranges end to end, and the range each belongs to."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[owner], owner


def bounded_prefixes(order: np.ndarray, rank: np.ndarray, symbols: np.ndarray, length: int) -> np.ndarray:
    """Common prefix length of each suffix with the one before it, or `length` where it is that or more.

    Backward search from the empty string: the interval of w extends to the
    intervals of cw, for each symbol c before a suffix of w. Where the suffix
    behind such an interval has no value yet, its value is the length of w and
    the interval is searched on; else it is closed. Only the ends of the
    transform's equal runs are looked at. A symbol that occurs once ends all prefixes.
    """
    n = len(order)
    found = np.full(n + 1, length, np.int64)
    found[0] = found[n] = -1
    before = symbols[order - 1]
    to = rank[order - 1]
    by_symbol = np.argsort(before, kind="stable")
    spelled = before[by_symbol] * np.int64(n) + by_symbol
    same = before[by_symbol][1:] == before[by_symbol][:-1]
    ahead = np.full(n, n)
    ahead[by_symbol[:-1][same]] = by_symbol[1:][same]
    turn = before[1:] != before[:-1]
    turns, turns_before = np.flatnonzero(turn), np.concatenate([[0], np.cumsum(turn)])
    low, high = np.array([0]), np.array([n - 1])
    for level in range(length):
        if not len(low):
            break
        inner, owner = _spread(turns_before[low], turns_before[high] - turns_before[low])
        inner = turns[inner]
        last = ahead[inner] > high[owner]
        lasts, owner = np.concatenate([inner[last], high]), np.concatenate([owner[last], np.arange(len(low))])
        next_high = to[lasts]
        unset = found[next_high + 1] == length
        lasts, owner, high = lasts[unset], owner[unset], next_high[unset]
        found[high + 1] = level
        firsts = by_symbol[np.searchsorted(spelled, before[lasts] * np.int64(n) + low[owner])]
        low = to[firsts]
    return found[:n]


def repeated_starts(contexts: list[bytes], counts: list[int], length: int) -> list[np.ndarray]:
    """For each of distinct contexts, which occur `counts` times, the starts of `length`-byte strings seen more than once."""
    k = len(contexts)
    sizes = np.array([len(c) for c in contexts])
    text = np.frombuffer(b"".join(c + b"\0" for c in contexts), np.uint8)
    symbols = text.astype(np.int64) + k
    ends = np.cumsum(sizes + 1) - 1
    symbols[ends] = np.arange(k)
    order, rank = sorted_suffixes(symbols, int(sizes.max()) + 2)
    prefixes = bounded_prefixes(order, rank, symbols, length)
    group = np.cumsum(prefixes < length) - 1
    context_of = np.repeat(np.arange(k), sizes + 1)
    weight = np.bincount(group, np.array(counts, np.float64)[context_of[order]])
    begin = np.concatenate([[0], ends[:-1] + 1])
    room = ends[context_of] - np.arange(len(text)) >= length
    hit = np.flatnonzero((weight[group[rank]] > 1) & room)
    at = hit - begin[context_of[hit]]
    return np.split(at, np.searchsorted(context_of[hit], np.arange(1, k)))


def _run_list(starts: np.ndarray) -> list[int]:
    """first, count, first, count ... of consecutive numbers."""
    cut = np.flatnonzero(np.diff(starts) != 1) + 1
    firsts = starts[np.concatenate([[0], cut])]
    counts = np.diff(np.concatenate([[0], cut, [len(starts)]]))
    return np.stack([firsts, counts], axis=1).ravel().tolist()


def _comparable(group: list[tuple], anchor: int, length: int) -> list[tuple]:
    """The contexts of one anchor that can hold a repeated string.

    A string around the anchor has half of the bytes it still needs on one side
    of it at least; a context is out if the longer strings to either side of its
    anchor occur nowhere else in the group.
    """
    half = (length - anchor) // 2
    sides: dict[bytes, int] = {}
    keys = []
    for _, context, at, n in group:
        own = [b"L" + context[at - half : at + anchor]] if at >= half else []
        own += [b"R" + context[at : at + length - half]] if at + length - half <= len(context) else []
        keys.append(own)
        for side in own:
            sides[side] = sides.get(side, 0) + n
    return [g for g, own in zip(group, keys) if any(sides[side] > 1 for side in own)]


def _transformed(length: int, anchor: int):
    """(c, runs) of the contexts, sorted by anchor and content, that hold repeated strings.

    Equal contexts are merged and counted; one that meets no other has only
    strings that occur as often as itself.
    """

    def batch_of(names: list[bytes], runs: list[list[int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(runs, pa.list_(pa.int32()))], ["c", "runs"])

    def settle(block: list[tuple]) -> pa.RecordBatch:
        found = repeated_starts([b[1] for b in block], [b[3] for b in block], length)
        rows = [(b[0], _run_list(s)) for b, s in zip(block, found) if len(s)]
        return batch_of([r[0] for r in rows], [r[1] for r in rows])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple] = []
        lone: list[tuple] = []
        group: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            for h, c, context, place, n in zip(*[batch.column(i).to_pylist() for i in range(5)]):
                if group and last == h and group[-1][0] == c:
                    group[-1] = (c, context, place, group[-1][3] + n)
                    continue
                if h != last:
                    size += _close(group, block, lone, anchor, length)
                    group = []
                    if size >= _BLOCK_BYTES:
                        yield settle(block)
                        block, size = [], 0
                group.append((c, context, place, n))
                last = h
            if lone:
                yield batch_of([g[0] for g in lone], [[0, len(g[1]) - length + 1] for g in lone])
                lone = []
        _close(group, block, lone, anchor, length)
        if lone:
            yield batch_of([g[0] for g in lone], [[0, len(g[1]) - length + 1] for g in lone])
        if block:
            yield settle(block)
        block = []
        release()

    return rows


def _close(group: list[tuple], block: list[tuple], lone: list[tuple], anchor: int, length: int) -> int:
    """Hand a finished group on; returns the bytes added to the block."""
    if len(group) == 1:
        lone.extend(g for g in group if g[3] > 1)
        return 0
    kept = _comparable(group, anchor, length)
    block.extend(kept)
    return sum(len(g[1]) for g in kept)


def _without(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, int, int]:
    """(bytes left, number removed, maximal removed runs) of a text without [starts, ends)."""
    if not len(starts):
        return raw, 0, 0
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    fresh = np.concatenate([[True], starts[1:] > reach[:-1]])
    first, last = starts[fresh].tolist(), reach[np.append(fresh[1:], True)].tolist()
    kept = b"".join(raw[a:b] for a, b in zip([0, *last], [*first, len(raw)]))
    return kept, len(raw) - len(kept), len(first)


def _cut(length: int, as_text: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column("_spans")
            flat, runs = spans.flatten(), spans.flatten().field("runs")
            per_text = np.diff(spans.offsets.to_numpy())
            per_span = np.diff(runs.offsets.to_numpy()) // 2
            pairs = runs.flatten().to_numpy().reshape(-1, 2)
            starts = np.repeat(flat.field("first").to_numpy(), per_span) + pairs[:, 0]
            ends = starts + pairs[:, 1] + length - 1
            bounds = np.concatenate([[0], np.cumsum(per_span)])[np.concatenate([[0], np.cumsum(per_text)])]
            out = [_without(text.as_py().encode(), starts[a:b], ends[a:b]) for text, a, b in zip(batch.column("_text"), bounds[:-1], bounds[1:])]
            kept = [k.decode(errors="ignore") for k, _, _ in out] if as_text else [k for k, _, _ in out]
            names = [c for c in batch.schema.names if c not in ("_text", "_spans")]
            columns = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(kept, pa.string() if as_text else pa.binary()), pa.array([r for _, r, _ in out], pa.int64()), pa.array([n for _, _, n in out], pa.int64())],
                [*names, "kept", "n_removed", "n_spans"],
            )
            del out, kept, columns
            release()

    return rows


def repeated_spans(texts: DataFrame, length: int = 200, anchor: int = 48, keep_all: bool = True) -> tuple[DataFrame, DataFrame]:
    """For rows (k BINARY digest of the text, t STRING, any others): the rows, written once, and the repeated starts.

    The first table has all columns of `texts` and `candidate`: whether the text
    holds an anchor that occurs again. Without keep_all, t is null where not. The
    second table has (k, first, runs): starts first + runs[2i] up to runs[2i + 1]
    of them are of strings that occur elsewhere.
    """
    anchors = stage_table(texts.select("t", "k").mapInArrow(_anchor_rows(length, anchor), "k binary, h bigint, n int"))
    again = anchors.groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1").select("h")
    per_text = anchors.select("k", "h").join(shuffled(again), "h").groupBy("k").agg(F.collect_set("h").alias("shared"))
    beside = texts.join(shuffled(per_text), "k", "left").withColumn("candidate", F.col("shared").isNotNull())
    if not keep_all:
        beside = beside.withColumn("t", F.when(F.col("candidate"), F.col("t")))
    beside = stage_table(beside)
    shared = beside.filter("candidate").select("t", "k", "shared").mapInArrow(_context_rows(length, anchor), _CONTEXT)
    shared = stage_table(shared)
    contexts = shared.filter("context is not null").select("h", "c", "context", "place", "n")
    many = contexts.groupBy("h").agg(F.count("*").alias("m")).filter(F.col("m") > HOT).select("h")
    many = contexts.select("h", "c").join(many, "h").distinct().groupBy("h").agg(F.count("*").alias("m")).filter(F.col("m") > HOT).select("h")
    many = stage_table(many)
    hot = not many.isEmpty()
    cool = contexts.join(many, "h", "left_anti") if hot else contexts
    cool = cool.repartition("h").sortWithinPartitions("h", "c")
    repeated = cool.mapInArrow(_transformed(length, anchor), "c binary, runs array<int>")
    if hot:
        repeated = repeated.union(_counted(contexts.join(many, "h", "left_semi"), length))
    places = shared.filter("k is not null").groupBy("k", "first").agg(F.first("c").alias("c"))
    return beside.drop("shared"), places.join(shuffled(repeated), "c").select("k", "first", "runs")


def _counted(contexts: DataFrame, length: int) -> DataFrame:
    """(c, runs) of contexts with strings that occur more than once, by counting the digests of all their strings."""

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, context, n in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                starts = len(context) - length + 1
                found = [hashlib.md5(context[i : i + length]).digest() for i in range(starts)]
                yield pa.RecordBatch.from_arrays([pa.array([c] * starts, pa.binary()), pa.array(range(starts), pa.int32()), pa.array(found, pa.binary()), pa.array([n] * starts, pa.int64())], ["c", "start", "g", "n"])

    distinct = contexts.groupBy("h", "c").agg(F.first("context").alias("context"), F.sum("n").alias("n")).select("c", "context", "n")
    grams = stage_table(distinct.mapInArrow(strings, "c binary, start int, g binary, n bigint"))
    often = grams.groupBy("g").agg(F.sum("n").alias("n")).filter("n > 1").select("g")
    runs = F.flatten(F.transform(F.array_sort(F.collect_set("start")), lambda i: F.array(i, F.lit(1))))
    return grams.join(shuffled(often), "g").groupBy("c").agg(runs.alias("runs"))


def without_repeats(docs: DataFrame, length: int = 200, anchor: int = 48, text: str = "text", output: str = "bytes") -> DataFrame:
    """The rows of docs with (n_bytes, n_removed, n_spans, kept): every byte that a repeated
    string of `length` UTF-8 bytes covers is removed; strings never cross rows.

    kept is BINARY, as a cut may fall inside a character; with output "text" it is
    a STRING without characters that a cut has broken; with output "digest" it is
    the SHA-256 of those bytes in hex, and texts without a repeated anchor are not
    carried along. Columns of docs with one of these four names are replaced. A
    null text counts as empty. Shorter texts never change. A text of `length`
    bytes or more whose row repeats loses everything, as each copy occurs
    elsewhere. An empty table gives no rows.
    """
    new, digest, as_text = ["n_bytes", "n_removed", "n_spans", "kept"], output == "digest", output == "text"
    names = [c for c in docs.columns if c not in new]
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(
        *[F.col(f"`{c}`").alias(f"d{i}") for i, c in enumerate(names) if not (digest and c == text)],
        F.octet_length(value).cast("bigint").alias("n_bytes"), F.unhex(F.md5(value.cast("binary"))).alias("k"), value.alias("t"),
        (F.sha2(value.cast("binary"), 256) if digest else F.lit(None).cast("string")).alias("sha"),
    )
    beside, spans = repeated_spans(rows, length, anchor, keep_all=not digest)
    per_text = spans.groupBy("k").agg(F.collect_list(F.struct("first", "runs")).alias("_spans"))
    touched = beside.filter("candidate").join(shuffled(per_text), "k", "left")
    own = [c for c in beside.columns if c not in ("k", "t", "sha", "candidate")]
    hit = touched.filter("_spans is not null").select(*own, F.col("t").alias("_text"), "_spans")
    schema = ", ".join(f"`{c}` {hit.schema[c].dataType.simpleString()}" for c in own)
    hit = hit.mapInArrow(_cut(length, as_text), f"{schema}, kept {'string' if as_text else 'binary'}, n_removed bigint, n_spans bigint")
    same = touched.filter("_spans is null").drop("_spans").unionByName(beside.filter("not candidate"))
    same = same.withColumns({"n_removed": F.lit(0).cast("bigint"), "n_spans": F.lit(0).cast("bigint")})
    if digest:
        hit, same = hit.withColumn("kept", F.sha2("kept", 256)), same.withColumn("kept", F.col("sha"))
    else:
        same = same.withColumn("kept", F.col("t") if as_text else F.col("t").cast("binary"))
    both = hit.unionByName(same.select(*hit.columns))
    return both.select(*[F.col(f"d{i}").alias(c) for i, c in enumerate(names) if not (digest and c == text)], *new)
