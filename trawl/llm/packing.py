"""Packing documents into training sequences of a fixed number of tokens.

Documents are cut every `size` tokens; the pieces go into randomised groups of
bounded size, and each group is packed on its own by first-fit decreasing with a
tournament tree over the free room of its sequences.
"""

from __future__ import annotations

import math
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.tokens import process_encoder
from trawl.session import stage_table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Expected pieces in a group; a group is one task's work.
GROUP_PIECES = 8192


def first_fit_decreasing(sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each size: longest first, each into the first bin with room.

    Equal sizes keep their order. The tree's leaves are the bins' free room and an
    inner node is the larger of its two, so the first bin that fits is found from
    the root. Sizes above room are an error.
    """
    n = len(sizes)
    if n and (sizes.max() > room or sizes.min() < 0):
        raise ValueError("a piece is longer than a sequence")
    leaves = 1 << max(0, math.ceil(math.log2(max(n, 1))))
    tree = [room] * (2 * leaves)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size, at = int(sizes[i]), 1
        while at < leaves:
            at *= 2
            if tree[at] < size:
                at += 1
        bins[i], offsets[i] = at - leaves, room - tree[at]
        tree[at] -= size
        while at > 1:
            at //= 2
            larger = max(tree[2 * at], tree[2 * at + 1])
            if tree[at] == larger:
                break
            tree[at] = larger
    return bins, offsets


def _piece_rows(path: str, size: int, end: int, keep_ids: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tail = process_encoder(path), end.to_bytes(4, "little")
        for batch in batches:
            out: list[tuple] = []
            for i, text in enumerate(batch.column("_text")):
                ids = encoder.encode(text.as_py() or "") + tail
                for start in range(0, len(ids), 4 * size):
                    piece = ids[start : start + 4 * size]
                    out.append((i, start // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4, piece if keep_ids else None))
            at, starts, lengths, crcs, totals, pieces = zip(*out) if out else [()] * 6
            key = batch.column("_key").take(pa.array(at, pa.int64()))
            columns = [key, *(pa.array(c, pa.int64()) for c in (starts, lengths, crcs, totals))]
            names = ["_key", "start", "length", "ids_crc32", "doc_tokens"]
            if keep_ids:
                columns, names = [*columns, pa.array(pieces, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows


def pack(
    docs: DataFrame, tokenizer: str, size: int = 4096, end: int = 2, seed: int = 42, key: str = "doc_id", text: str = "text",
    group_pieces: int = GROUP_PIECES, keep_ids: bool = False,
) -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids BINARY]): one row per piece.

    A document is the ids of its whole text and then `end`; a null or empty text
    is `end` alone. It is cut at multiples of `size`, so only its last piece is
    shorter. tokenizer is the path of the vocabulary file, the same on every
    executor. Repeated rows are packed like any others, nulls of the key stay.
    An empty table gives no rows; other columns are ignored. Groups come from a
    seeded hash of each piece's number in the written table of pieces.
    """
    kind = docs.schema[key].dataType.simpleString()
    schema = f"_key {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids binary" * keep_ids
    texts = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"))
    pieces = texts.mapInArrow(_piece_rows(tokenizer, size, end, keep_ids), schema).withColumn("_n", F.monotonically_increasing_id())
    pieces = stage_table(pieces)
    groups = max(1, math.ceil(pieces.count() / group_pieces))
    grouped = pieces.withColumn("_group", F.pmod(F.xxhash64(F.lit(seed), "_n"), F.lit(groups)))

    def placed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_n")
        bins, offsets = first_fit_decreasing(rows["length"].to_numpy(), size)
        return rows.drop(columns=["_group", "_n"]).assign(sequence_id=rows["_group"] * (1 << 32) + bins, offset=offsets)

    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.drop("_n").schema) + ", sequence_id bigint, offset bigint"
    packed = grouped.groupBy("_group").applyInPandas(placed, out)
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * keep_ids
    return packed.select(F.col("_key").alias(key), *names)
