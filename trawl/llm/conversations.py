"""Repair of conversation structure: faults, least-cost edits and the repaired text of every conversation.

Rows without their texts are dealt by range of (conversation, turn), so a
conversation that holds most of the rows spreads over many tasks. Inside a range
they stream through in blocks of bounded length, and each block becomes a table
of least-cost edits from stack to stack (`role_repair`). A second pass joins the
blocks of each conversation to one path, and a third streams the texts, sorted,
beside the chosen edits and keeps a running digest of the repaired ones.
"""

from __future__ import annotations

import hashlib
import sys
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.llm import role_repair
from trawl.session import stage_table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows in a block; bounds the memory and the time of one table.
BLOCK_ROWS = 2048
_SPACES = r"[\x20\x09-\x0D]"
_LEGAL = ("su", "ua", "au")
_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def damaged(rows: DataFrame) -> DataFrame:
    """conversations after seeded damage: (conv_id, turn, role, text, copy, dropped).

    crc32 of `conv_id:turn` modulo 20 decides: 0 drops a row (it stays here, with
    dropped true), 1 empties its text, 2 removes its . ! and ?, 3 repeats it, 4
    makes its role user. Nulls of role and text, and in the crc, are one space.
    """
    space = F.lit(" ")
    known = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.col("_kind")
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return known.withColumn("_kind", F.crc32(name.cast("binary")) % 20).select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(copies).alias("copy"), (kind == 0).alias("dropped"),
    )


def _row_key() -> Column:
    """Digest of role and text."""
    return F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))


def _marked(rows: DataFrame, most: int):
    """A task's sorted rows to block rows; `most` rows a block."""
    fields = [(f, pa.int64()) for f in ("conv_id", "turn")] + [("key", pa.binary()), ("seq", pa.int64()), ("tables", pa.string())]
    fields += [(f, pa.int64()) for f in ("first_turn", "last_turn", "turns", "blank", "duplicate", "truncated", "illegal")]
    fields += [("first_role", pa.string()), ("last_role", pa.string())]
    schema = pa.schema(fields)

    class Block:
        def __init__(self, at: tuple, seq: int, starts: list[int]) -> None:
            self.at, self.seq, self.starts = at, seq, starts
            self.rows: list[str] = []
            self.first_turn = self.last_turn = None
            self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
            self.first_role = self.last_role = ""

        def take(self, turn, role: str, blank: bool, cut: bool, seen: bool) -> None:
            self.blank += blank
            self.duplicate += seen and not blank
            gone = blank or seen
            self.truncated += cut and not gone
            if self.rows:
                self.illegal += self.last_role + role not in _LEGAL
            else:
                self.first_role = role
            self.last_role = role
            self.rows.append("d" if gone else role.upper() if cut else role)
            if turn is not None:
                if self.first_turn is None:
                    self.first_turn = turn
                self.turns += turn != self.last_turn
                self.last_turn = turn

        def row(self) -> tuple:
            text = "".join(self.rows)
            tables = ";".join(
                f"{start} {end} {cost} {audit}" for start in self.starts for end, (cost, audit) in role_repair.block_table(start, text).items()
            )
            return (
                *self.at, self.seq, tables, self.first_turn, self.last_turn, self.turns, self.blank, self.duplicate, self.truncated, self.illegal,
                self.first_role, self.last_role,
            )

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, block, position, fresh = object(), None, None, False
        out: list[tuple] = []
        for batch in batches:
            for conv, turn, key, first, n, role, blank, cut in zip(*[c.to_pylist() for c in batch.columns]):
                if conv != open_:
                    # only the first conversation of a range may have begun in an earlier one
                    starts = role_repair.GRAPH.live if block is None else [0]
                    if block is not None:
                        out.append(block.row())
                    open_, block, position = conv, Block((conv, turn, key), 0, starts), None
                if (turn, key) != position:
                    position, fresh = (turn, key), False
                if first:
                    fresh = True
                    continue
                for _ in range(n):
                    if len(block.rows) >= most:
                        out.append(block.row())
                        block = Block((conv, turn, key), block.seq + 1, role_repair.GRAPH.live)
                        if len(out) >= 1024:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                            out = []
                    if not block.rows:
                        block.at = (conv, turn, key)
                    block.take(turn, role, blank, cut, not fresh)
                    fresh = False
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out = []
        if block is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(block.row(), schema)], schema=schema)

    return blocks


_PATH = "conv_id bigint, turn bigint, key binary, seq bigint, start int, stop int, " + ", ".join(f"{c} bigint" for c in _COUNTS)


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted block rows to the path through each conversation's blocks, and its totals."""
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * len(_COUNTS)]
    names = ["conv_id", "turn", "key", "seq", "start", "stop", *_COUNTS]

    def done(ats: list[tuple], fold, totals: dict) -> list[tuple]:
        cost, steps = fold.path()
        low, high = totals["low"], totals["high"]
        gaps = 0 if low is None else high - low + 1 - totals["turns"]
        counts = (gaps, totals["blank"], totals["duplicate"], totals["truncated"], totals["illegal"], cost)
        return [(*at, *step, *counts) for at, step in zip(ats, steps)]

    open_, fold, ats, totals = object(), None, [], {}
    for batch in batches:
        out: list[tuple] = []
        for row in batch.to_pylist():
            if row["conv_id"] != open_:
                if fold is not None:
                    out += done(ats, fold, totals)
                open_, fold, ats = row["conv_id"], role_repair.Fold(), []
                totals = {"low": None, "high": None, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "role": None}
            tables: dict[int, dict] = {}
            for entry in row["tables"].split(";"):
                start, end, cost, audit = entry.split(" ")
                tables.setdefault(int(start), {})[int(end)] = (int(cost), audit)
            fold.add(tables)
            ats.append((row["conv_id"], row["turn"], row["key"], row["seq"]))
            if row["first_turn"] is not None:
                totals["turns"] += row["turns"] - (row["first_turn"] == totals["high"])
                totals["low"] = row["first_turn"] if totals["low"] is None else totals["low"]
                totals["high"] = row["last_turn"]
            totals["illegal"] += totals["role"] is not None and totals["role"] + row["first_role"] not in _LEGAL
            totals["role"] = row["last_role"]
            for name in ("blank", "duplicate", "truncated", "illegal"):
                totals[name] += row[name]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
    if fold is not None:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done(ats, fold, totals)), kinds)], names)


_REPAIRED = "conv_id bigint, " + ", ".join(f"{c} bigint" for c in _COUNTS) + ", audit string, repaired_sha256 string"
_PATH_ROW, _TABLE_ROW, _TEXT_ROW = 0, 1, 2


class _Repaired:
    """One conversation's repaired rows as a running digest."""

    def __init__(self, conv) -> None:
        self.conv, self.counts, self.audit = conv, [0] * len(_COUNTS), []
        self.digest, self.begun, self.before = hashlib.sha256(), False, ""
        self.steps: dict[tuple, tuple] = {}
        self.edits: deque[str] = deque()

    def edit(self, audit: str) -> None:
        self.audit.append(audit)
        self.edits.extend(audit)

    def put(self, role: str, text: str) -> None:
        self.digest.update((b"\n" if self.begun else b"") + role.encode() + b":" + text.encode())
        self.begun, self.before = True, role[:1]

    def expected(self) -> str:
        return "assistant" if self.before == "u" else "user"

    def inserts(self) -> None:
        while self.edits and self.edits[0] == "I":
            self.edits.popleft()
            self.put(self.expected(), "")

    def take(self, role: str, text: str) -> None:
        self.inserts()
        edit = self.edits.popleft()
        if edit != "D":
            self.put(role if edit == "K" else self.expected(), text)

    def row(self) -> tuple:
        self.inserts()
        return (self.conv, *self.counts, "".join(self.audit), self.digest.hexdigest())


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted path rows, block tables and text rows to one row per conversation."""
    names = ["conv_id", *_COUNTS, "audit", "repaired_sha256"]
    kinds = [*[pa.int64()] * (1 + len(_COUNTS)), pa.string(), pa.string()]
    now: _Repaired | None = None
    for batch in batches:
        out: list[tuple] = []
        for conv, turn, key, kind, seq, role, text, step in zip(*[c.to_pylist() for c in batch.columns]):
            if now is None or conv != now.conv:
                if now is not None:
                    out.append(now.row())
                now = _Repaired(conv)
            if kind == _PATH_ROW:
                now.steps[turn, key, seq] = (step["start"], step["stop"])
                now.counts = [step[c] for c in _COUNTS]
            elif kind == _TABLE_ROW:
                chosen = "{} {}".format(*now.steps.pop((turn, key, seq)))
                now.edit(next(e.split(" ")[3] for e in text.split(";") if e.startswith(chosen + " ")))
            elif role is not None:
                now.take(role, text)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(now.row(), kinds)], names)


def repair(rows: DataFrame, block_rows: int = BLOCK_ROWS, ranges: int | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256): one row per conv_id.

    rows: conv_id BIGINT, turn BIGINT, role, text STRING, copy, dropped as of
    `damaged`; further columns are ignored. Rows are taken by turn, nulls first,
    and those of one turn by the digest of role and text, so equal rows are
    neighbours. A null conv_id is a conversation of its own; one of which all rows
    were dropped has zeros, an empty audit and the digest of nothing; an empty
    table gives no rows. Faults: blank, duplicate (role and text seen earlier),
    truncated; the first one counts. Texts of any length only ever meet in the
    sort by conversation, which spills; one task streams a conversation's texts,
    as its SHA-256 allows no other way, and the audit is one value by contract.
    """
    live = rows.filter("NOT dropped")
    initial = F.substring("role", 1, 1)
    compact = live.select(
        "conv_id", "turn", _row_key().alias("key"), F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("role"),
        (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"), (~F.col("text").rlike(rf"[.!?]{_SPACES}*\z")).alias("cut"),
    )
    counted = stage_table(compact.groupBy(*compact.columns).agg(F.count(F.lit(1)).alias("n")))
    firsts = counted.groupBy("conv_id", "key").agg(F.min(F.struct("turn")).alias("t")).select("conv_id", "t.turn", "key", F.lit(True).alias("first"))
    both = stage_table(firsts.unionByName(counted.withColumn("first", F.lit(False)), allowMissingColumns=True))
    order = ["conv_id", "turn", "key"]
    dealt = both.repartitionByRange(ranges, *order) if ranges else both.repartitionByRange(*order)
    dealt = dealt.sortWithinPartitions(*order, F.col("first").desc()).select(*order, "first", "n", "role", "blank", "cut")
    block_schema = "conv_id bigint, turn bigint, key binary, seq bigint, tables string, first_turn bigint, last_turn bigint, turns bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first_role string, last_role string"
    blocks = stage_table(dealt.mapInArrow(_marked(dealt, block_rows), block_schema))
    paths = blocks.repartition("conv_id").sortWithinPartitions(*order, "seq").mapInArrow(_paths, _PATH)
    none = F.lit(None)
    parts = ["conv_id", "turn", "key", "kind", "seq", "role", "text", "step"]
    step_type = "struct<" + ", ".join(f"{c}: bigint" for c in ("start", "stop", *_COUNTS)) + ">"
    step = F.struct(*[F.col(c).cast("bigint").alias(c) for c in ("start", "stop", *_COUNTS)])
    path_rows = paths.withColumns({"kind": F.lit(_PATH_ROW), "role": none.cast("string"), "text": none.cast("string"), "step": step})
    table_rows = blocks.withColumns({"kind": F.lit(_TABLE_ROW), "role": none.cast("string"), "text": F.col("tables"), "step": none.cast(step_type)})
    kept = ~F.col("dropped")
    text_rows = rows.select(
        "conv_id", "turn", _row_key().alias("key"), F.lit(_TEXT_ROW).alias("kind"), F.col("copy").cast("bigint").alias("seq"),
        F.when(kept, F.col("role")).alias("role"), F.when(kept, F.col("text")).alias("text"), none.cast(step_type).alias("step"),
    )
    stream = path_rows.select(*parts).unionByName(table_rows.select(*parts)).unionByName(text_rows)
    ordered = stream.repartition("conv_id").sortWithinPartitions(*order, "kind", "seq")
    return ordered.mapInArrow(_repaired, _REPAIRED)
