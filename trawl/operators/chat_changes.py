"""Chat changes applied in their order, as joins and running values.

A row's effect depends on what the rows before it did: whether its chat is alive,
how many chats its session has, which chat was touched last, which default
numbers were given out. All four are values over earlier rows: the last birth or
death of the chat, a signed sum, the last touched chat that is not yet deleted,
and a running maximum. So no task goes through a session's or the table's changes
one by one with all of its chats in hand.
"""

from __future__ import annotations

import sys
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from trawl.functions import fixed_values as fv
from trawl.functions.text import strip
from trawl.operators.chats import CHAT, default_number
from trawl.operators.prefix import count_before, max_before, min_before, ranged, sum_before
from trawl.session import stage_table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: The place of the chats there were before, and of what never happens.
_FIRST, _NEVER = -(1 << 62), 1 << 62


def apply_chat_changes_in_order(chats: DataFrame, changes: DataFrame, ranges: int | None = None) -> DataFrame:
    """Chats after ``changes`` (seq, action, session_id, chat_id, title, timestamp), applied one after the other by seq.

    Actions: create, create_session, rename, delete. A create of a chat that is
    there replaces it. Renames and deletes of chats that are not there, at that
    moment, do nothing; a blank rename keeps the title. A rename without chat_id
    means the chat of the session that was touched last, by a change or, before
    any, by updated_at (of equal times the smaller id), and is not deleted. A
    create without a title is named by the session's number of chats at that
    moment plus one; a create_session without one by one more than the greatest
    default number that any chat has had since the start, so a number does not
    come back within a call. Other actions, and those other than renames without
    a chat_id, are ignored. seq is unique. ``ranges`` sets the number of ranges
    that a session's changes are cut into.
    """
    title = F.nullif(strip(F.coalesce("title", F.lit(""))), F.lit(""))
    acts = changes.select(
        F.col("seq").cast("bigint").alias("seq"), "action", "session_id", F.nullif("chat_id", F.lit("")).alias("chat_id"),
        title.alias("title"), F.col("timestamp").alias("at"),
    ).filter("action in ('create', 'create_session', 'rename', 'delete')")
    before = chats.select(
        F.lit(_FIRST).alias("seq"), F.lit("base").alias("action"), "session_id", "chat_id", "title", F.col("updated_at").alias("at"),
    )
    births = F.col("action").isin("base", "create", "create_session")
    events = before.unionByName(acts.filter("chat_id is not null")).withColumn("_back", -F.col("seq"))
    events = max_before(events, CHAT, "seq", F.when(births | (F.col("action") == "delete"), F.struct("seq", births.alias("alive"))), "_life", ranges)
    events = events.withColumn("alive", F.coalesce("_life.alive", F.lit(False))).drop("_life")
    events = min_before(events, CHAT, "_back", F.when(F.col("action") == "delete", F.col("seq")), "ends", ranges).drop("_back")
    events = stage_table(events.filter(births | F.col("alive")).withColumn("ends", F.coalesce("ends", F.lit(_NEVER))))

    unnamed = acts.filter("action = 'rename' and chat_id is null").drop("chat_id")
    touched = events.filter("action <> 'delete'").join(unnamed.select("session_id").distinct(), "session_id", "left_semi")
    old = F.struct(F.coalesce("at", F.lit(0)).alias("at"), "chat_id")
    order = count_before(touched.filter("action = 'base'").withColumn("_by", _newest_last(old)), ["session_id"], "_by", "_place", ranges)
    placed = order.withColumn("seq", F.col("_place") + _FIRST).drop("_by", "_place").unionByName(touched.filter("action <> 'base'"))
    found = latest_alive(placed.select("session_id", "seq", "ends", "chat_id"), unnamed.select("session_id", "seq"), ranges)
    implied = unnamed.join(found, ["session_id", "seq"])

    # What each event leaves as the title of its chat, but for the numbers of create_session.
    change = F.when(births & ~F.col("alive") & (F.col("action") != "base"), 1).when(F.col("action") == "delete", -1).otherwise(0)
    held = chats.groupBy("session_id").agg(F.count(F.lit(1)).alias("_held"))
    counted = sum_before(events.filter("action <> 'base'"), ["session_id"], "seq", change.cast("bigint"), "_change", ranges).join(held, "session_id", "left")
    number = F.coalesce("_held", F.lit(0)) + F.col("_change") + 1
    own = F.when(F.col("action") == "create", F.concat(F.lit(fv.DEFAULT_CHAT_TITLE + " "), number.cast("string")))
    columns = ["seq", "action", *CHAT, "title", "at"]
    told = counted.withColumn("title", F.coalesce("title", own)).select(*columns).unionByName(implied.select(*columns))
    told = stage_table(told.unionByName(events.filter("action = 'base'").select(*columns)))

    numbered = told.filter("action <> 'delete'").select("seq", "title", "action", default_number(F.col("title")).alias("number"))
    waiting = (F.col("action") == "create_session") & F.col("title").isNull()
    numbered = numbered.filter(waiting | F.col("number").isNotNull()).withColumns({"_all": F.lit(0), "waits": waiting})
    numbered = numbered.filter("action <> 'base'").unionByName(
        numbered.filter("action = 'base'").groupBy("seq", "action", "_all", "waits").agg(F.max("title").alias("title"), F.max("number").alias("number"))
    )
    above = max_before(numbered, ["_all"], "seq", F.col("number"), "above", ranges).filter("waits").select("seq", "_all", F.coalesce("above", F.lit(0)).alias("above"))
    above = count_before(above, ["_all"], "seq", "k", ranges)
    # Each is one more than the greatest fixed number before it and than the one given out before it.
    reach = F.col("above") - F.col("k")
    above = max_before(above, ["_all"], "seq", reach, "_reach", ranges)
    given = above.select("seq", (F.greatest("_reach", reach) + F.col("k") + 1).alias("_no"))
    told = told.join(given, "seq", "left").withColumn(
        "title", F.coalesce("title", F.concat(F.lit(fv.DEFAULT_CHAT_TITLE + " "), F.col("_no").cast("string")))
    )
    born, dead = births, F.col("action") == "delete"
    after = told.groupBy(*CHAT).agg(
        F.max_by("title", F.when(F.col("title").isNotNull() & ~dead, F.col("seq"))).alias("title"),
        F.max_by("at", F.when(~dead, F.col("seq"))).alias("updated_at"),
        F.max_by(F.struct("action", "at"), F.when(born, F.col("seq"))).alias("_birth"),
        F.max(F.when(born, F.col("seq"))).alias("_born"), F.max(F.when(dead, F.col("seq"))).alias("_died"),
    ).filter("_died is null or _born > _died")
    first = chats.select(*CHAT, F.col("created_at").alias("_created"))
    created = F.when(F.col("_birth.action") == "base", F.col("_created")).otherwise(F.col("_birth.at"))
    return after.join(first, CHAT, "left").withColumn("created_at", created).select(
        *[F.col(c).cast(chats.schema[c].dataType).alias(c) for c in chats.columns]
    )


def _newest_last(old):
    """A sort key: by time, of equal times the smaller id last."""
    flipped = F.translate(F.hex(F.encode(old["chat_id"], "UTF-8")), "0123456789ABCDEF", "FEDCBA9876543210")
    return F.struct(old["at"].alias("at"), F.concat(flipped, F.lit("G")).alias("id"))


def latest_alive(touches: DataFrame, asks: DataFrame, ranges: int | None = None) -> DataFrame:
    """(session_id, seq, chat_id): for each of ``asks`` (session_id, seq) the chat of the last touch before it that ends after it.

    ``touches``: session_id, seq, ends, chat_id. Rows are cut into ranges of
    about equal size, however large a session is. An ask that its own range
    cannot settle looks at the latest end of each earlier range of the session
    to find the range that can, and is settled there.
    """
    none = F.lit(None)
    both = touches.withColumn("ask", F.lit(False)).unionByName(
        asks.select("session_id", "seq", F.col("seq").alias("ends"), none.cast("string").alias("chat_id"), F.lit(True).alias("ask"))
    )
    cut = ranged(both, ["session_id"], "seq", ranges)
    here = stage_table(_settled(cut.select("session_id", F.col("_range").cast("bigint").alias("part"), "seq", "ask", "ends", F.col("chat_id").alias("id"))))
    open_ = here.filter("id is null").select("session_id", F.col("part").alias("seq"), F.lit(True).alias("ask"), "ends", none.cast("string").alias("id"))
    tops = cut.filter("not ask").groupBy("session_id", F.col("_range").cast("bigint").alias("seq")).agg(F.max("ends").alias("ends"))
    tops = tops.select("session_id", "seq", F.lit(False).alias("ask"), "ends", F.col("seq").cast("string").alias("id"))
    where = _settled(tops.unionByName(open_).withColumn("part", F.lit(0).cast("bigint")), before=True).filter("id is not null")
    where = stage_table(where.select("session_id", F.col("id").cast("bigint").alias("part"), "ends"))
    parts = where.select("session_id", "part").distinct()
    there = cut.filter("not ask").select("session_id", F.col("_range").cast("bigint").alias("part"), "seq", "ask", "ends", F.col("chat_id").alias("id"))
    there = there.join(parts, ["session_id", "part"], "left_semi").unionByName(
        where.select("session_id", "part", F.lit(_NEVER).alias("seq"), F.lit(True).alias("ask"), "ends", none.cast("string").alias("id"))
    )
    settled = here.filter("id is not null").unionByName(_settled(there))
    return settled.select("session_id", F.col("ends").alias("seq"), F.col("id").alias("chat_id"))


def _settled(rows: DataFrame, before: bool = False) -> DataFrame:
    """(session_id, part, seq, ends, id) of each ask: the id of the last row of its session and part that ends after the ask's ``ends``.

    Rows come by seq; with ``before`` an ask comes before rows of its seq, else after them.
    """
    order = F.when(F.col("ask"), 0 if before else 1).otherwise(1 if before else 0)
    sorted_rows = rows.withColumn("_order", order).repartition("session_id", "part").sortWithinPartitions("session_id", "part", "seq", "_order", "ends")
    kind = "session_id string, part bigint, seq bigint, ends bigint, id string"
    return sorted_rows.select("session_id", "part", "seq", "ask", "ends", "id").mapInArrow(_answers, kind)


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps the rows of a part that no later one outlasts: their ends fall, so a binary search finds the last that ends late enough."""
    names = ["session_id", "part", "seq", "ends", "id"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    current, ends, ids = None, [], []
    for batch in batches:
        out = []
        for session, part, seq, ask, end, id_ in zip(*[batch.column(i).to_pylist() for i in range(6)]):
            if (session, part) != current:
                current, ends, ids = (session, part), [], []
            if ask:
                at = bisect_left(ends, -end)  # ends are kept negated, so that they rise
                out.append((session, part, seq, end, ids[at - 1] if at else None))
                continue
            while ends and -ends[-1] <= end:
                ends.pop(), ids.pop()
            ends.append(-end), ids.append(id_)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
