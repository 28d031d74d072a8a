"""Chats and their messages.

``chats``: session_id, chat_id, title, created_at, updated_at.
``log``: session_id, chat_id, turn, role, content, timestamp, sources, confidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trawl.functions import fixed_values as fv
from trawl.functions.text import strip
from trawl.operators.prefix import count_before

CHAT = ["session_id", "chat_id"]
PART_TURNS = 10_000


def append_exchange(log: DataFrame, exchanges: DataFrame) -> DataFrame:
    """The log with a user and an assistant row per exchange.

    ``exchanges``: session_id, chat_id, seq (order), question, answer, sources,
    confidence, timestamp. New turns follow the last turn of their chat.
    """
    last = log.groupBy(*CHAT).agg(F.max("turn").alias("last"))
    placed = count_before(exchanges, CHAT, "seq", "earlier").join(last, CHAT, "left")
    turn = F.coalesce(F.col("last") + 1, F.lit(0)) + 2 * F.col("earlier")
    sources, confidence = log.schema["sources"].dataType, log.schema["confidence"].dataType

    def message(offset: int, role: str, content: str, src: Column, conf: Column) -> Column:
        return F.struct(
            (turn + offset).cast(log.schema["turn"].dataType).alias("turn"), F.lit(role).alias("role"), F.col(content).alias("content"),
            F.col("timestamp").alias("timestamp"), src.cast(sources).alias("sources"), conf.cast(confidence).alias("confidence"),
        )

    given = F.coalesce(F.col("sources"), F.array().cast(sources))
    rows = F.array(
        message(0, "user", "question", F.lit(None), F.lit(None)),
        message(1, "assistant", "answer", given, F.col("confidence")),
    )
    new = placed.select(*CHAT, F.explode(rows).alias("m")).select(*CHAT, "m.*")
    return log.unionByName(new.select(*log.columns))


def is_default_title(title: Column) -> Column:
    t = F.lower(strip(F.coalesce(title, F.lit(""))))
    return t.rlike(rf"(?U)^{fv.DEFAULT_CHAT_TITLE.lower()}\s*\p{{Nd}}*\z")


def auto_title(chats: DataFrame, log: DataFrame, exchanges: DataFrame) -> DataFrame:
    """Chats after ``exchanges``: touched times, and a title from the first question.

    ``log`` is the state before: only a chat without messages gets a new title,
    and only when its title is still a default one.
    """
    seen = log.select(*CHAT).distinct().withColumn("_had", F.lit(True))
    first = exchanges.groupBy(*CHAT).agg(
        F.min_by("question", "seq").alias("_question"), F.max("timestamp").alias("_touched")
    )
    q = strip(F.col("_question"))
    fresh = F.col("_had").isNull() & (q != "") & is_default_title(F.col("title"))
    return (
        chats.join(first, CHAT, "left").join(seen, CHAT, "left")
        .withColumn("title", F.when(fresh, F.substring(q, 1, fv.TITLE_CHARS)).otherwise(F.col("title")))
        .withColumn("updated_at", F.coalesce("_touched", "updated_at"))
        .select(*chats.columns)
    )


def list_chats(chats: DataFrame, log: DataFrame) -> DataFrame:
    """Chats with message_count, newest first."""
    counts = log.groupBy(*CHAT).agg(F.count(F.lit(1)).alias("message_count"))
    return (
        chats.join(counts, CHAT, "left")
        .select(
            *CHAT, F.coalesce("title", F.lit(fv.DEFAULT_CHAT_TITLE)).alias("title"), "created_at", "updated_at",
            F.coalesce("message_count", F.lit(0)).alias("message_count"),
        )
        .orderBy(F.coalesce("updated_at", F.lit(0)).desc(), *CHAT)
    )


def chat_transcripts(chats: DataFrame, log: DataFrame, as_of: int) -> DataFrame:
    """Chats with defaults filled and ``messages`` nested in turn order.

    A chat of up to PART_TURNS turns is one row, part 0; a longer one is several.
    """
    message = F.struct("turn", "role", "content", "timestamp", "sources", "confidence")
    nested = log.groupBy(*CHAT, F.floor(F.col("turn") / PART_TURNS).alias("part")).agg(
        F.array_sort(F.collect_list(message)).alias("messages")
    )
    none = F.array().cast(nested.schema["messages"].dataType)
    return chats.join(nested, CHAT, "left").select(
        *CHAT, F.coalesce("part", F.lit(0)).alias("part"),
        F.coalesce("title", F.lit(fv.DEFAULT_CHAT_TITLE)).alias("title"),
        F.coalesce("created_at", F.lit(as_of)).alias("created_at"), F.coalesce("updated_at", F.lit(as_of)).alias("updated_at"),
        F.coalesce("messages", none).alias("messages"),
    )


def newest_chat(chats: DataFrame) -> DataFrame:
    """Per session the chat updated last; equal times go to the smaller id."""
    rest = [c for c in chats.columns if c != "session_id"]
    newest_first = F.struct((-F.coalesce("updated_at", F.lit(0))).alias("age"), "chat_id")
    return chats.groupBy("session_id").agg(F.min_by(F.struct(*rest), newest_first).alias("c")).select("session_id", "c.*")


def resolve_chat(questions: DataFrame, chats: DataFrame) -> DataFrame:
    """Add resolved_chat_id and must_create to questions (session_id, chat_id).

    A known chat is used; no chat given means the newest; an unknown one, or no
    chat to fall back to, means a new chat.
    """
    asked = questions.withColumn("_want", F.nullif(strip(F.coalesce("chat_id", F.lit(""))), F.lit("")))
    known = chats.select("session_id", F.col("chat_id").alias("_want"), F.lit(True).alias("_known")).distinct()
    newest = newest_chat(chats).select("session_id", F.col("chat_id").alias("_newest"))
    resolved = F.when(F.col("_want").isNull(), F.col("_newest")).when(F.col("_known"), F.col("_want"))
    return (
        asked.join(known, ["session_id", "_want"], "left").join(newest, "session_id", "left")
        .select(*questions.columns, resolved.alias("resolved_chat_id"), resolved.isNull().alias("must_create"))
    )


def default_number(title: Column) -> Column:
    """Trailing integer of a default title; the bare default counts as 1."""
    digits = F.regexp_extract(title, rf"^{fv.DEFAULT_CHAT_TITLE}.*\s(\p{{Nd}}+)\s*$", 1)
    return F.when(digits != "", digits.try_cast("bigint")).when(strip(title) == fv.DEFAULT_CHAT_TITLE, 1)


def apply_chat_changes(chats: DataFrame, changes: DataFrame) -> DataFrame:
    """Chats after a table of changes: seq, action, session_id, chat_id, title, timestamp.

    Actions: create, create_session, rename, delete. A create without a title
    gets a numbered default: the session's chat count plus one, or for a new
    session one more than the greatest default number in use. A blank rename
    keeps the title; a rename without chat_id means the session's newest chat.

    One call is one simultaneous change: the newest chat, the chat counts and
    the greatest number are those before the batch, and a chat that any row
    deletes is gone, whatever other rows say of it. ``seq`` numbers the creates
    and decides between several renames of a chat, also of one made in the same
    batch. `chat_changes.apply_chat_changes_in_order` applies them one after the other.
    """
    title = F.nullif(strip(F.coalesce("title", F.lit(""))), F.lit(""))
    acts = changes.withColumn("title", title)
    newest = newest_chat(chats).select("session_id", F.col("chat_id").alias("_newest"))
    acts = (
        acts.join(newest, "session_id", "left")
        .withColumn("chat_id", F.coalesce(F.nullif("chat_id", F.lit("")), F.when(F.col("action") == "rename", F.col("_newest"))))
        .drop("_newest")
    )
    held = chats.groupBy("session_id").agg(F.count(F.lit(1)).alias("_held"))
    in_session = count_before(acts.filter("action = 'create'"), ["session_id"], "seq", "_older").join(held, "session_id", "left")
    in_session = in_session.withColumn("_no", F.coalesce("_held", F.lit(0)) + F.col("_older") + 1)
    top = chats.agg(F.coalesce(F.max(default_number(F.col("title"))), F.lit(0)).alias("top")).scalar()
    untitled = acts.filter("action = 'create_session'").withColumn("_blank", F.col("title").isNull())
    across = count_before(untitled, ["_blank"], "seq", "_older").withColumn("_no", top + F.col("_older") + 1)
    both = in_session.drop("_held", "_older").unionByName(across.drop("_blank", "_older"))
    numbered = F.concat(F.lit(fv.DEFAULT_CHAT_TITLE + " "), F.col("_no").cast("string"))
    made = both.select(
        *CHAT, F.coalesce("title", numbered).alias("title"), F.col("timestamp").alias("created_at"),
        F.col("timestamp").alias("updated_at"),
    )
    renames = acts.filter("action = 'rename'").groupBy(*CHAT).agg(
        F.max_by("title", F.when(F.col("title").isNotNull(), F.col("seq"))).alias("_title"), F.max_by("timestamp", "seq").alias("_at")
    )
    gone = acts.filter("action = 'delete'").select(*CHAT).distinct()
    return (
        chats.unionByName(made).join(gone, CHAT, "left_anti").join(renames, CHAT, "left")
        .withColumn("title", F.coalesce("_title", "title")).withColumn("updated_at", F.coalesce("_at", "updated_at"))
        .select(*chats.columns)
    )


def last_sourced_answer(log: DataFrame) -> DataFrame:
    """(session_id, chat_id, turn, sources) of the newest assistant message with sources."""
    sourced = log.filter((F.col("role") == "assistant") & (F.size("sources") > 0))
    return sourced.groupBy(*CHAT).agg(F.max_by(F.struct("turn", "sources"), "turn").alias("m")).select(*CHAT, "m.*")
