"""Rerank, quality gates, context and prompt, answer confidence.

Inputs hold the few retrieved passages of each question (``pick`` is the rank),
so windows by question stay small. Everything runs in one pass over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from trawl.functions import fixed_values as fv
from trawl.functions.scores import chunk_probability, logic_bonus, sigmoid
from trawl.functions.text import is_summary_question, question_type, reasoning_guide, strip, truncate
from trawl.operators.ranking import SCORE_DIGITS


def _column(df: DataFrame, name: str, kind: str = "double") -> Column:
    """The column, or NULL where the caller's passages lack it."""
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def context_size(question: Column, k: int = fv.CONTEXT_K, summary_k: int = fv.SUMMARY_CONTEXT_K) -> Column:
    return F.when(is_summary_question(question), F.greatest(F.lit(k), F.lit(summary_k))).otherwise(F.lit(k))


def rerank_topk(passages: DataFrame, k: Column | int, model_score: str | None = None) -> DataFrame:
    """Best ``k`` by model score plus bonus; without a model the first ``k``.

    Adds score, relevance and logic_bonus when ranked by a model. The new order
    replaces ``pick``; equal scores keep the old order.
    """
    limit = k if isinstance(k, Column) else F.lit(k)
    if model_score is None:
        return passages.filter(F.col("pick") <= limit)
    bonus = logic_bonus(F.col("text"))
    score = F.col(model_score) + bonus
    order = Window.partitionBy("query_id").orderBy(F.round("score", SCORE_DIGITS).desc(), "pick")
    return (
        passages.withColumns({"logic_bonus": bonus, "score": score, "relevance": sigmoid(score)})
        .withColumn("_place", F.row_number().over(order))
        .filter(F.col("_place") <= limit)
        .drop("pick").withColumnRenamed("_place", "pick")
    )


_IDENTITY = ["query_id", "doc_name", "page", "chunk_id"]


def dedupe_passages(passages: DataFrame) -> DataFrame:
    """First passage per (question, document, page, chunk) in rank order."""
    first = Window.partitionBy(*_IDENTITY).orderBy("pick")
    return passages.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def with_probability(passages: DataFrame) -> DataFrame:
    """Add prob, the passage's probability of being useful."""
    names = ("relevance", "hybrid_score", "dense_01", "dense_raw", "score")
    return passages.withColumn("prob", chunk_probability(*[_column(passages, n) for n in names]))


def judge(
    passages: DataFrame, min_context: float = fv.MIN_CONTEXT_PROB, min_direct: float = fv.MIN_DIRECT_PROB,
    k: int = fv.CONTEXT_K, summary_k: int = fv.SUMMARY_CONTEXT_K,
) -> DataFrame:
    """Label passages with the gate that lets them through; NULL means none.

    context: first of its kind and probable enough. summary: a summary question
    with no such passage takes its top passages. direct: any other question with
    none takes its single best one when that is good enough.
    """
    asked = Window.partitionBy("query_id")
    first = F.row_number().over(Window.partitionBy(*_IDENTITY).orderBy("pick")) == 1
    best = F.row_number().over(asked.orderBy(F.col("_first").desc(), F.col("prob").desc(), "pick")) == 1
    summary = is_summary_question(F.col("query_text"))
    return (
        with_probability(passages)
        .withColumn("_first", first)
        .withColumn("_good", F.col("_first") & (F.col("prob") >= min_context))
        .withColumn("_n_good", F.sum(F.col("_good").cast("int")).over(asked))
        .withColumn("_best", best)
        .withColumn("_place", F.row_number().over(asked.orderBy("pick")))
        .withColumn(
            "gate",
            F.when(F.col("_good"), "context")
            .when((F.col("_n_good") == 0) & summary & (F.col("_place") <= context_size(F.col("query_text"), k, summary_k)), "summary")
            .when((F.col("_n_good") == 0) & ~summary & F.col("_best") & (F.col("prob") >= min_direct), "direct"),
        )
        .drop("_first", "_good", "_n_good", "_best", "_place")
    )


def _through(passages: DataFrame, gate: str, **limits) -> DataFrame:
    return judge(passages, **limits).filter(F.col("gate") == gate).withColumn("relevance", F.col("prob")).drop("gate", "prob")


def gate_context(passages: DataFrame, **limits) -> DataFrame:
    return _through(passages, "context", **limits)


def gate_summary(passages: DataFrame, **limits) -> DataFrame:
    return _through(passages, "summary", **limits)


def gate_direct(passages: DataFrame, **limits) -> DataFrame:
    return _through(passages, "direct", **limits)


def gate_passages(passages: DataFrame, **limits) -> DataFrame:
    """All passages any gate lets through, relevance set to their probability."""
    kept = judge(passages, **limits).filter(F.col("gate").isNotNull())
    return kept.withColumn("relevance", F.col("prob")).drop("gate", "prob")


def no_answer(questions: DataFrame, kept: DataFrame) -> DataFrame:
    """Questions left without passages, with the apology and confidence 0."""
    return questions.join(kept.select("query_id").distinct(), "query_id", "left_anti").withColumns(
        {"answer": F.lit(fv.MSG_NO_ANSWER), "confidence": F.lit(0.0)}
    )


def context_topk(kept: DataFrame, k: int = fv.CONTEXT_K, summary_k: int = fv.SUMMARY_CONTEXT_K) -> DataFrame:
    """Kept passages by relevance, numbered in ``place``, cut to the context size."""
    order = Window.partitionBy("query_id").orderBy(F.round("relevance", SCORE_DIGITS).desc(), "pick")
    return kept.withColumn("place", F.row_number().over(order)).filter(
        F.col("place") <= context_size(F.col("query_text"), k, summary_k)
    )


def build_context(context: DataFrame) -> DataFrame:
    """(query_id, context): numbered passage blocks parted by blank lines."""
    header = F.format_string(
        fv.CONTEXT_HEADER, F.col("place").cast("int"), F.col("doc_name"), F.col("page").cast("string"),
        F.coalesce("relevance", F.lit(0.0)),
    )
    body = truncate(strip(F.replace("text", F.lit("\n"), F.lit(" "))), fv.CONTEXT_CHARS)
    blocks = context.select("query_id", "place", F.concat(header, F.lit("\n"), body).alias("block"))
    ordered = F.array_sort(F.collect_list(F.struct("place", "block")))
    return blocks.groupBy("query_id").agg(F.array_join(ordered["block"], "\n\n").alias("context"))


def build_prompt(questions: DataFrame, contexts: DataFrame) -> DataFrame:
    """Add question_type, prompt and output_budget to questions that have a context."""
    q = F.col("query_text")
    summary = is_summary_question(q)
    guide = F.when(summary, fv.SUMMARY_GUIDE).otherwise(reasoning_guide(question_type(q)))
    layout = F.when(summary, fv.SUMMARY_LAYOUT).otherwise(F.lit(fv.ANSWER_LAYOUT))
    sections = [
        (fv.SECTION_CONTEXT, F.col("context")), (fv.SECTION_QUESTION, q), (fv.SECTION_GUIDE, guide),
        (fv.SECTION_LAYOUT, F.concat(layout, F.lit("\n" + fv.CITATION_NOTE))),
    ]
    parts = [F.lit(fv.SYSTEM_PROMPT)] + [F.concat(F.lit(title + "\n"), body) for title, body in sections]
    return questions.join(contexts, "query_id").withColumns(
        {
            "question_type": question_type(q),
            "prompt": F.concat_ws("\n\n", *parts),
            "output_budget": F.when(summary, 2 * fv.MAX_OUTPUT_TOKENS).otherwise(fv.MAX_OUTPUT_TOKENS),
        }
    )


def answer_confidence(passages: DataFrame) -> DataFrame:
    """(query_id, confidence) from the best partial score of each passage."""
    parts = [_column(passages, n) for n in ("relevance", "hybrid_score", "dense_01", "bm25_01")]
    best = F.coalesce(F.greatest(*parts), F.when(_column(passages, "score").isNotNull(), sigmoid(_column(passages, "score"))))
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), best))
    lists = passages.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.when(best.isNotNull(), clipped)), asc=False).alias("s")
    )
    top = lists.withColumn("top", F.get("s", F.lit(0))).withColumn(
        "support",
        F.when(F.size("s") > 2, (F.get("s", F.lit(1)) + F.get("s", F.lit(2))) / 2).otherwise(
            F.coalesce(F.get("s", F.lit(1)), F.col("top"))
        ),
    )
    p = F.col("top")
    strong = F.size(F.filter("s", lambda x: x >= 0.6)) / F.size("s")
    agree = 1.0 - F.least(F.lit(1.0), F.abs(p - F.col("support")))
    mixed = 0.6 * p + 0.25 * F.col("support") + 0.1 * strong + 0.05 * agree
    floor = F.when(p >= 0.85, 0.92).when(p >= 0.75, 0.84).when(p >= 0.65, 0.76).otherwise(0.0)
    value = F.least(F.lit(0.99), F.greatest(p * 0.9, mixed, floor))
    return top.select("query_id", F.when(F.size("s") > 0, value).otherwise(0.0).alias("confidence"))
