"""Score columns: probabilities, recency, fusion and rerank bonus."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from trawl.functions import fixed_values as fv
from trawl.functions.text import contains_any

DAY = 86400.0


def sigmoid(v: Column, null_to_zero: bool = False) -> Column:
    out = F.when(v >= 50, 1.0).when(v <= -50, 0.0).otherwise(1.0 / (1.0 + F.exp(-v)))
    return F.when(v.isNull(), 0.0).otherwise(out) if null_to_zero else out


def score_to_probability(v: Column) -> Column:
    return (
        F.when(v.isNull(), 0.0)
        .when(v >= 50, 1.0)
        .when(v <= -50, 0.0)
        .when((v >= 0) & (v <= 1), v)
        .when(v > 1, 1.0 / (1.0 + F.exp(-v)))
        .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v + 1.0) / 2.0)))
    )


def chunk_probability(
    relevance: Column, hybrid: Column, dense: Column, dense_raw: Column, score: Column
) -> Column:
    """First positive probability of the four partial scores, else the score's."""
    candidates = [score_to_probability(c) for c in (relevance, hybrid, dense, dense_raw)]
    return F.coalesce(*[F.when(p > 0, p) for p in candidates], score_to_probability(score))


def age_days(ts: Column, as_of: Column) -> Column:
    return (as_of - ts) / F.lit(DAY)


def recency_score(ts: Column, as_of: Column, mode: str = "exponential") -> Column:
    """Retrieval-time recency; an unknown upload time scores 0.5."""
    age = age_days(ts, as_of)
    known = {
        "exponential": F.exp(-age / 30.0),
        "linear": F.greatest(F.lit(0.0), 1.0 - age / 90.0),
        "step": F.when(age <= 7, 1.0).when(age <= 30, 0.8).when(age <= 90, 0.5).otherwise(0.2),
    }.get(mode, F.lit(1.0))
    return F.when(ts > 0, known).otherwise(0.5)


def recency_decay(ts: Column, as_of: Column, mode: str = "exponential", tau_days: float = 30.0) -> Column:
    """Registry recency with a tunable time constant, always within [0, 1]."""
    age = age_days(ts, as_of)
    horizon = tau_days * 3
    if mode == "exponential":
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.exp(-age / tau_days)))
    if mode == "linear":
        return F.when(age >= horizon, 0.0).otherwise(1.0 - age / horizon)
    if mode == "step":
        return (
            F.when(age <= 7, 1.0).when(age <= 30, 0.8).when(age <= 90, 0.5)
            .when(age <= 365, 0.2).otherwise(0.05)
        )
    return F.lit(1.0)


def age_bucket(ts: Column, as_of: Column) -> Column:
    """STRUCT<unit, n> of a coarse age; NULL when the time is unknown."""
    d = F.floor(age_days(ts, as_of))
    unit = (
        F.when(d == 0, "today").when(d == 1, "yesterday").when(d < 7, "days")
        .when(d < 30, "weeks").when(d < 365, "months").otherwise("years")
    )
    n = (
        F.when(d < 7, d).when(d < 30, F.floor(d / 7)).when(d < 365, F.floor(d / 30))
        .otherwise(F.floor(d / 365))
    )
    return F.when(F.coalesce(ts, F.lit(0.0)) != 0, F.struct(unit.alias("unit"), n.cast("bigint").alias("n")))


def fuse(dense01: Column, bm25_01: Column, alpha: float = fv.HYBRID_ALPHA) -> Column:
    return (1.0 - alpha) * dense01 + alpha * bm25_01


def recency_boost(fused: Column, recency: Column, weight: float = fv.RECENCY_WEIGHT) -> Column:
    return (1.0 - weight) * fused + weight * recency if weight > 0 else fused


def rescale01(v: Column, low: Column, high: Column) -> Column:
    return F.when(high - low < 1e-12, 0.0).otherwise((v - low) / (high - low))


def logic_bonus(
    text: Column,
    reasoning_words: list[str] = fv.REASONING_WORDS,
    list_markers: list[str] = fv.LIST_MARKERS,
) -> Column:
    t = F.lower(F.coalesce(text, F.lit("")))
    return (
        F.when(contains_any(t, reasoning_words), fv.REASONING_BONUS).otherwise(0.0)
        + F.when(t.rlike(r"\p{Nd}"), fv.DIGIT_BONUS).otherwise(0.0)
        + F.when(contains_any(t, list_markers), fv.LIST_BONUS).otherwise(0.0)
    )
