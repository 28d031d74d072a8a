"""Dense, sparse and fused retrieval with diversity-aware selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trawl.functions import fixed_values as fv
from trawl.functions.scores import recency_score
from trawl.functions.text import strip
from trawl.functions.vectors import cosine01, dot
from trawl.operators.bm25 import ALL, asked_terms, chunk_term_lists, scored_sides, with_scope
from trawl.operators.ranking import SCORE_DIGITS, Mix, best_candidates, sparse_ranges
from trawl.session import stage_table


def parse_allowed(selected: Column) -> Column:
    """Allowed documents from a JSON list or a comma list; NULL means all."""
    listed = F.from_json(selected, "array<string>")
    split = F.filter(F.transform(F.split(selected, ","), lambda s: strip(s)), lambda s: s != "")
    names = F.when(selected.startswith("["), F.coalesce(listed, split)).otherwise(split)
    return F.when(F.size(names) > 0, F.array_sort(F.array_distinct(names)))


def filter_docs(chunks: DataFrame, allowed: DataFrame | None) -> DataFrame:
    """Chunks of the documents named in ``allowed(doc_name)``; None or no row keeps all.

    For rows of questions, ``allowed(query_id, doc_name)`` gives each question its
    own documents; a question without any row keeps all of its rows.
    """
    if allowed is not None and "query_id" in allowed.columns:
        own = allowed.select("query_id", "doc_name").distinct()
        free = chunks.join(own.select("query_id").distinct(), "query_id", "left_anti")
        return free.unionByName(chunks.join(own, ["query_id", "doc_name"], "left_semi").select(*free.columns))
    if allowed is None or allowed.isEmpty():
        return chunks
    return chunks.join(allowed.select("doc_name").distinct(), "doc_name", "left_semi")


def scope_chunks(chunks: DataFrame, scopes: DataFrame | None) -> DataFrame:
    """Chunks with the scopes they belong to; ``scopes(scope, doc_name)`` may overlap."""
    everything = chunks.withColumn("scope", F.lit(ALL))
    if scopes is None:
        return everything
    named = chunks.join(scopes.select("scope", "doc_name").distinct(), "doc_name")
    return everything.unionByName(named)


def vector_dim(df: DataFrame) -> int | None:
    head = df.select(F.size("vec").alias("dim")).filter("dim > 0").limit(1).collect()
    return head[0].dim if head else None


def require_dim(df: DataFrame, dim: int) -> DataFrame:
    """Fail the scan, when it runs, on a vector of another length."""
    message = F.concat(F.lit(f"vector length differs from {dim}: "), F.size("vec").cast("string"))
    return df.withColumn("vec", F.when(F.size("vec") == dim, F.col("vec")).otherwise(F.raise_error(message)))


def keep_dim(df: DataFrame, dim: int) -> DataFrame:
    return df.filter(F.size("vec") == dim)


def _plain(chunks: DataFrame) -> DataFrame:
    """Chunk side of the scorer when only cosine counts."""
    return with_scope(chunks).select("scope", "chunk_key", "vec", F.lit(0.0).alias("recency"))


def _cosine_best(questions: DataFrame, chunks: DataFrame, best_n: int) -> DataFrame:
    asked = with_scope(questions).withColumns({"low": F.lit(0.0), "high": F.lit(0.0)})
    return best_candidates(asked, _plain(chunks), Mix(best_n=best_n))


def dense_scores(questions: DataFrame, chunks: DataFrame, best_n: int = 10) -> DataFrame:
    """Exact inner products, raw and mapped to [0, 1], best ``best_n`` per question."""
    dim = vector_dim(questions)
    chunks = chunks if dim is None else require_dim(chunks, dim)
    return _cosine_best(questions, chunks, best_n).select(
        "query_id", "rank", "chunk_key", "dense_raw", cosine01(F.col("dense_raw")).alias("dense_01")
    )


def mmr_select(candidates: DataFrame, k: int, lambda_: float, floor_zero: bool = True) -> DataFrame:
    """Greedy pick of ``k`` candidates per question, trading closeness for novelty.

    ``candidates``: query_id, rank, dense_raw, vec and any payload; at most a few
    dozen rows per question, so one array per question holds them. ``floor_zero``
    keeps the redundancy penalty at or above zero once something is chosen.
    """
    payload = [c for c in candidates.columns if c not in ("query_id", "rank")]
    grouped = candidates.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", *payload))).alias("cand")
    )
    cand = F.col("cand")
    positions = F.sequence(F.lit(0), F.size(cand) - 1)
    start = F.struct(
        F.array().cast("array<int>").alias("chosen"),
        F.transform(cand, lambda c: F.lit(0.0)).alias("rep"),
    )

    def step(state: Column, _: Column) -> Column:
        open_scores = F.transform(
            positions,
            lambda i: F.when(
                ~F.array_contains(state["chosen"], i),
                F.struct(
                    F.round(
                        lambda_ * F.get(cand, i)["dense_raw"] - (1 - lambda_) * F.get(state["rep"], i), SCORE_DIGITS
                    ).alias("gain"),
                    (-i).alias("back"),
                ),
            ),
        )

        def choose(best: Column) -> Column:
            pick = -best["back"]

            def penalty(c: Column, old: Column) -> Column:
                sim = dot(c["vec"], F.get(cand, pick)["vec"])
                if floor_zero:
                    return F.greatest(old, sim)
                return F.when(F.size(state["chosen"]) == 0, sim).otherwise(F.greatest(old, sim))

            return F.struct(
                F.concat(state["chosen"], F.array(pick)).alias("chosen"),
                F.zip_with(cand, state["rep"], penalty).alias("rep"),
            )

        # A one-element array binds the winner once for all its uses.
        return F.get(F.transform(F.array(F.array_max(open_scores)), choose), F.lit(0))

    rounds = F.sequence(F.lit(1), F.least(F.lit(k), F.size(cand)))
    picked = F.aggregate(rounds, start, step, lambda s: s["chosen"])
    return (
        grouped.select("query_id", "cand", F.posexplode(picked).alias("pick", "at"))
        .select("query_id", (F.col("pick") + 1).alias("pick"), F.get("cand", F.col("at")).alias("c"))
        .select("query_id", "pick", "c.*")
    )


def vector_search(
    questions: DataFrame,
    chunks: DataFrame,
    k: int = 8,
    mmr_lambda: float = 0.5,
    allowed: DataFrame | None = None,
) -> DataFrame:
    """Cosine top 3k, then MMR; the document filter, one for all questions or one each, applies to the result."""
    return filter_docs(search_scoped(questions, chunks, k, mmr_lambda), allowed)


def search_scoped(questions: DataFrame, chunks: DataFrame, k: int, mmr_lambda: float) -> DataFrame:
    dim = vector_dim(chunks)
    asked = questions if dim is None else keep_dim(questions, dim)
    top = _cosine_best(asked, chunks, max(3 * k, k)).select("query_id", "rank", "chunk_key", "dense_raw", "vec")
    picked = mmr_select(top, k, mmr_lambda, floor_zero=False).withColumns(
        {"score": cosine01(F.col("dense_raw")), "dense_01": cosine01(F.col("dense_raw"))}
    )
    return _describe(picked.drop("vec"), chunks)


def score_scoped(
    questions: DataFrame,
    pool: DataFrame,
    as_of: float,
    best_n: int,
    alpha: float = fv.HYBRID_ALPHA,
    recency_weight: float = fv.RECENCY_WEIGHT,
    recency_mode: str = "exponential",
) -> DataFrame:
    """Ranked best candidates of scoped questions among scoped chunks.

    No (question, chunk) pair becomes a row: chunks carry their postings of the
    questions' terms beside the vector, in one written table that two scans
    read, the first for the range of each question's sparse scores and the second
    for the best of the mixed ones. The pool is read once, for that table's
    terms and vectors, and texts go no further.
    """
    dim = vector_dim(questions)
    pool = pool if dim is None else require_dim(pool, dim)
    recency = recency_score(F.col("upload_timestamp"), F.lit(as_of), recency_mode)
    own = pool.select("scope", "chunk_key", "text", "vec", recency.alias("recency"))
    lists = stage_table(chunk_term_lists(own, keep=["vec", "recency"], wanted=asked_terms(questions)))
    asked, ready = scored_sides(questions, lists)
    ready = stage_table(ready)
    asked = questions.select("scope", "query_id", "vec").join(asked, ["scope", "query_id"], "left")
    asked = stage_table(asked)
    limits = asked.join(sparse_ranges(asked, ready), ["scope", "query_id"], "left").withColumns(
        {"low": F.coalesce("low", F.lit(0.0)), "high": F.coalesce("high", F.lit(0.0))}
    )
    return best_candidates(limits, ready, Mix(alpha, recency_weight, best_n))


def score_candidates(
    questions: DataFrame,
    chunks: DataFrame,
    as_of: float,
    scopes: DataFrame | None = None,
    best_n: int = 3 * fv.TOP_K,
    alpha: float = fv.HYBRID_ALPHA,
    recency_weight: float = fv.RECENCY_WEIGHT,
    recency_mode: str = "exponential",
) -> DataFrame:
    """Ranked best candidates with every partial score."""
    pool = scope_chunks(chunks, scopes)
    return score_scoped(with_scope(questions), pool, as_of, best_n, alpha, recency_weight, recency_mode)


def pick_and_describe(best: DataFrame, chunks: DataFrame, k: int, mmr_lambda: float) -> DataFrame:
    """MMR picks of ranked candidates, with the chunk's own columns."""
    picked = (
        mmr_select(best.drop("scope"), k, mmr_lambda)
        .withColumn("dense_01", cosine01(F.col("dense_raw")))
        .withColumnRenamed("final", "hybrid_score")
        .drop("vec")
    )
    return _describe(picked, chunks)


def _describe(picked: DataFrame, chunks: DataFrame) -> DataFrame:
    """Join the few picks to the chunk table.

    The picks are written first, so the planner knows their true size: below
    the broadcast threshold the chunk texts stay where they are, above it both
    sides are shuffled. Chunks are filtered first, below what they are joined from.
    """
    picked = stage_table(picked)
    wanted = chunks.drop("vec", "scope").join(picked.select("chunk_key"), "chunk_key", "left_semi")
    return picked.join(wanted, "chunk_key")


def hybrid_retrieve(
    questions: DataFrame,
    chunks: DataFrame,
    as_of: float,
    scopes: DataFrame | None = None,
    k: int = fv.TOP_K,
    alpha: float = fv.HYBRID_ALPHA,
    mmr_lambda: float = fv.MMR_LAMBDA,
    recency_weight: float = fv.RECENCY_WEIGHT,
    recency_mode: str = "exponential",
) -> DataFrame:
    """Fused retrieval for a table of questions.

    ``questions``: query_id, query_text, vec and optionally scope.
    ``chunks``: chunk_key, doc_name, text, vec, upload_timestamp and payload.
    Result: per question up to ``k`` picks with the chunk's columns and
    dense_raw, dense_01, bm25_raw, bm25_01, fused, recency, hybrid_score.
    """
    best = score_candidates(
        questions, chunks, as_of, scopes, max(3 * k, k), alpha, recency_weight, recency_mode
    )
    return pick_and_describe(best, chunks, k, mmr_lambda)
