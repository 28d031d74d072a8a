"""Approximate nearest neighbours by cosine over balanced posting lists.

Centroids are trained on a bounded sample by halving it again and again, so that
lists stay balanced, and connected to a graph that every task keeps in memory.
Each vector goes to its nearest list and, near a boundary, to several. A query
walks the graph and visits the lists whose centroid is at most `ratio` times as
far as the nearest; that ratio is the smallest that reaches the wanted recall on
the sample.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawl.session import stage_table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Vectors that training collects, and the most centroids, which every task holds.
MAX_SAMPLE, MAX_CENTROIDS = 20_000, 4096
#: Vectors a list has on average before any are replicated.
LIST_VECTORS = 100
#: Most lists a vector goes to, and how much farther than the nearest their centroids may be.
REPLICAS, BOUNDARY = 4, 1.15
#: Lists visited at least, and rows of a list or of its queries handled at once.
LEAST_LISTS, BLOCK = 8, 4096
#: Rows of both sides that a task scores together.
SHARD = 40_000


def _unit(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def balanced_centroids(x: np.ndarray, n: int, rounds: int = 4) -> np.ndarray:
    """n unit centroids, n a power of two: halves of halves of the sample, then a few rounds of spherical k-means."""
    groups = [np.arange(len(x))]
    while len(groups) < n:
        halves = []
        for g in groups:
            part = x[g]
            a, b = part[np.argmin(part @ part.mean(axis=0))], part[0]
            b = part[np.argmin(part @ a)]
            for _ in range(3):
                lean = part @ (a - b)
                near = lean >= np.median(lean)
                a, b = (part[near] if near.any() else part).mean(axis=0), (part[~near] if not near.all() else part).mean(axis=0)
            order = np.argsort(-(part @ (a - b)), kind="stable")
            halves += [g[order[: (len(g) + 1) // 2]], g[order[(len(g) + 1) // 2 :]]]
        groups = halves
    centroids = np.stack([x[g].mean(axis=0) for g in groups if len(g)])
    for _ in range(rounds):
        centroids = centroids / np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-12)
        own = np.argmax(x @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        some = np.bincount(own, minlength=len(centroids)) > 0
        centroids[some] = sums[some]
    return centroids / np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-12)


class Graph:
    """Centroids and the links each has to its nearest others and to a few at random."""

    def __init__(self, centroids: np.ndarray, near: int = 16, far: int = 4, seed: int = 42) -> None:
        n = len(centroids)
        self.centroids = centroids.astype(np.float32)
        sims = centroids @ centroids.T
        np.fill_diagonal(sims, -2)
        links = np.argsort(-sims, axis=1, kind="stable")[:, : min(near, max(n - 1, 1))]
        random = np.random.default_rng(seed).integers(0, n, (n, far))
        self.links = np.concatenate([links, random], axis=1).astype(np.int32)
        self.entries = np.unique(np.linspace(0, n - 1, min(n, 16)).astype(np.int32))

    def search(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, similarities), nearest first, of the `width` best met on a best-first walk from the entries."""
        if len(x) > 512:
            parts = [self.search(x[i : i + 512], width) for i in range(0, len(x), 512)]
            return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        n, c = len(x), len(self.centroids)
        width = min(width, c)
        x = x.astype(np.float32)
        seen = np.zeros((n, c), bool)
        beam = np.tile(self.entries, (n, 1))
        seen[:, self.entries] = True
        sims = x @ self.centroids[self.entries].T
        walked = np.zeros(beam.shape, bool)
        rows = np.arange(n)[:, None]
        while True:
            ranked = np.where(walked, -3.0, sims)
            step = np.argpartition(-ranked, min(3, ranked.shape[1] - 1), axis=1)[:, :4]
            open_ = ranked[rows, step] > -2.5
            if not open_.any():
                break
            walked[rows, step] = True
            found = np.where(open_[:, :, None], self.links[beam[rows, step]], beam[rows, step][:, :, None]).reshape(n, -1)
            found.sort(axis=1)
            fresh = ~seen[rows, found]
            fresh[:, 1:] &= found[:, 1:] != found[:, :-1]
            seen[rows, found] = True
            value = np.einsum("nd,nkd->nk", x, self.centroids[found])
            beam = np.concatenate([beam, found], axis=1)
            sims = np.concatenate([sims, np.where(fresh, value, -3.0)], axis=1)
            walked = np.concatenate([walked, ~fresh], axis=1)
            if beam.shape[1] > width:
                best = np.argpartition(-sims, width - 1, axis=1)[:, :width]
                beam, sims, walked = beam[rows, best], sims[rows, best], walked[rows, best]
        order = np.argsort(-sims, axis=1, kind="stable")
        return beam[rows, order], sims[rows, order]


def _far(sims: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * sims, 1e-12))


class Index:
    """Graph and ratio; `lists_of` serves the vectors that are stored, `visits` the queries."""

    def __init__(self, graph: Graph, ratio: float = 1.0) -> None:
        self.graph, self.ratio = graph, ratio

    def lists_of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list): the nearest list and up to REPLICAS in all whose centroids are nearly as near."""
        found, sims = self.graph.search(x, 4 * REPLICAS)
        found, far = found[:, :REPLICAS], _far(sims[:, :REPLICAS])
        rows, at = np.nonzero((far <= BOUNDARY * far[:, :1]) & (sims[:, :REPLICAS] > -2.5))
        return rows, found[rows, at]

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list): the lists whose distance is at most `ratio` times the nearest's, LEAST_LISTS at least; a walk is widened until it holds them all."""
        c, width = len(self.graph.centroids), 64
        while True:
            found, sims = self.graph.search(x, width)
            far = _far(sims)
            inside = far <= self.ratio * far[:, :1]
            if width >= c or not inside[:, -1].any():
                break
            width *= 4
        inside[:, :LEAST_LISTS] = True
        rows, at = np.nonzero(inside & (sims > -2.5))
        return rows, found[rows, at]

    @staticmethod
    def fit(sample: np.ndarray, n: int, k: int, recall: float = 0.96) -> Index:
        """Train on unit rows of a sample of n vectors; the ratio is tried on some of the sample's rows as queries."""
        wanted = 1 << max(0, round(math.log2(max(n / LIST_VECTORS, 1))))
        c = min(wanted, MAX_CENTROIDS, 1 << max(0, int(math.log2(max(len(sample) / 8, 1)))))
        index = Index(Graph(balanced_centroids(sample, c)))
        tries = np.arange(0, len(sample), max(1, len(sample) // 300))
        rows, lists = index.lists_of(sample)
        stored = np.zeros((len(index.graph.centroids), len(sample)), bool)
        stored[lists, rows] = True
        sims = sample[tries] @ sample.T
        sims[np.arange(len(tries)), tries] = -2
        best = np.argsort(-sims, axis=1)[:, :k]
        found, near = index.graph.search(sample[tries], len(index.graph.centroids))
        far = _far(near)
        # The place of the first visited list that holds each of a query's best, and the ratio that reaches it.
        holds = np.stack([stored[found[i]][:, best[i]] for i in range(len(tries))])
        first = np.where(holds.any(axis=1), holds.argmax(axis=1), len(index.graph.centroids) - 1)
        needed = np.take_along_axis(far, first, axis=1) / far[:, :1]
        needed[first < LEAST_LISTS] = 1.0
        index.ratio = float(np.quantile(needed, min(recall, 1.0), method="higher")) + 1e-9
        return index


def _packed(x: np.ndarray) -> list[bytes]:
    return [row.tobytes() for row in np.ascontiguousarray(x)]


def _unpacked(rows, kind=np.float64) -> np.ndarray:
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1)


def _valid(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    norm = F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    return v.isNotNull() & (F.size(v) > 0) & ~bad & (norm > 0)


def _listed(index: Index, queries: bool):
    """Rows (rep, v) as (list, rep, v)."""

    def rows(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = _unit(_unpacked(part.column(1).to_pylist()))
                row, lists = index.visits(x) if queries else index.lists_of(x)
                picked = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), picked.column(0), picked.column(1)], ["list", "rep", "v"])

    return rows


def _blocked(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows with the block of their list they fall in, and (list, blocks)."""
    counts = rows.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(f"{name}s"))
    blocked = rows.join(counts, "list").withColumn(name, F.pmod(F.xxhash64("rep"), F.col(f"{name}s")).cast("int")).drop(f"{name}s")
    return blocked, counts


def _scored(k: int):
    """The k + 1 best of each query over all lists of a shard; both sides' rows are (list, block, part, rep, least, v)."""
    keys = ["list", "block", "part"]

    def in_list(stored: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        stored = stored.sort_values("least")
        a, b = _unpacked(asked["v"].tolist()), _unpacked(stored["v"].tolist())
        sims = (a @ b.T) / (np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :])
        best = np.argsort(-sims, axis=1, kind="stable")[:, : k + 1]
        query = np.repeat(asked["rep"].to_numpy(), best.shape[1])
        picked = stored.iloc[best.ravel()]
        return pd.DataFrame({"query": query, "rep": picked["rep"].to_numpy(), "least": picked["least"].to_numpy(), "score": np.take_along_axis(sims, best, axis=1).ravel()})

    def rows(stored: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        lists = dict(iter(stored.groupby(keys))) if len(stored) else {}
        found = [in_list(lists[key], part) for key, part in asked.groupby(keys) if key in lists] if len(asked) else []
        if not found:
            return pd.DataFrame({"query": np.zeros(0, np.int64), "rep": np.zeros(0, np.int64), "score": np.zeros(0)})
        both = pd.concat(found).sort_values(["query", "score", "least"], ascending=[True, False, True])
        both = both.drop_duplicates(["query", "rep"])
        return both.groupby("query").head(k + 1)[["query", "rep", "score"]]

    return rows


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", recall: float = 0.96, seed: int = 42) -> DataFrame:
    """(query_id, rank, key, score): for each row with is_query its k nearest other rows by cosine, as far as found.

    Vectors that are null, empty or zero, or hold null or non-finite components
    take no part, nor do those without a key or of another length than most;
    they get no rows as queries. Equal vectors are searched once, so that any
    number of copies costs no more, and the k + 1 smallest keys stand for them.
    Ties go to the smaller key. Scores are in double precision on the vectors as
    they are. Rows that repeat a key count as candidates each, but none with the
    query's own key does. With fewer than k
    others all are returned; an empty table gives no rows.
    """
    value = F.col(f"`{vector}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{key}`").alias("id"), value.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asked"))
    rows = rows.filter(F.col("id").isNotNull() & _valid(F.col("v")))
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.filter(F.size("v") == (length.n if length else 0))

    def packed(batch: pa.Array) -> pa.Array:
        flat = batch.flatten().to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
        return pa.array(_packed(flat.reshape(len(batch), -1)) if len(batch) else [], pa.binary())

    rows = stage_table(rows.select("id", "asked", F.arrow_udf(packed, "binary")("v").alias("v")))
    copies = Window.partitionBy("v").orderBy("id")
    kept = stage_table(rows.select("v", "id").withColumn("place", F.row_number().over(copies)).filter(F.col("place") <= k + 1))
    reps = stage_table(kept.filter("place = 1").select("v", F.col("id").alias("least")).withColumn("rep", F.monotonically_increasing_id()))
    members = kept.join(reps.select("v", "rep"), "v").select("rep", "id")
    asking = rows.filter("asked").join(reps.select("v", "rep"), "v").select(F.col("rep").alias("query"), F.col("id").alias("query_id"))
    asking = stage_table(asking)
    near = _near_reps(reps, asking.select(F.col("query").alias("rep")).distinct(), k, recall, seed)
    pairs = near.join(members, "rep").join(asking, "query").filter("id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(key), "score")


def _near_reps(reps: DataFrame, asked: DataFrame, k: int, recall: float, seed: int) -> DataFrame:
    """(query, rep, score): the k + 1 best distinct vectors found for each distinct query vector, itself included."""
    n = reps.count()
    sample = reps.orderBy(F.xxhash64(F.lit(seed), "v"), "v").limit(MAX_SAMPLE).select("v").toArrow()
    if not n:
        return reps.select(F.col("rep").alias("query"), "rep", F.lit(0.0).alias("score"))
    index = Index.fit(_unit(_unpacked(sample["v"].to_pylist())), n, k, recall)
    schema = "list int, rep bigint, v binary"
    stored = stage_table(reps.select("rep", "v").mapInArrow(_listed(index, False), schema))
    visits = stage_table(reps.join(asked, "rep", "left_semi").select("rep", "v").mapInArrow(_listed(index, True), schema))
    stored_rows, visit_rows = stored.count(), visits.count()
    stored, stored_blocks = _blocked(stored, "block")
    visits, visit_blocks = _blocked(visits, "part")
    # A list of many rows or queries is scored block by block, every part of one with every block of the other,
    # and lists are gathered to shards of bounded size, whose tasks hand on each query's best only.
    each = lambda name: F.explode(F.sequence(F.lit(0), F.col(f"{name}s") - 1)).alias(name)
    columns = ["list", "block", "part", "rep", "v"]
    left = stored.join(visit_blocks, "list").select("list", "block", each("part"), "rep", "v").select(*columns)
    right = visits.join(stored_blocks, "list").select("list", each("block"), "part", "rep", "v").select(*columns)
    rows = stored_rows + visit_rows
    shard = F.pmod(F.xxhash64("list", "block", "part"), F.lit(max(1, math.ceil(rows / SHARD)))).alias("shard")
    left = left.join(reps.select("rep", "least"), "rep").select(shard, *columns, "least")
    right = right.select(shard, *columns)
    scored = left.groupBy("shard").cogroup(right.groupBy("shard")).applyInPandas(_scored(k), "query bigint, rep bigint, score double")
    once = scored.groupBy("query", "rep").agg(F.max("score").alias("score")).join(reps.select("rep", "least"), "rep")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "least")
    return once.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k + 1).select("query", "rep", "score")
