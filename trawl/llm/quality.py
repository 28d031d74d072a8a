"""Document quality by co-training two views: the words, and the page's metadata and layout.

Each view is a logistic regression. In every round each view labels the rows of
an unlabelled pool it is surest about for the other one, and both are fitted
again. At the end the views are calibrated on labelled rows kept out of the
fitting and their log odds are weighed together.
"""

from __future__ import annotations

import sys
import zlib

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawl.llm.memory import release
from trawl.llm.tokens import slices
from trawl.session import shuffled, stage_table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Labelled rows, and rows of the unlabelled pool, that training may collect.
MAX_LABELLED, MAX_POOL = 8000, 8000
#: Rows of one key at most; up to here a rank is cut before rows are shuffled.
_PER_KEY = 1000
#: Buckets of hashed byte triples, of sources and of languages.
_TRIPLES, _SOURCES, _LANGS = 256, 32, 8
_WINDOW = 100


def content_features(text: str | None) -> np.ndarray:
    """Word statistics and hashed byte triples of a whole text."""
    triples, words, distinct, same, length, plain = np.zeros(_TRIPLES), 0, 0.0, 0, 0, 0
    for part in slices(text or ""):
        raw = part.encode()
        data = np.frombuffer(raw, np.uint8).astype(np.uint32)
        if len(data) > 2:
            code = (data[:-2] * 2654435761 + data[1:-1] * 40503 * 2246822519 + data[2:] * 3266489917) & 0xFFFFFFFF
            triples += np.bincount((code >> 11) & (_TRIPLES - 1), minlength=_TRIPLES)
        found = raw.split()
        words += len(found)
        same += sum(map(bytes.__eq__, found[1:], found))
        length += len(raw)
        plain += sum(map(bytes.isalpha, found))
        distinct += sum(len(set(found[i : i + _WINDOW])) for i in range(0, len(found), _WINDOW))
    n = max(words, 1)
    triples = np.sqrt(triples / max(triples.sum(), 1))
    return np.concatenate([[distinct / n, same / n, min(length / n, 100), plain / n, np.log1p(words)], triples]).astype(np.float32)


_COUNTED = np.zeros(256, np.uint8)
for _kind, _chars in enumerate(["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t", "\n\r", ".,;:!?'\"-()", "|#%&$*<>{}[]=_~^\\/@+"], 1):
    _COUNTED[list(_chars.encode())] = _kind
_COUNTED[128:] = 8


def metadata_features(text: str | None, n_chars, source: str | None, lang: str | None) -> np.ndarray:
    """Declared length, source and language, and how the page is laid out in characters and lines."""
    text = text or ""
    shares, longest, at = np.zeros(9), 0, 0
    for part in slices(text):
        shares += np.bincount(_COUNTED[np.frombuffer(part.encode(), np.uint8)], minlength=9)
    lines = text.count("\n") + 1
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        longest, at = max(longest, end - at), end + 1
    named = np.zeros(_SOURCES + _LANGS)
    named[zlib.crc32(b"" if source is None else b"=" + source.encode()) % _SOURCES] = 1
    named[_SOURCES + zlib.crc32(b"" if lang is None else b"=" + lang.encode()) % _LANGS] = 1
    sizes = [np.log1p(max(float(n_chars or 0), 0)), np.log1p(lines), np.log1p(len(text) / lines), np.log1p(longest)]
    return np.concatenate([sizes, shares / max(shares.sum(), 1), named]).astype(np.float32)


class View:
    """A ridge logistic regression on standardised, clipped features."""

    def __init__(self, ridge: float = 1.0, limit: float = 6.0) -> None:
        self.ridge, self.limit = ridge, limit

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -self.limit, self.limit)

    def fit(self, x: np.ndarray, y: np.ndarray) -> View:
        self.mean, self.spread = x.mean(axis=0), x.std(axis=0) + 1e-3
        design = np.column_stack([np.ones(len(x)), self._scaled(x)])
        self.weights = _ridge_logistic(design, y, self.ridge)
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._scaled(x) @ self.weights[1:] + self.weights[0], -30, 30)


def _ridge_logistic(x: np.ndarray, y: np.ndarray, ridge: float, rounds: int = 25) -> np.ndarray:
    weights = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (p - y) + penalty * weights
        bend = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(bend, slope)
        weights -= step
        if np.abs(step).max() < 1e-6:
            break
    return weights


class CoTrained:
    """Two calibrated views and their combination; without labels of both classes a constant."""

    def __init__(self, constant: float | None = None) -> None:
        self.constant = constant
        self.shift = 0.0  # of all log odds, for classes that were not picked by their shares

    @staticmethod
    def fit(content: np.ndarray, meta: np.ndarray, y: np.ndarray, pool_content: np.ndarray, pool_meta: np.ndarray, rounds: int = 5, share: float = 0.05) -> CoTrained:
        """Every fourth labelled row of each class is kept for calibration. `share` of the pool is exchanged a round."""
        if len(y) == 0 or len(np.unique(y)) < 2 or min(np.bincount(y.astype(int), minlength=2)) < 8:
            return CoTrained(float(y.mean()) if len(y) else 1.0)
        place = np.zeros(len(y), int)
        for c in (0, 1):
            place[y == c] = np.arange((y == c).sum())
        held = place % 4 == 3
        own = [(content[~held], y[~held]), (meta[~held], y[~held])]
        pool, views = [pool_content, pool_meta], [View(), View()]
        free = [np.ones(len(pool_content), bool), np.ones(len(pool_content), bool)]
        for at in range(rounds + 1):
            for v in (0, 1):
                views[v].fit(*own[v])
            if at == rounds:
                break
            for v in (0, 1):
                other = 1 - v
                ready = np.flatnonzero(free[other])
                logit = views[v].logit(pool[v][ready])
                for label, rate in ((1, y.mean()), (0, 1 - y.mean())):
                    sure = np.round(logit if label else -logit, 9)  # last bits differ between machines
                    n = int(np.ceil(share * rate * len(pool_content)))
                    best = np.argsort(-sure, kind="stable")[:n]
                    best = best[sure[best] > 2.0]
                    chosen = ready[best]
                    free[other][chosen] = False
                    x, old = own[other]
                    own[other] = np.concatenate([x, pool[other][chosen]]), np.concatenate([old, np.full(len(chosen), float(label))])
        out = CoTrained()
        out.views = views
        scores = [views[v].logit((content, meta)[v][held]) for v in (0, 1)]
        out.scales = [_ridge_logistic(np.column_stack([np.ones(held.sum()), s]), y[held], 1.0) for s in scores]
        calibrated = [a + b * s for (a, b), s in zip(out.scales, scores)]
        out.joint = _ridge_logistic(np.column_stack([np.ones(held.sum()), *calibrated]), y[held], 1.0)
        return out

    def score(self, content: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """Columns: probability of good by content, by metadata, by both."""
        if self.constant is not None:
            return np.full((len(content), 3), self.constant)
        logits = [a + b * view.logit(x) for (a, b), view, x in zip(self.scales, self.views, (content, meta))]
        both = self.joint[0] + self.joint[1] * logits[0] + self.joint[2] * logits[1]
        return np.round(1 / (1 + np.exp(-np.clip(np.column_stack([*logits, both]) + self.shift, -30, 30))), 9)


def _features(texts, counts, sources, langs) -> tuple[np.ndarray, np.ndarray]:
    content, meta = [], []
    for t, n, s, g in zip(texts, counts, sources, langs):
        t = t.as_py()
        content.append(content_features(t)), meta.append(metadata_features(t, n.as_py(), s.as_py(), g.as_py()))
    if not content:
        return np.zeros((0, 5 + _TRIPLES), np.float32), np.zeros((0, 13 + _SOURCES + _LANGS), np.float32)
    return np.stack(content), np.stack(meta)


def _inputs(docs: DataFrame, text: str):
    """Text, declared length, source and language; a missing metadata column counts as null."""
    have = docs.columns
    kinds = {"n_chars": "double", "source": "string", "lang": "string"}
    return [F.col(f"`{text}`"), *[(F.col(c) if c in have else F.lit(None)).cast(kind) for c, kind in kinds.items()]]


def _order(seed: int, key: str):
    return F.xxhash64(F.lit(seed), F.col(key))


def class_quotas(sizes: dict[float, int], most: int) -> dict[float, int]:
    """How many keys of each class to pick: all if they fit, else by share, but an eighth of `most` of a rare class."""
    total = sum(sizes.values())
    if total <= most or len(sizes) < 2:
        return {y: min(n, most) for y, n in sizes.items()}
    rare = min(sizes, key=lambda y: (sizes[y], y))
    n = max(1, round(most * sizes[rare] / total), min(sizes[rare], most // 8))
    return {y: n if y == rare else most - n for y in sizes}


def fit(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", rounds: int = 5,
    max_labelled: int = MAX_LABELLED, max_pool: int = MAX_POOL, seed: int = 42,
) -> CoTrained:
    """Fit on at most max_labelled labelled and max_pool other keys, picked by a seeded hash of the key.

    Only keys that docs holds are picked, and each has an equal share of the rows,
    one at least: rows of a key with equal features count once, others by a seeded
    hash. Of a rare class more keys are picked than its share, which the model's
    log odds make up for. Labels above 0.5 in the mean of a key are good; rows without key or label
    are left out. Only the features of the picked rows reach the driver.
    """
    order = _order(seed, key)
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.avg(label).alias("_y"))
    ids = docs.select(key).filter(F.col(key).isNotNull()).distinct()
    marked = stage_table(ids.join(shuffled(known), key, "left").select(key, (F.col("_y") > 0.5).cast("double").alias("_y")))
    sizes = {r["_y"]: r["count"] for r in marked.filter("_y is not null").groupBy("_y").count().collect()}
    quotas = class_quotas(sizes, max_labelled)
    labelled = marked.limit(0)
    for y, n in sorted(quotas.items()):
        labelled = labelled.union(marked.filter(F.col("_y") == y).orderBy(order, key).limit(n))
    pool = marked.filter("_y is null").orderBy(order, key).limit(max_pool)
    wanted = stage_table(labelled.union(pool).withColumnRenamed(key, "_k"))
    bound, keys = max_labelled + max_pool, wanted.count()
    picked = docs.select(F.col(key).alias("_k"), *[c.alias(n) for c, n in zip(_inputs(docs, text), ("t", "n", "s", "g"))])
    picked = picked.join(F.broadcast(wanted), "_k")

    def packed(texts: pa.Array, counts: pa.Array, sources: pa.Array, langs: pa.Array) -> pa.Array:
        content, meta = _features(texts, counts, sources, langs)
        return pa.array([row.tobytes() for row in np.hstack([content, meta])], pa.binary())

    # Features are made where the texts lie. Equal rows of a key count once and every key has its share of the bound.
    made = picked.select("_k", "_y", F.arrow_udf(packed, "binary")("t", "n", "s", "g").alias("x")).dropDuplicates(["_k", "x"])
    place = F.row_number().over(Window.partitionBy("_k").orderBy(F.xxhash64(F.lit(seed), "x"), "x"))
    made = made.withColumn("_place", place).filter(F.col("_place") <= max(1, min(_PER_KEY, bound // max(keys, 1))))
    found = made.orderBy(_order(seed, "_k"), "_k", "x").limit(bound).select("_y", "x").toArrow()
    if not found.num_rows:
        return CoTrained(1.0)
    x = np.frombuffer(b"".join(found["x"].to_pylist()), np.float32).reshape(found.num_rows, -1)
    y = found["_y"].to_numpy().astype(float)
    content, meta, has = x[:, : 5 + _TRIPLES], x[:, 5 + _TRIPLES :], ~np.isnan(y)
    model = CoTrained.fit(content[has], meta[has], y[has], content[~has], meta[~has], rounds)
    if len(sizes) == 2:
        model.shift = float(np.log(sizes[1.0] / sizes[0.0]) - np.log(quotas[1.0] / quotas[0.0]))
    return model


def with_scores(docs: DataFrame, model: CoTrained, text: str = "text") -> DataFrame:
    """docs with content_score, metadata_score and score, the probability of good.

    Every row gets scores from its whole text; a null text counts as empty and
    null metadata as a value of its own. Equal rows score alike. Columns of docs
    with those names are replaced; an empty table stays empty. Scores are rounded
    to nine digits, below which sums may differ between machines.
    """

    def scored(texts: pa.Array, counts: pa.Array, sources: pa.Array, langs: pa.Array) -> pa.Array:
        scores = pa.array(model.score(*_features(texts, counts, sources, langs)).tolist(), pa.list_(pa.float64()))
        release()
        return scores

    names = ["content_score", "metadata_score", "score"]
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in names])
    both = docs.select(rest.alias("row"), F.arrow_udf(scored, "array<double>")(*_inputs(docs, text)).alias("scores"))
    return both.select("row.*", *[F.col("scores")[i].alias(n) for i, n in enumerate(names)])


def cotrained_scores(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Fit on the labelled and unlabelled sample of docs and score all rows; see `fit` and `with_scores`."""
    return with_scores(docs, fit(docs, labels, **options), text=options.get("text", "text"))
