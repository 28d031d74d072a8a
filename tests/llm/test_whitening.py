"""Whitening with block matrices against exact integers and numpy."""

import math
from fractions import Fraction

import numpy as np
import pytest

from trawl.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>, index int, x string, _id int, n int"


def made(n, d, seed=1, low=3):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, low)) @ rng.normal(size=(low, d)) * 2 + rng.normal(size=(n, d)) * 0.3 + 5).astype(np.float32)


def expected(rows, k):
    """(n, {row number: deviation}, whitened without signs, explained) of usable rows by numpy over exact integers."""
    xs = {i: [math.floor(64 * float(c)) + 1000000 for c in v] for i, v in enumerate(rows)}
    distinct = sorted({tuple(x) for x in xs.values()})
    n, sums = len(distinct), [sum(c) for c in zip(*distinct)]
    centred = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(x, sums)] for x in distinct])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(k, int((values > values[0] * 1e-12).sum()))
    deviation = {i: sum((n * a - s) ** 2 for a, s in zip(x, sums)) for i, x in xs.items()}
    white = {i: (np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, sums)]) @ vectors[:, :k]) / np.sqrt(values[:k]) for i, x in xs.items()}
    return n, deviation, white, values[:k] / values.sum()


def compare(got, rows, keys, k=16):
    n, deviation, white, explained = expected(rows, k)
    got = sorted(got, key=lambda r: (r.deviation, r.component))
    assert len(got) == len(rows) * len(explained) and {r.n for r in got} == {n}
    assert sorted((r.vec_id, r.deviation) for r in got if r.component == 1) == sorted((keys[i], deviation[i]) for i in white)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    signs = {}
    place = {(keys[i], deviation[i]): i for i in white}
    for r in got:
        want = white[place[r.vec_id, r.deviation]][r.component - 1]
        assert abs(abs(r.whitened) - abs(want)) < 1e-7
        if abs(want) > 1e-6:
            assert signs.setdefault(r.component, r.whitened * want > 0) == (r.whitened * want > 0)
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-9


@pytest.mark.parametrize("how", [{}, {"block_bytes": 8 * 20 * 7, "slab_blocks": 3}])
def test_against_numpy(spark, how):
    vectors = made(203, 20)
    rows = [*vectors, vectors[3], vectors[3], vectors[8]]
    keys = [*range(203), 900, 3, 901]
    bad = [(1000, None), (1001, []), (1002, [1.0] * 19), (1003, [None] + [1.0] * 19), (1004, [float("nan")] * 20), (1005, [float("-inf")] + [0.0] * 19)]
    table = [(k, [float(c) for c in v], 1, "x", 2, 3) for k, v in zip(keys, rows)] + [(k, v, 1, "x", 2, 3) for k, v in bad]
    df = spark.createDataFrame(table, SCHEMA).repartition(5)
    compare(whitening.whiten(df, **how).collect(), rows, keys)


def test_few_rows_and_constant_dimensions(spark):
    vectors = made(4, 6)
    vectors[:, 2] = 1.5
    df = spark.createDataFrame([(i, [float(c) for c in v], 1, "", 1, 1) for i, v in enumerate(vectors)], SCHEMA)
    got = whitening.whiten(df).collect()
    compare(got, list(vectors), list(range(4)))
    assert max(r.component for r in got) == 3


def test_tiny_variance_far_from_zero(spark):
    rng = np.random.default_rng(4)
    vectors = (1000 + rng.integers(0, 3, size=(60, 5)) / 64).astype(np.float32)
    df = spark.createDataFrame([(i, [float(c) for c in v], 1, "", 1, 1) for i, v in enumerate(vectors)], SCHEMA)
    compare(whitening.whiten(df).collect(), list(vectors), list(range(60)))


def test_nothing_to_whiten(spark):
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for rows in ([], [(1, None, 1, "", 1, 1)], [(1, [1.0, 2.0], 1, "", 1, 1)] * 3):
        df = whitening.whiten(spark.createDataFrame(rows, SCHEMA))
        assert df.columns == names and df.count() == 0
