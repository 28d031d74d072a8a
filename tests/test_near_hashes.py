"""Close hashes by bands, cells and tiles against plain loops."""

import random

import pytest

from __spark_entry__ import queries
from trawl.functions import fixed_values as fv
from trawl.operators import near_hashes as nh, versions as v


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def clustered(n, seed):
    """Distinct hashes around one centre, so that every band key is crowded."""
    rng = random.Random(seed)
    centre, out = rng.getrandbits(128), {}
    while len(out) < n:
        h = centre
        for b in rng.sample(range(128), rng.randrange(9)):
            h ^= 1 << b
        out[h] = None
    return list(out)


@pytest.mark.parametrize("hot", [1 << 16, 7])
def test_nearest_earlier_equals_a_loop(spark, hot):
    hashes = clustered(90, 1)
    rng = random.Random(2)
    rows = [(rng.choice("ab"), h, i, rng.randrange(5), rng.randrange(3)) for i, h in enumerate(hashes)]
    df = spark.createDataFrame(
        [(s, signed(h >> 64), signed(h & (1 << 64) - 1), i, i % 3 > 0, i, first, version, i, f"d{first}", f"d{first}.pdf") for s, h, i, first, version in rows],
        "session_id string, hi bigint, lo bigint, id bigint, asks boolean, turn bigint, doc_first bigint, version bigint, reg bigint, doc_id string, filename string",
    )
    got = {r.id: (r.distance, r.prior.reg) for r in nh.nearest_earlier(df, 10, hot).collect()}
    want = {}
    for s, h, i, _, _ in rows:
        near = [((h ^ o).bit_count(), first, version, j) for t, o, j, first, version in rows if t == s and j < i and (h ^ o).bit_count() <= 10]
        if i % 3 and near:
            want[i] = (min(near)[0], min(near)[3])
    assert len(want) > 30 and got == want


@pytest.mark.parametrize("distance, hot", [(0, 5), (1, 1 << 16), (3, 4), (10, 5)])
def test_close_pairs_come_once_with_their_columns(spark, distance, hot):
    hashes = clustered(70, 3)
    df = spark.createDataFrame([("s", signed(h >> 64), signed(h & (1 << 64) - 1), i) for i, h in enumerate(hashes)], "session_id string, hi bigint, lo bigint, n bigint")
    rows = nh.close_pairs(df, distance, hot).collect()
    want = {(i, j) for j in range(70) for i in range(j) if (hashes[i] ^ hashes[j]).bit_count() <= distance}
    assert sorted(tuple(sorted([r.n_a, r.n_b])) for r in rows) == sorted(want)
    assert all((r.hi_a, r.lo_a) < (r.hi_b, r.lo_b) for r in rows)


def test_hashes_of_crowded_keys_are_dealt_once_a_band(spark):
    """More than 4096 hashes of one key: eleven rows each are shuffled, not a thousand."""
    df = spark.range(5000).selectExpr("'' AS session_id", "0L AS hi", "id AS lo")
    assert nh._dealt(df, fv.MAX_HAMMING, nh.HOT_BAND).count() == 11 * 5000


def documents(hashes):
    return [(i, signed(h >> 64), signed(h & (1 << 64) - 1)) for i, h in hashes]


@pytest.mark.parametrize("hot", [1 << 16, 6])
def test_classes_and_links_equal_a_loop(spark, hot):
    """Two crowds, a chain, copies and lone hashes: rows by document equal what all pairs tell."""
    chain = [((1 << 9 * i) - 1) << 7 | 5 << 100 for i in range(1, 8)]  # nine bits from one to the next
    hashes = [*clustered(60, 4), *clustered(25, 5), *chain, *clustered(60, 4)[:9], *(random.Random(6).getrandbits(128) for _ in range(5))]
    rows = list(enumerate(hashes, 100))
    random.Random(7).shuffle(rows)
    got = {
        r.doc_id: (r.class_id, r.n_copies, r.n_links, r.distance, r.similarity)
        for r in v.near_duplicate_documents(spark.createDataFrame(documents(rows), "doc_id bigint, hi bigint, lo bigint"), hot=hot).collect()
    }
    want = {}
    for i, h in rows:
        reached, new = {i}, [h]
        while new:
            at = new.pop()
            found = [(j, o) for j, o in rows if j not in reached and (at ^ o).bit_count() <= 10]
            reached |= {j for j, _ in found}
            new += [o for _, o in found]
        near = [d for d in ((h ^ o).bit_count() for _, o in rows) if 0 < d <= 10]
        least = min(near) if near else None
        want[i] = min(reached), sum(o == h for _, o in rows) - 1, len(near), least, None if least is None else 1 - least / 128
    assert got == want and {w[0] for w in want.values()} >= {100, 160, 185} and max(w[2] for w in want.values()) > 20


def test_near_duplicate_query_rows_grow_with_documents(spark):
    """A crowd of 400 near hashes: a row for each document, not one for each of its 79,800 pairs."""
    rows = documents(enumerate([1 << a | 1 << 64 + b for a in range(20) for b in range(20)]))
    docs = spark.createDataFrame(rows, "doc_id bigint, hi bigint, lo bigint")
    told = v.near_duplicate_documents(docs).collect()
    assert len(told) == 400 and {(r.class_id, r.n_links, r.distance) for r in told} == {(0, 399, 2)}
    assert v.near_duplicate_pairs(docs).count() == 400 * 399 // 2


def test_links_inside_a_task_give_a_row_for_each_hash(spark):
    rows = spark.range(600).selectExpr("'' AS session_id", "0L AS hi", "1L << cast(id % 25 AS int) | 1L << cast(25 + id / 25 AS int) AS lo", "id AS node", "1L AS n_docs")
    assert nh.close_links(rows, fv.MAX_HAMMING).count() <= 11 * 600


def test_near_duplicate_pairs_query_gives_a_row_for_each_pair(spark, tmp_path):
    """Texts that differ in a few words, copies too: the query names every close pair of hashes, with its distance and documents."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(w if rng.random() > 0.01 else rng.choice(words) for w in words) for _ in range(30)]
    texts += [texts[0], texts[0], texts[1], *(" ".join(rng.choices(words, k=50)) for _ in range(5))]
    spark.createDataFrame(list(enumerate(texts, 100)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    first, copies = {}, {}
    for r in sorted(v.simhash128_rows(spark.read.parquet(f"{tmp_path}/documents.parquet")).select("doc_id", "hi", "lo").collect()):
        h = r.hi % (1 << 64) << 64 | r.lo % (1 << 64)
        first.setdefault(h, r.doc_id)
        copies[h] = copies.get(h, 0) + 1
    want = set()
    for g in first:
        for h in first:
            d = (g ^ h).bit_count()
            if first[g] < first[h] and d <= 10:
                want.add((first[g], first[h], copies[g] + copies[h], d, 1 - d / 128))
    got = [tuple(r) for r in queries()["near_duplicate_pairs"](spark, str(tmp_path)).select("doc_a", "doc_b", "n_docs", "distance", "similarity").collect()]
    assert len(got) == len(want) > len(texts) and set(got) == want and max(w[2] for w in want) > 3
