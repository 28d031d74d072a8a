"""Registration against a stored registry equals registration of everything at once."""

import random

import pytest

from trawl.operators import versions as v
from trawl.sources.registry_store import RegistryStore

COLUMNS = ["session_id", "reg", "doc_id", "file_hash", "version", "result", "message", "matched_reg", "similarity", "status", "superseded_by", "supersedes", "pages"]
SCHEMA = "session_id string, reg bigint, filename string, file_hash string, hi bigint, lo bigint, pages bigint"


def random_uploads(seed, n, centres=4, bits=9):
    rng = random.Random(seed)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    middle = [rng.getrandbits(128) for _ in range(centres)]
    rows = []
    for reg in range(n):
        h = rng.choice(middle)
        for b in rng.sample(range(128), rng.choice([0, 0, 1, 3, bits, bits, 40])):
            h ^= 1 << b
        rows.append((rng.choice("aab"), reg, f"f{rng.randrange(1 + n // 3)}.pdf", f"x{rng.randrange(n)}", signed(h >> 64), signed(h & (1 << 64) - 1), reg * 3))
    return rows


def sorted_rows(df):
    return sorted(map(str, df.select(*COLUMNS).collect()))


@pytest.mark.parametrize("hot, cuts", [(4096, [0, 1, 80]), (3, [0, 40, 80])])
def test_batches_equal_one_registration(spark, tmp_path, hot, cuts):
    rows = random_uploads(hot, 80)
    store = RegistryStore(spark, str(tmp_path / "registry"), buckets=4, payload="pages bigint", hot=hot)
    results = []
    for batch, (a, b) in enumerate(zip(cuts, cuts[1:])):
        done = store.register(spark.createDataFrame(rows[a:b], SCHEMA), batch)
        results += [(r.reg, r.result, r.message) for r in done.results.collect()]
    uploads = spark.createDataFrame(rows, SCHEMA)
    whole = v.register(uploads)
    assert sorted_rows(store.documents()) == sorted_rows(whole)
    assert sorted(results) == sorted((r.reg, r.result, r.message) for r in v.upload_results(uploads, whole).collect())


def test_a_repeated_batch_and_a_compacted_store(spark, tmp_path):
    rows = random_uploads(5, 40)
    store = RegistryStore(spark, str(tmp_path / "registry"), buckets=4, payload="pages bigint", hot=3)
    for _ in range(2):
        store.register(spark.createDataFrame(rows[:30], SCHEMA), 0)
    compacted = RegistryStore(spark, str(tmp_path / "compact"), buckets=2, payload="pages bigint", hot=3)
    store.compact(compacted)
    compacted.register(spark.createDataFrame(rows[30:], SCHEMA), 1)
    assert sorted_rows(compacted.documents()) == sorted_rows(v.register(spark.createDataFrame(rows, SCHEMA)))


def test_one_upload_reads_few_buckets(spark, tmp_path):
    store = RegistryStore(spark, str(tmp_path / "registry"), buckets=32, payload="pages bigint")
    store.register(spark.createDataFrame(random_uploads(1, 60, centres=60), SCHEMA), 0)
    one = spark.createDataFrame(random_uploads(2, 3, centres=1), SCHEMA)
    keys = one.selectExpr("session_id").select("session_id", v.F.explode(v.F.array(v.F.lit(7))).alias("band"))
    scan = store.touched("bands", keys, 1)
    files = scan.select(v.F.input_file_name()).distinct().count()
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert files <= 2 < 20 < len(store._table("bands").inputFiles())


def test_empty_batches(spark, tmp_path):
    store = RegistryStore(spark, str(tmp_path / "registry"), buckets=4, payload="pages bigint")
    assert store.documents().count() == 0
    assert store.register(spark.createDataFrame([], SCHEMA), 0).results.count() == 0
    store.register(spark.createDataFrame(random_uploads(3, 5), SCHEMA), 1)
    assert store.documents().count() == len(v.register(spark.createDataFrame(random_uploads(3, 5), SCHEMA)).collect())
