"""Registered queries against their SQL on the smallest data set, and the composed flows."""

import importlib.util
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import entry, oracle_sql, queries
from conftest import SMALL
from trawl.plans import steps

_spec = importlib.util.spec_from_file_location("check", Path(__file__).resolve().parents[1] / "tools" / "check.py")
check = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(check)

QUICK = [
    "normalize_session_id", "recency_score", "question_type", "strip_repeated", "chunk_semantic", "near_duplicate_pairs", "supersede",
    "bm25_scores", "mmr_select", "hybrid_retrieve", "gate_summary", "build_prompt", "extract_citations", "embed_column", "apply_chat_changes",
    "session_summary", "rate_limit", "job_state", "eval_report",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in check.TABLES:
        c.execute(f"CREATE VIEW {t} AS FROM '{SMALL}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, con, name):
    assert check.differences(queries()[name](spark, SMALL), con, oracle_sql()[name]) == []


def test_every_query_is_listed_once():
    names = set(queries())
    assert set(oracle_sql()) <= names and len(names) > 100


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0


CACHE = "k string, answer string, confidence double, citations array<struct<filename:string,page:bigint>>, ts bigint"
VEC = {"alpha": [1.0, 0.0], "beta": [0.0, 1.0]}


def _vec(text):
    return [float(text.count("alpha")) + 0.01, float(text.count("beta")) + 0.01]


def test_ask_scopes_cache_and_errors(spark):
    texts = {"a": "alpha alpha one", "b": "beta two", "c": "alpha beta three", "d": "other four"}
    rows = [(s, f"{s}-{n}", f"{n}.pdf", 1, 0, t, _vec(t), 1.0) for s in ("s1", "s2") for n, t in texts.items() if s == "s1" or n != "a"]
    chunks = spark.createDataFrame(rows, "session_id string, chunk_key string, doc_name string, page bigint, chunk_id bigint, text string, vec array<double>, upload_timestamp double")
    asked = [
        (1, " alpha? ", "s1", ["a.pdf"], None), (2, "alpha?", "s2", ["b.pdf"], None), (3, "alpha?", "s1", ["x"], '["b.pdf","c.pdf"]'),
        (4, " ", "s1", [], None), (5, "alpha?", "../x", [], None), (6, "cached", "s1", ["q"], None),
    ]
    questions = spark.createDataFrame(asked, "query_id bigint, query_text string, session_id string, docs array<string>, selected string")
    questions = questions.withColumn("vec", F.array(F.lit(1.0), F.lit(0.0)))
    cache = spark.createDataFrame([("cached||q", "known", 0.5, [], 1)], CACHE)
    for hybrid in (True, False):
        got = steps.ask(questions, chunks, cache, 86400.0, hybrid=hybrid)
        assert {r.query_id for r in got.invalid.collect()} == {4, 5}
        assert [(r.query_id, r.answer) for r in got.hits.collect()] == [(6, "known")]
        seen = {}
        for r in got.context.collect():
            seen.setdefault(r.query_id, set()).add(r.chunk_key)
        assert set(seen) == {1, 2, 3}
        assert "s1-a" in seen[1] and all(k.startswith("s1") for k in seen[1])
        assert all(k.startswith("s2") for k in seen[2])
        assert seen[3] == {"s1-b", "s1-c"}
        prompts = {r.query_id: r.prompt for r in got.prompts.collect()}
        assert set(prompts) == {1, 2, 3} and "alpha?" in prompts[1] and "[1] a.pdf:1" in prompts[1]


def test_ask_reads_chunks_for_scopes_that_are_there(spark):
    """Twice for whole sessions or for named documents: once for terms and vectors, once for the picks. Both kinds take one more each."""
    rows = [("s", f"k{i}", f"{i}.pdf", 1, 0, "alpha beta", [1.0, float(i)], 1.0) for i in range(20)]
    names = "session_id string, chunk_key string, doc_name string, page bigint, chunk_id bigint, text string, vec array<double>, upload_timestamp double"
    plain = spark.createDataFrame(rows, names)
    cache = spark.createDataFrame([], CACHE)
    for selected, reads in (([None], 2), (['["1.pdf","2.pdf"]'], 2), ([None, "3.pdf"], 4)):
        seen = spark.sparkContext.accumulator(0)

        def read(batches, seen=seen):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        asked = [(i, "alpha?", "s", ["x"], chosen, [1.0, 0.0]) for i, chosen in enumerate(selected)]
        questions = spark.createDataFrame(asked, "query_id bigint, query_text string, session_id string, docs array<string>, selected string, vec array<double>")
        got = steps.ask(questions, plain.mapInArrow(read, plain.schema), cache, 86400.0).context
        assert {r.query_id for r in got.collect()} == set(range(len(selected)))
        assert seen.value <= reads * len(rows)


def test_evaluate_counts_missing_answers(spark):
    cases = spark.createDataFrame([("q1", ["Tải", "x"]), ("q2", ["zzz"]), ("q3", ["y"])], "q string, expected array<string>")
    answers = spark.createDataFrame([("q1", "bấm TẢI về", 0.9, 10.0), ("q2", "no", 0.1, 30.0)], "q string, answer string, confidence double, latency_ms double")
    report, results = steps.evaluate(cases, answers)
    row = report.first()
    assert (row.total, row.passed, row.avg_latency_ms, row.verdict) == (3, 1, 20.0, "FAIL")
    assert {r.q: r.status for r in results.collect()} == {"q1": "PASS", "q2": "FAIL", "q3": "ERROR"}
