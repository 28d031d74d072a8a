"""Files, tables, caches, chats and rate limits."""

import json
import os
import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from trawl.operators import answers as an, chats as ch, citations as ct, embedding as em, ops, passages as ps
from trawl.sources import files as fi, tables as tb
from trawl.streaming import streams


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="trawl-test-")


def test_validate_files(spark):
    big = b"%PDF" + b"x" * (1024 * 1024)
    rows = [
        ("ok.pdf", "", b"%PDF-1"), ("late.pdf", "", b" " * 4000 + b"%PDF"), ("later.pdf", "", b" " * 4094 + b"%PDF"), ("x.txt", "text/plain", b"%PDF"),
        ("x.bin", "application/pdf", b"%PDF"), ("big.pdf", "", big), ("empty.pdf", "", b""),
    ]
    df = spark.createDataFrame([(1, *r) for r in rows], "batch_id int, filename string, content_type string, content binary")
    got = {r.filename: r.error for r in fi.validate_files(df, max_mb=1, max_files=7).collect()}
    assert {n for n, e in got.items() if e is None} == {"ok.pdf", "late.pdf", "x.bin", "empty.pdf"}
    assert "1 MB" in got["big.pdf"] and "%PDF" in got["later.pdf"]
    assert fi.accepted(fi.validate_files(df, max_files=5)).count() == 0
    assert fi.rejected(fi.validate_files(df, max_files=7)).count() == 2


def test_heads_read_no_more_than_the_start(spark, folder):
    os.makedirs(f"{folder}/s1/x y")
    for name, size in (("a.pdf", 10), ("b c%20.PDF", 9_000), ("empty.pdf", 0), ("big.pdf", 3_000_000)):
        with open(f"{folder}/s1/x y/{name}", "wb") as file:
            file.write((b"%PDF-1.4" + b"x" * size)[:size])
    found = fi.scan_heads(spark, folder, where=F.col("size") < 2_000_000, partitions=3)
    assert found.rdd.getNumPartitions() == 3
    got = {r.filename: (r.session_id, r.size, bytes(r.head)) for r in found.collect()}
    whole = (b"%PDF-1.4" + b"x" * 9_000)[:4096]
    assert got == {"a.pdf": ("x y", 10, b"%PDF-1.4xx"), "b c%20.PDF": ("x y", 9_000, whole)}
    ups = fi.scan_heads(spark, folder).withColumns({"batch_id": F.lit(1), "content_type": F.lit(None).cast("string")})
    errors = {r.filename: r.error for r in fi.validate_files(ups, max_mb=2).collect()}
    assert [k for k, v in errors.items() if v] == ["big.pdf"]


def test_scan_files_ignores_case(spark, folder):
    import os

    os.mkdir(f"{folder}/s1")
    for name in ("a.pdf", "b.PDF", "c.txt"):
        with open(f"{folder}/s1/{name}", "wb") as f:
            f.write(b"%PDF")
    assert sorted((r.session_id, r.filename, r.size) for r in fi.scan_files(spark, folder).collect()) == [("s1", "a.pdf", 4), ("s1", "b.PDF", 4)]


def test_append_vectors_checks_length(spark, folder):
    rows = lambda n, dim: spark.createDataFrame([("s", i, [0.5] * dim) for i in range(n)], "session_id string, id int, vec array<float>")
    path = f"{folder}/vectors"
    tb.append_vectors(spark, path, rows(2, 3))
    tb.append_vectors(spark, path, rows(1, 3))
    assert spark.read.parquet(path).count() == 3
    with pytest.raises(ValueError, match="differs"):
        tb.append_vectors(spark, path, rows(1, 4))
    with pytest.raises(ValueError, match="different lengths"):
        tb.append_vectors(spark, f"{folder}/other", rows(1, 3).union(rows(1, 4)))


def test_replace_sessions_leaves_others(spark, folder):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "session_id string, doc_name string")
    df.write.partitionBy("session_id").parquet(f"{folder}/t")
    rest = tb.remove_doc(spark.read.parquet(f"{folder}/t"), "x", "a").filter("session_id = 'a'")
    tb.replace_sessions(spark.createDataFrame(rest.collect(), rest.schema), f"{folder}/t")
    assert sorted(map(tuple, spark.read.parquet(f"{folder}/t").select("session_id", "doc_name").collect())) == [("a", "y"), ("b", "x")]


def test_reads_indented_fingerprints_and_manifests(spark, folder):
    fp = {"filename": "a.pdf", "file_hash": "f", "content_hash": "c", "semantic_hash": "0" * 32, "upload_timestamp": 1.5, "page_count": 2,
          "chunk_count": 3, "chunk_ids": [], "status": "active", "version": 1, "supersedes": ["b.pdf"], "superseded_by": None}
    with open(f"{folder}/f.json", "w") as f:
        json.dump({"a": [fp, {**fp, "version": 2}]}, f, indent=2)
    got = fi.read_fingerprints(spark, f"{folder}/f.json", whole_files=True).orderBy("version").collect()
    assert [(r.doc_id, r.version, r.supersedes) for r in got] == [("a", 1, ["b.pdf"]), ("a", 2, ["b.pdf"])]
    with open(f"{folder}/m.json", "w") as f:
        json.dump({"session_id": "s", "docs": [{"doc": "a.pdf", "chunks": 2}], "total_chunks": 2, "ts": 5}, f, indent=2)
    assert fi.read_manifest(spark, f"{folder}/m.json", multi_line=True).first().doc == "a.pdf"


def test_embedding_calls_the_model_once_per_text(spark, folder):
    log = f"{folder}/calls"

    def embed(batch):
        with open(log, "a") as f:
            f.writelines(f"{t}\n" for t in batch)
        return [[3.0, 4.0] for _ in batch]

    texts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "hit")], "id int, text string")
    cache = em.with_key(texts.filter("id = 4")).select("k", F.lit(2).alias("dim"), F.array(F.lit(0.0), F.lit(2.0)).cast("array<float>").alias("vec"))
    out, grown = em.embed_column(texts, cache, embed, batch=1)
    vectors = {r.id: r.vec for r in out.collect()}
    assert vectors[1] == pytest.approx([0.6, 0.8]) and vectors[3] == vectors[1] and vectors[4] == pytest.approx([0, 1])
    assert grown.count() == 3 and grown.filter("vec[0] = 3.0").count() == 2
    with open(log) as f:
        assert sorted(f.read().split()) == ["a", "b"]


def test_citation_edges(spark):
    cases = {
        1: ("[a.pdf: 3-5, 9]", {("a.pdf", "3"), ("a.pdf", "4"), ("a.pdf", "5"), ("a.pdf", "9")}),
        2: ("[a.pdf:9–4][b.PDF:1]", {("a.pdf", "9"), ("a.pdf", "4")}),
        3: ("[ a.pdf : , ]", {("a.pdf", None)}),
        4: ("[a.pdf:iv] [a.pdf:iv]", {("a.pdf", "iv")}),
        5: ("[a.pdf:007 - 8]", {("a.pdf", "7"), ("a.pdf", "8")}),
        6: ("none [a.pdf]", set()),
    }
    df = spark.createDataFrame([(k, a) for k, (a, _) in cases.items()], "query_id int, answer string")
    got = {k: set() for k in cases}
    for r in ct.extract_citations(df).collect():
        got[r.query_id].add((r.doc_name, r.page))
    assert got == {k: w for k, (_, w) in cases.items()}
    long = df.select("query_id", F.lit("[a.pdf:5-25004]").alias("answer")).limit(1)
    assert ct.extract_citations(long).agg(F.count("*"), F.min(F.col("page").cast("int")), F.max(F.col("page").cast("int"))).first()[:] == (25000, 5, 25004)
    ends = {(r.doc_name, r.page) for r in ct.extract_citations(df.filter("query_id = 1"), ends_only=True).collect()}
    assert ends == {("a.pdf", "3"), ("a.pdf", "5"), ("a.pdf", "9")}


def test_confidence_without_scores(spark):
    rows = [(1, None, None), (2, None, 60.0), (3, 0.9, None), (3, 0.2, None)]
    df = spark.createDataFrame(rows, "query_id int, relevance double, score double")
    got = {r.query_id: r.confidence for r in ps.answer_confidence(df).collect()}
    assert got == pytest.approx({1: 0.0, 2: 0.99, 3: 0.92})


def test_auto_title_only_once(spark):
    chat = "session_id string, chat_id string, title string, created_at bigint, updated_at bigint"
    chats = spark.createDataFrame([("s", c, t, 1, 1) for c, t in (("a", "Cuộc trò chuyện 12"), ("b", "Cuộc trò chuyện x"), ("c", "cuộc trò chuyện"), ("d", None))], chat)
    log = spark.createDataFrame([("s", "c", 0)], "session_id string, chat_id string, turn bigint")
    ex = spark.createDataFrame([("s", c, i, " q%d " % i + "z" * 80, 9) for c in "abcd" for i in (1, 2)], "session_id string, chat_id string, seq bigint, question string, timestamp bigint")
    got = {r.chat_id: r.title for r in ch.auto_title(chats, log, ex).collect()}
    assert got["a"] == ("q1 " + "z" * 80)[:60] and got["b"] == "Cuộc trò chuyện x" and got["c"] == "cuộc trò chuyện" and got["d"] is None


def test_answer_cache_latest_wins(spark):
    cache = spark.createDataFrame([("k", "old", 5)], "k string, answer string, ts bigint")
    new = spark.createDataFrame([("k", "b", 2), ("k", "c", 3), ("l", "d", 1)], "k string, answer string, ts bigint")
    assert {r.k: r.answer for r in an.cache_put(cache, new).collect()} == {"k": "c", "l": "d"}


def admit_by_hand(rows, limits):
    kept, out = {}, {}
    for rid, client, endpoint, ts in sorted(rows, key=lambda r: (r[3], r[0])):
        if endpoint not in limits:
            out[rid] = True
            continue
        most, span = limits[endpoint]
        live = [t for t in kept.get((client, endpoint), []) if ts - t < span]
        out[rid] = len(live) < most
        kept[client, endpoint] = live + [ts] * out[rid]
    return out


def requests(seed):
    rng = random.Random(seed)
    rows, ts = [], 0.0
    for i in range(600):
        ts += rng.choice([0, 0.5, 3, 40]) if rng.random() < 0.99 else 500
        rows.append((i, rng.choice("xxxy"), rng.choice(["/a", "/b", "/free"]), ts))
    return rows


LIMITS = {"/a": (3, 10.0), "/b": (1, 60.0)}


def test_rate_limit_equals_the_loop(spark):
    rows = requests(4)
    df = spark.createDataFrame(rows, "request_id bigint, client string, endpoint string, ts double")
    got = {r.request_id: r.allowed for r in ops.rate_limit(df, LIMITS).collect()}
    assert got == admit_by_hand(rows, LIMITS) and 0 < sum(got.values()) < len(rows)


def test_rate_limit_stream_over_several_batches(spark, folder):
    rows = requests(5)
    schema = "request_id bigint, client string, endpoint string, ts double"
    df = spark.createDataFrame(rows, schema)
    for part, (low, high) in enumerate(((0, 200), (200, 400), (400, 600))):
        df.filter(f"request_id >= {low} AND request_id < {high}").coalesce(1).write.parquet(f"{folder}/in/p{part}")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in/p*")
        streams.rate_limit_stream(stream, LIMITS).writeStream.format("parquet").option("path", f"{folder}/out").option(
            "checkpointLocation", f"{folder}/cp"
        ).trigger(availableNow=True).start().awaitTermination()
    got = {r.request_id: r.allowed for r in spark.read.parquet(f"{folder}/out").collect()}
    assert got == admit_by_hand(rows, LIMITS)


def test_rate_limit_stream_judges_late_requests(spark, folder):
    schema = "request_id bigint, client string, endpoint string, ts double"
    limits = {"ask": (2, 10.0)}
    parts = [[(1, "a", "ask", 100.0), (2, "a", "ask", 104.0)], [(3, "a", "ask", 20.0), (4, "b", "ask", 5.0)], [(5, "a", "ask", 110.0), (6, "a", "ask", 50.0), (7, "a", "free", 1.0)]]
    for part, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/late/p{part}")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/late/p*")
        streams.rate_limit_stream(stream, limits).writeStream.format("parquet").option("path", f"{folder}/lateout").option(
            "checkpointLocation", f"{folder}/latecp"
        ).trigger(availableNow=True).start().awaitTermination()
    got = {r.request_id: r.allowed for r in spark.read.parquet(f"{folder}/lateout").collect()}
    assert got == {1: True, 2: True, 3: False, 4: True, 6: False, 5: True, 7: True}


def test_rate_limit_stream_forgets_clients_after_their_window(spark, folder):
    schema = "request_id bigint, client string, endpoint string, ts double"
    limits = {"ask": (2, 10.0), "log": (1, 1000.0)}
    parts = [
        [(1, "a", "ask", 100.0), (2, "a", "ask", 104.0), (3, "a", "log", 104.0)],
        [(4, "b", "ask", 113.9), (5, "a", "ask", 113.9), (6, "a", "ask", 113.95)],  # a's window is 104 to 114
        [(7, "c", "ask", 140.0)],
        [(8, "a", "ask", 90.0), (9, "a", "ask", 91.0), (10, "a", "ask", 92.0), (11, "a", "log", 1103.0), (12, "c", "ask", 1150.0)],
        [(13, "a", "log", 1104.0), (14, "d", "ask", 5000.0)],
    ]
    left = []
    for part, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/ends/p{part}")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/ends/p*")
        streams.rate_limit_stream(stream, limits, "1 second").writeStream.format("parquet").option("path", f"{folder}/endsout").option(
            "checkpointLocation", f"{folder}/endscp"
        ).trigger(availableNow=True).start().awaitTermination()
        state = spark.read.format("statestore").option("path", f"{folder}/endscp").option("stateVarName", "accepted").load()
        left.append({(r.key.client, r.key.endpoint) for r in state.select("key").collect()})
    got = {r.request_id: r.allowed for r in spark.read.parquet(f"{folder}/endsout").collect()}
    # 8 to 10 come after a's state is gone: judged at the stream's time, 139. 13 is judged at the stream's 1149.
    assert got == {1: True, 2: True, 3: True, 4: True, 5: True, 6: False, 7: True, 8: True, 9: True, 10: False, 11: False, 12: True, 13: True, 14: True}
    assert left[0] == {("a", "ask"), ("a", "log")}
    assert left[1] == {("a", "ask"), ("a", "log"), ("b", "ask")}
    assert left[2] == {("c", "ask"), ("a", "log")}
    assert left[-1] == {("d", "ask")}


def test_admission_equals_the_loop():
    rng = random.Random(12)
    for _ in range(200):
        most, span = rng.choice([0, 1, 2, 5]), rng.choice([1.0, 0.3, 7.5])
        times = sorted(round(rng.random() * 30, 1) for _ in range(rng.randint(0, 60)))
        want, kept = [], []
        for t in times:
            kept = [k for k in kept if t - k < span]
            want.append(len(kept) < most)
            if want[-1]:
                kept.append(t)
        cut = rng.randint(0, len(times))
        first, state = ops.admitted(np.array(times[:cut]), most, span, [])
        second, _ = ops.admitted(np.array(times[cut:]), most, span, state)
        assert [*first, *second] == want


def test_metrics_of_nothing(spark):
    df = spark.createDataFrame([], "endpoint string, response_ms double, success boolean")
    assert tuple(ops.request_metrics(df).first()) == (0, 0, 0.0, 0.0, 0.0, 0.0)


def test_ingest_stream_skips_known_documents(spark, folder):
    schema = "session_id string, doc_name string, page bigint, text string"
    for part, docs in enumerate((["a", "b"], ["b", "c"])):
        rows = [("s", f"{d}.pdf", p, f"{d} page {p} " * 30) for d in docs for p in (1, 2)]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/p{part}")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in/p*")
        streams.ingest_stream(stream, f"{folder}/chunks", f"{folder}/manifest", f"{folder}/cp", size=40, overlap=5).awaitTermination()
    got = spark.read.parquet(f"{folder}/chunks").groupBy("doc_name").agg(F.countDistinct("batch").alias("n")).collect()
    assert {r.doc_name: r.n for r in got} == {"a.pdf": 1, "b.pdf": 1, "c.pdf": 1}
    skipped = spark.read.parquet(f"{folder}/manifest_skipped").collect()
    assert sorted((r.doc_name, r.page) for r in skipped) == [("b.pdf", 1), ("b.pdf", 2)]


def test_ingest_stream_goes_on_with_late_pages(spark, folder):
    schema = "session_id string, doc_name string, page bigint, text string"
    for part, pages in enumerate(((1, 2), (2, 3))):
        rows = [("s", "a.pdf", p, f"line {p} " * 60) for p in pages]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/two/p{part}")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/two/p*")
        streams.ingest_stream(stream, f"{folder}/twochunks", f"{folder}/twomanifest", f"{folder}/twocp", size=40, overlap=5).awaitTermination()
    chunks = spark.read.parquet(f"{folder}/twochunks").collect()
    assert {r.page for r in chunks} == {1, 2, 3}
    assert sorted(r.chunk_id for r in chunks) == list(range(len(chunks)))


def test_endless_page_ranges_stay_ranges(spark):
    answers = spark.createDataFrame([(1, "see [a.pdf:1-99999999999] and [b.pdf: 9-4, 7]")], "query_id int, answer string")
    passages = spark.createDataFrame([(1, "a.pdf", 12), (1, "a.pdf", 0), (1, "b.pdf", 4), (1, "b.pdf", 5), (1, "b.pdf", 7), (2, "a.pdf", 12)], "query_id int, doc_name string, page int")
    ranges = ct.cited_ranges(answers)
    assert ranges.count() == 4
    got = {(r.doc_name, r.page) for r in ct.match_sources(passages, ranges).collect()}
    assert got == {("a.pdf", 12), ("b.pdf", 4), ("b.pdf", 7)}


def test_questions_without_a_chat_get_one(spark):
    from trawl.plans import steps

    chats = spark.createDataFrame([("s", "old", "A", 1, 1), ("s", "new", "B", 2, 9)], "session_id string, chat_id string, title string, created_at bigint, updated_at bigint")
    asked = [(1, "s", None, 1, 50), (2, "s", "old", 2, 50), (3, "s", "gone", 3, 50), (4, "s", "gone", 4, 50), (5, "t", None, 5, 50), (6, "t", " ", 6, 50)]
    questions, after = steps.settle_chats(spark.createDataFrame(asked, "query_id bigint, session_id string, chat_id string, seq bigint, ts bigint"), chats)
    assert {r.query_id: r.chat_id for r in questions.collect()} == {1: "new", 2: "old", 3: "chat-3", 4: "chat-3", 5: "chat-5", 6: "chat-5"}
    assert {r.chat_id for r in after.collect()} == {"old", "new", "chat-3", "chat-5"}


def changed_at_once(chats, changes):
    """The documented meaning of one batch, row by row."""
    default = "Cuộc trò chuyện"
    number = lambda t: int(t.rsplit(" ", 1)[1]) if t.startswith(default) and t.rsplit(" ", 1)[1].isdigit() else 1 if t.strip() == default else None
    after = {(c[0], c[1]): list(c) for c in chats}
    newest = {}
    for c in sorted(chats, key=lambda c: (-c[4], c[1])):
        newest.setdefault(c[0], c[1])
    held = {s: sum(c[0] == s for c in chats) for s in {x[1] for x in changes}}
    top = max([number(c[2]) or 0 for c in chats], default=0)
    ordered = sorted(changes)
    for seq, session, action, chat, title, at in ordered:
        title = (title or "").strip()
        if action == "create":
            held[session] += 1
            after[session, chat] = [session, chat, title or f"{default} {held[session]}", at, at]
        if action == "create_session":
            top += not title
            after[session, chat] = [session, chat, title or f"{default} {top}", at, at]
    for seq, session, action, chat, title, at in ordered:
        key = (session, chat or newest.get(session))
        if action == "rename" and key in after:
            after[key][2], after[key][4] = (title or "").strip() or after[key][2], at
    for _, session, action, chat, *_ in ordered:
        if action == "delete":
            after.pop((session, chat), None)
    return sorted(map(tuple, after.values()))


def test_a_batch_of_chat_changes_is_simultaneous(spark):
    rng = random.Random(21)
    for _ in range(4):
        chats = [(f"s{i % 3}", f"c{i}", rng.choice(["A", "Cuộc trò chuyện", "Cuộc trò chuyện 4"]), i, rng.randrange(50)) for i in range(8)]
        changes = []
        for seq in range(25):
            action = rng.choice(["create", "create_session", "rename", "rename", "delete"])
            session = f"s{rng.randrange(4)}"
            chat = f"n{seq}" if action.startswith("create") else rng.choice([f"c{rng.randrange(8)}", f"n{rng.randrange(25)}", None if action == "rename" else "none"])
            changes.append((seq, session, action, chat, rng.choice([None, " ", f" T{seq} "]), 100 + seq))
        got = ch.apply_chat_changes(
            spark.createDataFrame(chats, "session_id string, chat_id string, title string, created_at bigint, updated_at bigint"),
            spark.createDataFrame(changes, "seq bigint, session_id string, action string, chat_id string, title string, timestamp bigint"),
        )
        assert sorted(map(tuple, got.collect())) == changed_at_once(chats, changes)
