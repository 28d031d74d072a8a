"""Cleaning, chunking, fingerprints and versions against plain Python."""

import hashlib
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trawl.functions import fixed_values as fv
from trawl.functions.text import split_lines
from trawl.operators import chunks, pages as pg, prefix, versions as v


def test_running_totals_cross_ranges(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aab"), i, rng.randint(0, 9)) for i in rng.sample(range(1000), 300)]
    df = spark.createDataFrame(rows, "k string, o bigint, x bigint")
    sums = {(r.k, r.o): r.s for r in prefix.sum_before(df, ["k"], "o", F.col("x"), "s", 6).collect()}
    mins = {(r.k, r.o): r.s for r in prefix.min_before(df, ["k"], "o", F.col("x"), "s", 6).collect()}
    for k, o, _ in rows:
        before = [x for kk, oo, x in rows if kk == k and oo < o]
        assert sums[k, o] == sum(before)
        assert mins[k, o] == (min(before) if before else None)


def test_sparse_orders_give_few_ranges(spark):
    df = spark.range(20_000).select(F.lit("k").alias("k"), (F.col("id") * 1_000_003).alias("o"))
    cut = prefix.ranged(df, ["k"], "o", 5).groupBy("_range").count().collect()
    assert 2 <= len(cut) <= 5 and max(r["count"] for r in cut) < 10_000
    got = prefix.count_before(df, ["k"], "o", "n", 5)
    assert got.filter("n <> o / 1000003").count() == 0 and got.count() == 20_000


def test_one_line_page_loses_its_line_once(spark):
    rows = [("d", i, "Head\nbody %d\nFoot" % i) for i in range(1, 4)] + [("d", 4, "Head"), ("d", 5, " \n"), ("e", 1, "Head\nx")]
    got = {(r.doc_name, r.page): r.text for r in pg.clean_pages(spark.createDataFrame(rows, "doc_name string, page int, text string")).collect()}
    assert got == {("d", 1): "body 1", ("d", 2): "body 2", ("d", 3): "body 3", ("d", 4): "", ("d", 5): "", ("e", 1): "Head x"}


def test_document_text_segments_join_to_whole(spark):
    rows = [("d", i, f"t{i}") for i in range(1, 12)]
    df = spark.createDataFrame(rows, "doc_name string, page int, text string")
    segments = sorted((r.segment, r.text) for r in pg.document_text(df, 4).collect())
    assert len(segments) == 3
    assert " ".join(t for _, t in segments) == " ".join(t for _, _, t in rows)


def spans_by_hand(tokens, size, overlap):
    n, start, out = len(tokens), 0, []
    if n <= size:
        return [(0, n)] if n else []
    while True:
        end = min(start + size, n)
        if end < n:
            limit = min(end + 50, n)
            for mark in fv.BREAK_MARKERS:
                at = next((i for i in range(start, limit) if mark in tokens[i]), None)
                if at is not None and start + 0.7 * size < at + 1 < limit:
                    end = at + 1
                    break
        out.append((start, end))
        if end == n:
            return out
        start = max(0, end - overlap)


def test_semantic_spans(spark):
    rng = random.Random(7)
    texts = []
    for _ in range(40):
        n = rng.choice([0, 5, 30, 31, 200, 700])
        texts.append("".join(rng.choice(["ab", "c.", "d!", "e?", "f"]) + rng.choices([" ", "\n", "\n\n", "  "], [20, 1, 1, 2])[0] for _ in range(n)))
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for size, overlap in ((30, 5), (30, 0), (100, 60)):
        got = {}
        for r in chunks.split_pages(df, size, overlap).orderBy("id", "pos").collect():
            got.setdefault(r.id, []).append((r.start, r.end, r.text))
        for i, t in enumerate(texts):
            import re

            tokens = re.findall(r"\S+\s*", t)
            want = [(s, e, "".join(tokens[s:e])) for s, e in spans_by_hand(tokens, size, overlap)]
            assert got.get(i, []) == want


def test_chunks_cover_the_page_and_take_own_tokens(spark):
    text = " ".join(f"w{i}." for i in range(500))
    df = spark.createDataFrame([("d", 1, text), ("d", 2, ""), ("d", 3, text)], "doc_name string, page int, text string")
    rows = chunks.chunk_pages(df, 60, 10).orderBy("chunk_id").collect()
    assert [r.chunk_id for r in rows] == list(range(len(rows)))
    assert {r.page for r in rows} == {1, 3}
    own = df.withColumn("toks", F.split("text", ""))
    assert chunks.split_pages(own, 100, 10, tokens="toks").filter("page = 1").agg(F.max("end")).first()[0] == len(text)
    with pytest.raises(ValueError):
        chunks.split_pages(df, 10, 7)


def test_breaks_are_found_across_token_limits(spark):
    rng = random.Random(11)
    rows, want = [], {}
    for i in range(30):
        tokens = []
        for _ in range(rng.choice([20, 90, 300])):
            tokens += rng.choice([["ab"], [" cd"], [".", " e"], ["!", " "], ["?"], ["\n", "\n"], ["f.", " g"]])
        rows.append((i, "".join(tokens), tokens))
        n, start, spans = len(tokens), 0, []
        while n:
            end = min(start + 30, n)
            if n > 30 and end < n:
                limit = min(end + 50, n)
                segment = "".join(tokens[start:limit])
                for mark in fv.BREAK_MARKERS:
                    at = segment.find(mark)
                    if at >= 0:
                        count, length = 0, 0
                        while length < at + len(mark):
                            length += len(tokens[start + count])
                            count += 1
                        if start + 0.7 * 30 < start + count < limit:
                            end = start + count
                            break
            spans.append((start, end))
            if end == n:
                break
            start = max(0, end - 5)
        want[i] = spans
    df = spark.createDataFrame(rows, "id int, text string, toks array<string>")
    got = {}
    for r in chunks.split_pages(df, 30, 5, tokens="toks").orderBy("id", "pos").collect():
        got.setdefault(r.id, []).append((r.start, r.end))
    assert got == {i: s for i, s in want.items() if s}
    plain = ["w"] * 25 + ["."] + [" w"] * 35
    assert chunks.break_spans(plain, 30, 5)[0] == (0, 27)
    assert chunks.break_spans(["word "] * 1_000_000, 380, 50)[-1][1] == 1_000_000


def simhash_by_hand(text):
    words = text.lower().split()
    votes = [0] * 128
    for w in words:
        h = int(hashlib.md5(w.encode()).hexdigest(), 16)
        for i in range(128):
            votes[i] += 1 if h >> i & 1 else -1
    return format(sum(1 << i for i in range(128) if votes[i] > 0), "032x")


def test_simhash_matches_definition(spark):
    texts = ["", "  \n", "one", "A b c a B", "x y z " * 50, "tiếng Việt"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    hexed = v.simhash_hex(F.col("hi"), F.col("lo")).alias("h")
    for got in (v.simhash128(df, ["id"]), v.simhash128_rows(df)):
        assert {r.id: r.h for r in got.select("id", hexed).collect()} == {i: simhash_by_hand(t) for i, t in enumerate(texts)}
    back = v.simhash128_rows(df).withColumn("again", v.simhash_halves(v.simhash_hex(F.col("hi"), F.col("lo"))))
    assert back.filter("again.hi = hi AND again.lo = lo").count() == len(texts)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def near_hashes(n, seed):
    """Clusters of hashes a few bits apart, with copies, around few centres."""
    rng = random.Random(seed)
    centres = [rng.getrandbits(128) for _ in range(4)]
    out = []
    for _ in range(n):
        h = rng.choice(centres)
        for b in rng.sample(range(128), rng.choice([0, 1, 4, 5, 6, 9])):
            h ^= 1 << b
        out.append(h)
    return out


@pytest.mark.parametrize("hot", [4096, 3])
def test_near_hash_pairs_are_exact(spark, hot):
    """A low crowding limit sends nearly every hash through the finer keys."""
    hashes = sorted(set(near_hashes(120, 3)))
    df = spark.createDataFrame([(signed(h >> 64), signed(h & (1 << 64) - 1)) for h in hashes], "hi bigint, lo bigint")
    got = {frozenset([(r.hi_a, r.lo_a), (r.hi_b, r.lo_b)]): r.distance for r in v.near_hash_pairs(df, hot=hot).collect()}
    want = {}
    for i, a in enumerate(hashes):
        for b in hashes[:i]:
            d = (a ^ b).bit_count()
            if d <= 10:
                want[frozenset([(signed(x >> 64), signed(x & (1 << 64) - 1)) for x in (a, b)])] = d
    assert len(want) > 100 and got == want


def register_by_hand(uploads):
    """One upload after the other, as a loop over a growing registry."""
    registry, order, out = {}, [], {}
    for reg, name, file_hash, h in uploads:
        stem = name.rsplit(".", 1)[0]
        if any(e["file"] == file_hash for e in registry.get(stem, [])):
            out[reg] = ("duplicate", None)
            continue
        best, best_d = None, 999
        for s in order:
            for e in registry[s]:
                d = (e["h"] ^ h).bit_count()
                if d < best_d:
                    best, best_d = e, d
        sim = 1 - best_d / 128 if best_d <= 10 else 0
        entry = {"reg": reg, "name": name, "file": file_hash, "h": h, "status": "active", "by": None, "version": len(registry.get(stem, [])) + 1}
        result = "new"
        if sim > 0.95:
            result = "version" if best["name"].rsplit(".", 1)[0] == stem else "duplicate"
        elif sim > 0.80:
            result = "updated"
        if result in ("version", "updated"):
            best["status"], best["by"] = "superseded", stem
        if stem not in registry:
            order.append(stem)
        registry.setdefault(stem, []).append(entry)
        out[reg] = (result, best["reg"] if sim else None)
    return out, {e["reg"]: (e["status"], e["by"], e["version"]) for s in registry.values() for e in s}


@pytest.mark.parametrize("seed", [1, 2])
def test_registration_equals_the_loop(spark, seed):
    rng = random.Random(seed)
    uploads = []
    for reg, h in enumerate(near_hashes(150, seed)):
        if uploads and rng.random() < 0.15:
            _, name, file_hash, h = rng.choice(uploads)
        else:
            name, file_hash = f"f{rng.randint(0, 12)}.pdf", str(rng.getrandbits(64))
        uploads.append((reg, name, file_hash, h))
    df = spark.createDataFrame(
        [(r, n, f, signed(h >> 64), signed(h & (1 << 64) - 1)) for r, n, f, h in uploads],
        "reg bigint, filename string, file_hash string, hi bigint, lo bigint",
    )
    registry = v.register(df)
    results, states = register_by_hand(uploads)
    rows = registry.collect()
    assert {r.reg: (r.status, r.superseded_by, r.version) for r in rows} == states
    assert {r.reg: r.matched_reg for r in rows} == {r: m for r, (_, m) in results.items() if r in states}
    assert {r.reg: r.result for r in v.upload_results(df, registry).collect()} == {r: s for r, (s, _) in results.items()}


def test_sessions_do_not_match_each_other(spark):
    rows = [("a", 1, "x.pdf", "1", 5, 5), ("b", 2, "x.pdf", "1", 5, 5)]
    df = spark.createDataFrame(rows, "session_id string, reg bigint, filename string, file_hash string, hi bigint, lo bigint")
    assert {r.result for r in v.register(df).collect()} == {"new"}


def test_content_hash_does_not_depend_on_the_number_of_pages(spark):
    import hashlib

    words = [f"w{i}" for i in range(5000)]
    rows = [("one", 1, " ".join(words))] + [("many", i + 1, w) for i, w in enumerate(words)] + [("none", 1, None), ("none", 2, "x")]
    got = {r.doc_name: r for r in pg.document_digests(spark.createDataFrame(rows, "doc_name string, page int, text string").repartition(6)).collect()}
    assert got["one"].content_hash == got["many"].content_hash == hashlib.sha256(" ".join(words).encode()).hexdigest()
    assert got["one"].n_chars == got["many"].n_chars == len(" ".join(words)) and got["none"].content_hash == hashlib.sha256(b" x").hexdigest()


def test_hot_keys_alone_are_cut_into_ranges(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, rng.randint(0, 9)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, o bigint, x bigint")
    for hot in (1, 100, 1000):
        got = {(r.k, r.o): r.s for r in prefix.sum_before(df, ["k"], "o", F.col("x"), "s", hot_rows=hot).collect()}
        assert got == {(k, o): sum(x for kk, oo, x in rows if kk == k and oo < o) for k, o, _ in rows}


def test_chunk_texts_are_the_page_cut_by_bytes(spark):
    rng = random.Random(3)
    bits = ["é", "a.", "日本 語", "b! ", "\n\n", "x\n", " ", "\x1c", "ü?", " "]
    texts = [None, "", "  \n", "  eins zwei", *("".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randrange(200))) for _ in range(30))]
    pages = spark.createDataFrame([("s", "d", i, t, [f"{j}é " for j in range(i)]) for i, t in enumerate(texts)], "session_id string, doc_name string, page int, text string, own array<string>")
    for semantic in (True, False):
        cut = chunks.break_spans if semantic else lambda t, s, o: chunks.fixed_spans(len(t), s, o)
        words = [chunks._WORDS.findall(t or "") for t in texts]
        got = {(r.page, r.pos): (r.start, r.end, r.text) for r in chunks.split_pages(pages, 10, 3, semantic).collect()}
        assert got == {(i, p): (s, e, "".join(w[s:e])) for i, w in enumerate(words) for p, (s, e) in enumerate(cut(w, 10, 3))}
        own = {(r.page, r.pos): r.text for r in chunks.split_pages(pages, 10, 3, semantic, tokens="own").collect()}
        assert own == {(i, p): "".join(f"{j}é " for j in range(s, e)) for i in range(len(texts)) for p, (s, e) in enumerate(cut([f"{j}é " for j in range(i)], 10, 3))}
    numbered = sorted((r.page, r.chunk_id) for r in chunks.chunk_pages(pages, 10, 3).collect())
    assert [c for _, c in numbered] == list(range(len(numbered)))


def test_the_function_of_spans_runs_once(spark):
    plan = chunks.split_pages(spark.createDataFrame([("d", 1, "x")], "doc_name string, page int, text string"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_a_very_long_page_takes_linear_time(spark):
    page = spark.range(1).select(F.lit("d").alias("doc_name"), F.lit(1).alias("page"), F.repeat(F.lit("word é. "), 1_500_000).alias("text"))
    start = time.perf_counter()
    got = chunks.split_pages(page, 380, 50).agg(F.count("*").alias("n"), F.max("end").alias("end")).first()
    assert got.end == 3_000_000 and got.n > 8000 and time.perf_counter() - start < 40


def test_words_are_hashed_once_a_task_and_counted_without_carry():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)] + ["é" * 70]  # the long one is not kept
    texts = [None, "", "x " * 70_000, *(" ".join(rng.choice(words) for _ in range(n)) for n in (1, 254, 255, 256, 20_000))]
    known = v._Digests()
    lengths, ones = v._ones(pa.array(texts), known)
    for text, n, sums in zip(texts, lengths, ones):
        said = (text or "").split()
        digests = np.frombuffer(b"".join(hashlib.md5(w.encode()).digest() for w in said), dtype=np.uint8).reshape(-1, 16)
        assert n == len(said) and (sums == np.unpackbits(digests, axis=1).sum(axis=0)).all()
    assert set(known) == {"x", *words[:-1]}


def test_kept_digests_are_bounded():
    known = v._Digests()
    known.most = 10
    assert all(known[f"w{i % 25}"] == hashlib.md5(f"w{i % 25}".encode()).digest() and len(known) <= 10 for i in range(100))


def test_cleaning_in_one_pass_equals_its_steps(spark):
    rng = random.Random(6)
    bits = ["a", "é ", "\x85", "\x1c", "\x1f", "\u2028", "\u00a0", "\r\n", "\n", "\x0b", "\t", "  ", "\u3000", "\u200b"]
    texts = [None, "", " \n ", *("".join(rng.choice(bits) for _ in range(rng.randrange(25))) for _ in range(150))]
    pages = spark.createDataFrame([("s", f"d{i % 2}", i, t) for i, t in enumerate(texts)], "session_id string, doc_name string, page int, text string")
    steps = pg.strip_repeated(pages).withColumn("text", pg.rebuild_page(F.col("lines"))).drop("lines")
    assert sorted(map(tuple, pg.clean_pages(pages).select(steps.columns).collect())) == sorted(map(tuple, steps.collect()))
    lines = split_lines(F.col("text"))
    key = lambda at: F.when(F.size("lines") > 0, pg.line_key(F.get("lines", at)))
    want = pages.withColumn("lines", lines).select("page", F.size("lines"), key(F.lit(0)), key(F.size("lines") - 1))
    assert sorted(map(str, pg.page_edges(pages).select("page", "n_lines", "head", "tail").collect())) == sorted(
        map(str, want.toDF("page", "n_lines", "head", "tail").collect())
    )


def test_token_starts_in_bytes_are_those_of_the_words():
    rng = random.Random(7)
    bits = ["é", "a.", "日本 語", "b! ", "\n\n", "x\n", " ", "\x1c", "\u00a0", "\t\x0b"]
    for text in ["", "  ", " a", "a ", *("".join(rng.choice(bits) for _ in range(rng.randrange(60))) for _ in range(200))]:
        words = chunks._WORDS.findall(text)
        first = len(text) - sum(map(len, words))
        want = np.cumsum([len(text[:first].encode()), *(len(w.encode()) for w in words)])
        assert chunks._token_offsets(text.encode()).tolist() == want.tolist()


def test_registration_compares_hashes_once(spark):
    rng = random.Random(9)
    rows = [(i, f"f{i % 5}.pdf", f"h{i}", signed(hi >> 64), signed(hi & (1 << 64) - 1)) for i, hi in enumerate(rng.getrandbits(128) for _ in range(20))]
    registry = v.register(spark.createDataFrame(rows, "reg bigint, filename string, file_hash string, hi bigint, lo bigint"))
    assert registry.count() == 20
    assert "MapInArrow" not in registry._jdf.queryExecution().executedPlan().toString()
