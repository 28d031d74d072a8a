"""Operators with exact results against brute force, with nulls, empty tables, copies, ties and clashing columns."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

from trawl.llm import fingerprints, mixing, packing, simhash, substrings, token_counts
from trawl.llm.components import components
from trawl.llm.queries import byte_vocabulary, word_vocabulary
from trawl.llm.tokens import WordEncoder

DOCS = "doc_id bigint, text string, source string, lang string, n_chars bigint"
WORDS = "alpha beta Gamma delta x y zz".split()


def text_of(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def sample_docs(seed=5, n=60):
    rng = random.Random(seed)
    rows = [(i, text_of(rng, rng.choice([0, 1, 2, 5, 40, 200])), f"s{i % 4}", "en", 1) for i in range(n)]
    rows += [(n, None, None, None, None), (n + 1, "", "s0", "en", 0), (n + 2, rows[4][1], "s1", "en", 3), rows[7], rows[7]]
    rows += [(None, "alone and without a key", "s2", None, 5), (n + 3, "  \t\n ", "s2", "en", 5), (n + 4, "word " * 30000, "s9", "de", 9)]
    return rows


def find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1060)] + [(2, 2), (None, 4)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    parent = {x: x for link in links for x in link if x is not None}
    for a, b in links:
        if a is not None and b is not None:
            x, y = find(parent, a), find(parent, b)
            parent[max(x, y)] = min(x, y)
    assert got == {x: find(parent, x) for x in parent if any(x in link and len(set(link)) == 2 and None not in link for link in links)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_simhash_bits_and_groups(spark):
    rows = sample_docs()
    base = "one two three four five six seven eight nine ten eleven twelve " * 20
    rows += [(200 + i, base + " ".join(["tail"] * i), "s", "en", 1) for i in range(6)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS fp", "2 AS k", "3 AS component")
    got = sorted(((r.doc_id, r.fingerprint, r.component) for r in simhash.near_duplicate_groups(docs).collect()), key=repr)
    prints = []
    for r in rows:
        words = bytes(c + 32 if 65 <= c <= 90 else c for c in (r[1] or "").encode()).split()
        shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        ones = Counter(b for s in shingles for b in range(64) if xxhash.xxh64_intdigest(s, 42) >> b & 1)
        value = sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))
        prints.append(value)
    parent = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                parent[find(parent, i)] = find(parent, j)
    least = {}
    for i, r in enumerate(rows):
        root = find(parent, i)
        if r[0] is not None:
            least[root] = min(least.get(root, r[0]), r[0])
    signed = [v - (1 << 64) if v >> 63 else v for v in prints]
    assert got == sorted(((r[0], signed[i], least.get(find(parent, i))) for i, r in enumerate(rows)), key=repr)
    assert simhash.near_duplicate_groups(docs.limit(0)).count() == 0


@pytest.mark.parametrize("width", [2, 4, 8])
def test_grid_joins_every_near_pair(spark, width):
    rng = random.Random(width)
    values = [rng.getrandbits(64) for _ in range(150)]
    for v in values[:100]:
        for _ in range(rng.randint(1, 4)):
            v ^= 1 << rng.randrange(64)
        values.append(v)
    signed = sorted({v - (1 << 64) if v >> 63 else v for v in values})
    pairs = simhash.linked_fingerprints(spark.createDataFrame([(v,) for v in signed], "fp bigint"), 2, width)
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    assert {(r.a, r.b) for r in pairs.collect()} == want and pairs.count() == len(want)


def broadcast_explodes(df):
    """Lines of the plan, as it is before anything runs, that explode rows below a broadcast."""
    found, depths = [], []
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = len(line) - len(line.lstrip(" :+-*"))
        depths = [d for d in depths if d < depth]
        if depths and "Generate" in line:
            found.append(line)
        if "BroadcastExchange" in line:
            depths.append(depth)
    return found


def test_exploded_rows_are_not_broadcast(spark, monkeypatch):
    """Spark counts them as the rows before the explode, here far below the limit."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(5000)}" for _ in range(100)]
    rows = [(i, " ".join([*base[: i % 50], f"n{i}", *base[i % 50 :]]), "s", "en", 1) for i in range(60)]
    docs, staged, found = spark.createDataFrame(rows, DOCS), simhash.stage_table, []

    def watched(df):
        found.extend(broadcast_explodes(df))
        return staged(df)

    monkeypatch.setattr(simhash, "stage_table", watched)
    monkeypatch.setattr("trawl.operators.components.stage_table", watched)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64m")
    try:
        fps = staged(spark.range(2000).selectExpr("xxhash64(id) AS fp"))
        found += broadcast_explodes(simhash.linked_fingerprints(fps, 2))
        assert simhash.near_duplicate_groups(docs).count() == 60
        assert simhash.one_of_each_group(docs).count() == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert found == []


def test_similar_texts_keep_one_of_each_group(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    rows = [(0, " ".join(base))]
    for i in range(1, 40):
        words = list(base)
        for _ in range(5):
            words[rng.randrange(300)] = f"n{i}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join(f"u{i}x{j}" for j in range(50))) for i in range(20)]
    rows += [(300, ""), (301, None), (302, "same"), (303, "same"), (302, "same"), (None, "nobody"), (None, "nobody")]
    docs = spark.createDataFrame([(*r, 7, "e") for r in rows], "doc_id bigint, text string, n int, root string")
    kept = simhash.one_of_each_group(docs)
    assert kept.columns == docs.columns
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for w in ((r[1] or "").lower().split() for r in rows)]
    parent = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                parent[find(parent, i)] = find(parent, j)
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[find(parent, i)].append(r[0])
    want = sorted((min((x for x in g if x is not None), default=None) for g in groups.values()), key=repr)
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == want
    assert simhash.one_of_each_group(docs.limit(0)).count() == 0


def brute_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        out.append((len(b), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), bytes(x for x, g in zip(b, gone) if not g)))
    return out


@pytest.mark.parametrize("hot", [4096, 2])
def test_repeated_strings(spark, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "_BLOCK_BYTES", 3000)
    rng = random.Random(hot)
    passage = [text_of(rng, 12) for _ in range(6)]
    texts = ["é" + text_of(rng, rng.randint(0, 30)) + rng.choice(passage) + text_of(rng, rng.randint(0, 9)) + rng.choice([*passage, ""]) for _ in range(50)]
    texts += ["a" * 300, "ab" * 90, None, "", texts[3], texts[3]]
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in enumerate(texts)], "doc_id bigint, text string, t string, n_bytes int, k int")
    want = brute_repeats(texts, 40)
    left = substrings.without_repeats(docs, length=40, anchor=10)
    assert left.columns == ["doc_id", "text", "t", "k", "n_bytes", "n_removed", "n_spans", "kept"]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in left.collect()}
    assert [got[i] for i in range(len(texts))] == want
    digest = substrings.without_repeats(docs, length=40, anchor=10, output="digest")
    assert {r.doc_id: r.kept for r in digest.collect()} == {i: hashlib.sha256(w[3]).hexdigest() for i, w in enumerate(want)}
    words = substrings.without_repeats(docs, length=40, anchor=10, output="text")
    assert {r.doc_id: r.kept for r in words.collect()} == {i: w[3].decode(errors="ignore") for i, w in enumerate(want)}
    assert substrings.without_repeats(docs.limit(0)).count() == 0


def test_transform_settles_contexts():
    rng = random.Random(3)
    for _ in range(80):
        length = rng.choice([3, 5, 8])
        contexts = list({bytes(rng.choice(b"aab\x00\xff") for _ in range(rng.randint(length, 30))) for _ in range(rng.randint(1, 12))})
        counts = [rng.choice([1, 1, 2]) for _ in contexts]
        seen = Counter()
        for c, n in zip(contexts, counts):
            for i in range(len(c) - length + 1):
                seen[c[i : i + length]] += n
        want = [[i for i in range(len(c) - length + 1) if seen[c[i : i + length]] > 1] for c in contexts]
        assert [x.tolist() for x in substrings.repeated_starts(contexts, counts, length)] == want


def test_anchor_owns_every_start_once(monkeypatch):
    rng = random.Random(4)
    import pyarrow as pa

    for _ in range(20):
        monkeypatch.setattr(substrings, "_STARTS", rng.choice([7, 50, 1 << 21]))
        texts = [bytes(rng.choice(b"abc") for _ in range(rng.choice([0, 19, 20, 21, 60]))) for _ in range(rng.randint(0, 6))]
        data, begins, ends = substrings.flat_texts(pa.array(texts, pa.binary()))
        starts = [(int(t), int(f) + j - int(begins[t])) for ts, _, fs, ns, _ in substrings.owned_runs(data, begins, ends, 20, 6) for t, f, n in zip(ts, fs, ns) for j in range(n)]
        assert starts == [(i, j) for i, t in enumerate(texts) for j in range(max(0, len(t) - 19))]


def test_word_encoder_matches_the_library():
    whole = Tokenizer.from_file(word_vocabulary())
    encoder = WordEncoder(word_vocabulary(), most=50)
    rng = random.Random(2)
    parts = ["don't", "I'LL", "Straße", "ÉCOLE", "İstanbul", "日本 語", "a_b", "x²", "12 345", "!!!", "é", "<|endoftext|>", "ſ", " ", "…", "ok.", "'s", "é"]
    for _ in range(150):
        text = "".join(rng.choice(parts) + rng.choice([" ", "", "\n", "  "]) for _ in range(rng.randint(0, 30)))
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_packing(spark):
    rows = sample_docs()
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "0 AS start", "1 AS _n", "2 AS sequence_id")
    got = packing.pack(docs, word_vocabulary(), size=256, group_pieces=40, keep_ids=True).collect()
    whole = Tokenizer.from_file(word_vocabulary())
    ids = [[*e.ids, 2] for e in whole.encode_batch([r[1] or "" for r in rows], add_special_tokens=False)]
    want = Counter((r[0], s, tuple(x[s : s + 256]), len(x)) for r, x in zip(rows, ids) for s in range(0, len(x), 256))
    assert Counter((p.doc_id, p.start, tuple(np.frombuffer(p.ids, "<u4").tolist()), p.doc_tokens) for p in got) == want
    assert all(zlib.crc32(p.ids) == p.ids_crc32 and p.length * 4 == len(p.ids) for p in got)
    sequences = defaultdict(list)
    for p in got:
        sequences[p.sequence_id].append((p.offset, p.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack(docs.limit(0), word_vocabulary()).count() == 0


def test_first_fit_decreasing_is_plain_first_fit():
    rng = np.random.default_rng(6)
    for n in (0, 1, 2, 7, 300):
        sizes = rng.integers(0, 101, n)
        room, bins = [], []
        for i in np.argsort(-sizes, kind="stable"):
            at = next((b for b, r in enumerate(room) if r >= sizes[i]), None)
            if at is None:
                at = len(room)
                room.append(100)
            bins.append((int(i), at, 100 - room[at]))
            room[at] -= sizes[i]
        got, offsets = packing.first_fit_decreasing(sizes, 100)
        assert sorted(bins) == [(i, int(got[i]), int(offsets[i])) for i in range(n)]
    with pytest.raises(ValueError):
        packing.first_fit_decreasing(np.array([101]), 100)


def test_mixing(spark):
    rows = sample_docs()
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS size", "2 AS `row`", "3 AS target")
    got = mixing.mix(docs, [5, 2, 1]).collect()
    sizes = [len((r[1] or "").split()) for r in rows]
    by_source = defaultdict(int)
    for r, n in zip(rows, sizes):
        by_source[r[2]] += n
    order = sorted(by_source, key=lambda s: (s is None, s))
    weight = {s: [5, 2, 1][i % 3] for i, s in enumerate(order)}
    rest, free, target = 1.5 * sum(sizes), set(order), {}
    while free:
        total = sum(weight[s] for s in free)
        above = {s for s in free if rest * weight[s] > 2 * by_source[s] * total}
        if not above:
            target |= {s: rest * weight[s] / total for s in free}
            break
        target |= {s: 2.0 * by_source[s] for s in above}
        rest -= sum(target[s] for s in above)
        free -= above
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((r[0], r[2], n) for r, n in zip(rows, sizes))
    taken = defaultdict(int)
    for r in got:
        assert abs(r.target - target[r.source]) < 1e-9 and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert taken == {s: int(t + 0.5) for s, t in target.items()}
    copies = mixing.mixed_documents(docs, [5, 2, 1])
    assert copies.columns == docs.columns
    assert sum(len(r.text.split()) for r in copies.collect()) == sum(taken.values())
    assert mixing.mix(docs.limit(0), [1]).count() == 0 and mixing.mixed_documents(docs.limit(0), [1]).count() == 0


def test_source_places_need_no_single_task(spark):
    names = [(f"n{i * 7919 % 1000}",) for i in range(500)] + [(None,)]
    got = {r.source: r.place for r in mixing.ranked_sources(spark.createDataFrame(names, "source string")).collect()}
    assert got == {s: i for i, (s,) in enumerate(sorted(names, key=lambda r: (r[0] is None, r[0])))}


def test_digests_cover_the_text_and_peel_exactly(monkeypatch):
    rng = random.Random(2)
    pieces = ["alpha", "b", "gamma delta", "x\ny", " ", "\n", "é"]
    pairs, want = [], []
    for _ in range(200):
        a = " ".join(rng.choice(pieces) for _ in range(rng.randint(0, 200)))
        b = a if rng.random() < 0.2 else a[: len(a) // 2] + " ".join(rng.choice(pieces) for _ in range(rng.randint(0, 100)))
        x, y = fingerprints.digests(a.encode()), fingerprints.digests(b.encode())
        size = lambda keys: sum(int(k) & 0xFFFF for k in keys)
        assert len(set(x.tolist())) == len(x) and size(x) == len(a.encode())
        total = size(x) + size(y)
        pairs.append((x, y))
        want.append(1 - size(set(x.tolist()) ^ set(y.tolist())) / total if total else 1.0)
    assert np.allclose(fingerprints.likenesses(pairs), want)
    monkeypatch.setattr(fingerprints, "_SLICE", 64)
    for _ in range(20):
        raw = " ".join(rng.choice(pieces) for _ in range(100)).encode()
        found = fingerprints.digests(raw)
        monkeypatch.setattr(fingerprints, "_SLICE", 1 << 20)
        assert (fingerprints.digests(raw) == found).all()
        monkeypatch.setattr(fingerprints, "_SLICE", 64)


def test_long_runs_without_spaces_count_whole(monkeypatch):
    rng = random.Random(3)
    run = "".join(rng.choice("abcdefgh") for _ in range(300_000))
    edited = run[:150_000] + "".join(rng.choice("ijklmnop") for _ in range(150_000))
    same_word, one_byte = ("foo " * 60_000).encode(), b"a" * 300_001
    low = np.uint64(0xFFFF)
    for raw in (run.encode(), one_byte, same_word, b" " * 200_000, b"x " + one_byte + b" y"):
        found = fingerprints.digests(raw)
        assert int((found & low).sum()) == len(raw) and int((found & low).max()) <= 1 << 15
        monkeypatch.setattr(fingerprints, "_SLICE", 40_000)
        assert (fingerprints.digests(raw) == found).all()
        monkeypatch.setattr(fingerprints, "_SLICE", 1 << 20)
    near = fingerprints.likenesses([(fingerprints.digests(run.encode()), fingerprints.digests(edited.encode()))])
    assert 0.4 < near[0] < 0.52


def test_clashing_columns_stay(spark):
    rows = [(1, "one two three four five six", "a"), (2, "one two three four five six", "b"), (3, "other", "c")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _digest string").selectExpr("*", "1 AS _k", "2 AS _t", "3 AS _n", "4 AS row", "5 AS key")
    kept = simhash.one_of_each_group(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id, r._digest, r._n) for r in kept.collect()) == [(1, "a", 3), (3, "c", 3)]
    named = spark.createDataFrame([("two words",), (None,)], "`a.b` string")
    assert [r.n for r in named.select(mixing.word_count("a.b").alias("n")).collect()] == [2, 0]


def test_edited_likeness(spark):
    rows = sample_docs()
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS bucket", "2 AS key", "3 AS t").repartition(7)
    got = Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in fingerprints.edited_likeness(docs).collect())
    order = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    want = Counter()
    for i, (key, text) in enumerate(order):
        following, n = order[(i + 1) % len(order)][1], len(text)
        edited = text[: n - n // 2] + following[: n // 2]
        want[key, n, hashlib.sha256(edited.encode()).hexdigest()] += 1
    assert got == want
    for r in fingerprints.edited_likeness(docs).collect():
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    one = fingerprints.edited_likeness(docs.filter("doc_id = 3")).first()
    assert one.near_next == 1.0 and fingerprints.edited_likeness(docs.limit(0)).count() == 0


def test_token_counts_follow_edits(spark):
    vocabulary = byte_vocabulary()
    counter, rng = token_counts.Counter(vocabulary), random.Random(1)
    import base64

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    parts = ["foo", "'s", "'re", " ", "  ", "\n\n", "1", "22", "!!", "é", "日本", "\t", " world", " ", "\x1c"]
    for _ in range(120):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 120)))
        tree = token_counts.build(text, counter, leaf=rng.choice([1, 2, 5, 32]))
        for _ in range(5):
            start = rng.randint(0, len(text))
            stop, new = min(len(text), start + rng.choice([0, 1, 3, 30])), "".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 3])))
            want = text[:start] + new + text[stop:]
            text, tree, _ = token_counts.edit(text, tree, counter, start, stop, new)
            assert text == want and tree.chars == len(text) and tree.tokens == len(plain.encode_ordinary(text))
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(sample_docs(), DOCS).selectExpr("*", "1 AS token_counts", "2 AS edited")
    edits = F.array(F.struct(F.lit(2).alias("start"), F.lit(9).alias("stop"), F.lit(" new text ").alias("text")))
    for r in token_counts.with_edit_counts(docs, vocabulary, edits).collect():
        text = r.text or ""
        edited = text[:2] + " new text " + text[9:]
        c = r.token_counts
        assert (c.edited, c.tokens, c.edited_tokens) == (edited, len(plain.encode_ordinary(text)), len(plain.encode_ordinary(edited)))
        assert sum(c.tree_tokens) == c.edited_tokens
    assert token_counts.with_edit_counts(docs.limit(0), vocabulary, edits).count() == 0
