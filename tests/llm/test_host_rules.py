"""Rule counts and host verdicts against plain loops."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from trawl.llm import host_rules

SCHEMA = "doc_id bigint, text string, host string, n_words string, kept int, _key int, bad_host string"


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = {j for i, w in enumerate(windows) if w in often for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), len(lines)


TEXTS = [
    "", " \n\t", "one", "a b c a b c", "a\x0bb\x0cc a b c x", "é è ü 😀 | # <b>", "x y\nx y\n x y\nx y\n\n\n", "a b a b a b a b", " a\x85b \x1cc", "a a a a", "a a a",
]


def test_counts():
    rng = random.Random(2)
    for text in TEXTS + [" ".join(rng.choice("abcdé") + rng.choice(["", "\n"]) for _ in range(rng.randrange(400))) for _ in range(60)]:
        assert host_rules.text_counts(text.encode()) == plain_counts(text), text


def test_long_texts_in_slices(monkeypatch):
    rng = random.Random(3)
    text = " ".join(rng.choice(["alpha", "beta", "gamma", "δ"]) + str(rng.randrange(30)) for _ in range(3000))
    whole = host_rules.text_counts(text.encode())
    monkeypatch.setattr(host_rules, "_SLICE", 37)
    assert host_rules.text_counts(text.encode()) == whole == plain_counts(text)


def plain_verdicts(rows, most=0.5):
    rules = {"short": lambda c: c[0] < 50, "repeats": lambda c: 100 * c[4] > 50 * c[0], "symbols": lambda c: 10 * c[2] > c[1], "dup_lines": lambda c: 10 * c[3] > 3 * c[5]}
    counts = [(host, plain_counts(text)) for _, text, host in rows]
    bad = set()
    for rule in rules.values():
        n, f = Counter(h for h, _ in counts if h is not None), Counter(h for h, c in counts if h is not None and rule(c))
        total, fails = sum(n.values()), sum(f.values())
        p = fails / total
        room = total - sum(x * x for x in n.values()) / total - (len(n) - 1)
        alike = 1 / 3
        if room > 0 and 0 < p < 1:
            q = sum(n[h] * (f[h] / n[h] - p) ** 2 for h in n)
            alike = min(max((q / (p * (1 - p)) - (len(n) - 1)) / room, 1e-4), 0.9999)
        weight = (1 - alike) / alike
        for h in n:
            a, b = p * weight + f[h], (1 - p) * weight + n[h] - f[h]
            mean = a / (a + b)
            if mean - 2 * (mean * (1 - mean) / (a + b + 1)) ** 0.5 > most and f[h] > most * n[h]:
                bad.add(h)
    base = [rules["short"](c) or rules["repeats"](c) for _, c in counts]
    return [(b, h in bad, not b and h not in bad) for b, (h, _) in zip(base, counts)], bad


@pytest.mark.parametrize("hosts", [1, 2, 12])
def test_verdicts(spark, hosts):
    rng = random.Random(hosts)
    rows = []
    for i in range(400):
        host = f"h{rng.randrange(hosts)}"
        junk = rng.random() < (0.9 if host == "h0" else 0.04)
        rows.append((i, "few words" if junk else " ".join(f"w{rng.randrange(5000)}" for _ in range(60)), host))
    rows += [(900, None, "h1"), (901, "", None), (902, "x " * 90, None), rows[3], rows[3], (None, " ".join(map(str, range(70))), "h0")]
    df = spark.createDataFrame([(*r, "n", 7, 8, "b") for r in rows], SCHEMA)
    got = host_rules.judge_by_host(df, F.col("host"))
    assert got.columns == ["doc_id", "host", *host_rules.COUNTS, "base_failed", "bad_host", "kept"]
    verdicts, bad = plain_verdicts(rows)
    want = Counter((k, h, *plain_counts(t), *v) for (k, t, h), v in zip(rows, verdicts))
    assert Counter(map(tuple, got.collect())) == want
    assert bad == ({"h0"} if hosts > 1 else bad)


def test_all_alike_and_empty(spark):
    good = [(i, " ".join(map(str, range(80))), "h", "n", 1, 1, "") for i in range(5)]
    assert all(r.kept for r in host_rules.judge_by_host(spark.createDataFrame(good, SCHEMA), F.col("host")).collect())
    assert not any(r.kept for r in host_rules.judge_by_host(spark.createDataFrame([(1, "x", "h", "", 1, 1, "")] * 4, SCHEMA), F.col("host")).collect())
    assert host_rules.judge_by_host(spark.createDataFrame([], SCHEMA), F.col("host")).count() == 0
