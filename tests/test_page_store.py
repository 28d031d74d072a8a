"""Hashes, repeated lines and digests kept from page sums equal those of the pages that are there."""

import hashlib
import random

from pyspark.sql import functions as F

from trawl.operators import pages as pg, versions as v
from trawl.sources.page_store import PageStore

PAGE = "session_id string, doc_name string, page bigint, text string"


def made(rng, session, doc, page):
    """A page with odd white space, shared first and last lines, a single line, or nothing."""
    words = lambda: rng.choice([" ", "\t", " ", "\x1c"]).join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(rng.randrange(1, 6)))
    edge = lambda: rng.choice(["Head  one", " Head one", "Foot", "Foot" + "x" * 130 + rng.choice("yz"), words()])
    kind = rng.randrange(6)
    body = [None, "", " \n\x0b", edge(), f"{edge()}\r\n{edge()}", "\n".join([edge(), words(), "", words(), edge()])][kind]
    return (session, doc, page, body)


def digest(rows):
    words = [0] * 8
    for _, _, page, text in rows:
        raw = hashlib.sha256(f"{page}:{text or ''}".encode()).digest()
        words = [(w + int.from_bytes(raw[4 * i : 4 * i + 4])) % 2**32 for i, w in enumerate(words)]
    return "".join(f"{w:08x}" for w in words)


def test_any_sequence_of_page_changes(spark, tmp_path):
    rng = random.Random(8)
    store, there = PageStore(spark, f"{tmp_path}/s"), {}
    frame = lambda rows: spark.createDataFrame(rows, PAGE)
    for batch in range(3):
        gone = [there.pop(k) for k in rng.sample(sorted(there), len(there) // 3)]
        if batch == 2:
            gone += [there.pop(k) for k in sorted(there) if k[1] == "c"]
        names = [("s", "a"), ("s", "b"), ("t", "a")] + [("s", "c")] * (batch < 2)
        added = [made(rng, *names[i % len(names)], 40 * batch + i) for i in range(40)]
        if gone and batch == 1:  # a page is corrected in one batch
            added.append(made(rng, *gone[0][:3]))
        there |= {r[:3]: r for r in added}
        for _ in range(1 + (batch == 1)):  # a repeated batch replaces itself
            store.apply(batch, frame(added), frame(gone) if gone else None)
    left = frame(list(there.values()))
    rows = lambda df, *names: sorted(tuple(r) for r in df.select(*names).collect())
    folded = PageStore(spark, f"{tmp_path}/f")
    store.fold(folded)
    by_doc = {}
    for r in there.values():
        by_doc.setdefault(r[:2], []).append(r)
    plain = sorted((*k, len(r), sum(len(x[3] or "") for x in r), digest(r)) for k, r in by_doc.items())
    for s in (store, folded):
        for least in (2, 3) if s is store else (3,):
            want = rows(v.simhash128(pg.clean_pages(left.withColumn("text", F.coalesce("text", F.lit(""))), least), pg.DOC), *pg.DOC, "hi", "lo")
            assert rows(s.hashes(least), *pg.DOC, "hi", "lo") == want
            lines = [*pg.DOC, "position", "key", "n"]
            assert rows(s.repeated_lines(least), *lines) == rows(pg.repeated_lines(pg.page_edges(left), least), *lines)
        assert rows(s.digests(), *pg.DOC, "pages", "n_chars", "digest") == plain
        assert rows(s.hashes(), *pg.DOC, "pages") == [p[:3] for p in plain]


def test_a_late_page_writes_its_own_sums_only(spark, tmp_path):
    store = PageStore(spark, f"{tmp_path}/s")
    store.apply(0, spark.createDataFrame([("d", i, f"h\nw{i}\nt{i}") for i in range(50)], "doc_name string, page bigint, text string"))
    store.apply(1, spark.createDataFrame([("d", 50, "h\nlate\nend")], "doc_name string, page bigint, text string"))
    assert spark.read.parquet(f"{tmp_path}/s/sums/batch=1").count() == 3
    assert spark.read.parquet(f"{tmp_path}/s/digests/batch=1").count() == 1
