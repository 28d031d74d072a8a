"""Approximate and trained operators: recall, held-out accuracy, pages, verdicts, and the pipeline's stages."""

import math
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from trawl.llm import html_text, neighbours, quality, urls
from trawl.llm.queries import op9_main_text
from trawl.session import stage_table

SMALL = "/root/testdata/sf0.001"


def brute_neighbours(rows, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    good = [(i, v) for i, v in good if len(v) == 8]
    out = {}
    for i, v in good:
        if i % 5 == 0:
            scores = [(-round(float(v @ w / (np.linalg.norm(v) * np.linalg.norm(w))), 12), j) for j, w in good if j != i]
            out[i] = [(j, -s) for s, j in sorted(scores)[:k]]
    return out


def test_neighbours_with_copies_and_bad_vectors(spark):
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((400, 8)).round(3)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(1000 + i, vectors[0].tolist()) for i in range(120)]
    rows += [(5000, None), (5005, []), (5010, [0.0] * 8), (5015, [1.0, None] + [0.0] * 6), (5020, [float("nan")] + [1.0] * 7), (5025, [float("inf")] + [1.0] * 7), (5030, [1.0, 2.0]), (None, [1.0] * 8)]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id bigint, embedding array<double>, rep int, v int").repartition(5)
    got = {}
    for r in neighbours.nearest(table, F.col("vec_id") % 5 == 0, k=5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 12)))
    want = brute_neighbours(rows, 5)
    assert set(got) == set(want) and all(len(g) == 5 for g in got.values())
    hits = sum(len({j for j, _ in got[q]} & {j for j, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    assert got[0] == want[0] and [j for j, _ in got[1005]] == [0, 1000, 1001, 1002, 1003]
    assert neighbours.nearest(table.limit(0), F.lit(True)).count() == 0
    few = neighbours.nearest(table.filter("vec_id < 3"), F.col("vec_id") == 0, k=5).collect()
    assert [r.rank for r in sorted(few, key=lambda r: r.rank)] == [1, 2]


def test_long_lists_are_scored_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((300, 8)))]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    whole = {(r.query_id, r.rank, r.vec_id) for r in neighbours.nearest(table, F.col("vec_id") % 10 == 0).collect()}
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    assert {(r.query_id, r.rank, r.vec_id) for r in neighbours.nearest(table, F.col("vec_id") % 10 == 0).collect()} == whole


def test_graph_walk_finds_the_nearest():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = neighbours.Graph(neighbours.balanced_centroids(x, 128))
    found, _ = graph.search(x[:200], 16)
    want = np.argmax(x[:200] @ graph.centroids.T, axis=1)
    assert (found[:, 0] == want).mean() > 0.97
    counts = np.bincount(np.argmax(x @ graph.centroids.T, axis=1), minlength=128)
    assert counts.max() < 5 * counts.mean()


def test_quality_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    scored = quality.cotrained_scores(docs, labels.filter(~fold)).join(labels.filter(fold).select("doc_id", "quality"), "doc_id").collect()
    right = [(r.score >= 0.5) == (r.quality == 1) for r in scored]
    assert len(right) > 80 and sum(right) >= 0.95 * len(right)
    assert sum((r.content_score >= 0.5) == (r.quality == 1) for r in scored) >= 0.9 * len(scored)


def test_quality_edge_cases(spark):
    schema = "doc_id bigint, text string, source string, lang string, n_chars bigint, score string"
    docs = spark.createDataFrame([(1, None, None, None, None, "a"), (None, "text", "s", "en", 4, "b"), (1, None, None, None, None, "a")], schema)
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    out = quality.cotrained_scores(docs, none)
    assert out.count() == 3 and {r.score for r in out.collect()} == {1.0}
    bad = spark.createDataFrame([(1, 0), (None, 1), (2, None)], "doc_id bigint, quality int")
    assert {r.score for r in quality.cotrained_scores(docs, bad).collect()} == {0.0}
    assert quality.cotrained_scores(docs.limit(0), bad).count() == 0
    assert np.isfinite(quality.content_features("word " * 600000)).all()


def test_quality_rounds_exchange_labels():
    rng = np.random.default_rng(7)
    y = (rng.random(400) < 0.5).astype(float)
    a, b = rng.standard_normal((400, 6)) + 1.5 * y[:, None], rng.standard_normal((400, 6)) + 1.5 * y[:, None]
    model = quality.CoTrained.fit(a[:80], b[:80], y[:80], a[80:300], b[80:300])
    right = (model.score(a[300:], b[300:])[:, 2] >= 0.5) == (y[300:] == 1)
    assert right.mean() > 0.95


def sampled_rows(monkeypatch, docs, labels, **options):
    """Labels of the labelled rows and number of other rows that training gets."""
    seen = []
    fit = quality.CoTrained.fit
    monkeypatch.setattr(quality.CoTrained, "fit", staticmethod(lambda *a, **b: seen.append((a[2].tolist(), len(a[3]))) or fit(*a, **b)))
    model = quality.fit(docs, labels, **options)
    monkeypatch.undo()
    return model, *seen[0]


@pytest.mark.parametrize("texts", [1, 300])
def test_repeated_keys_leave_the_others_in_the_sample(spark, monkeypatch, texts):
    keys = spark.range(120).orderBy(F.xxhash64(F.lit(42), F.col("id"))).select("id")
    first = [r.id for r in keys.collect()]
    good = {k: i % 2 for i, k in enumerate(first)}
    rows = [(k, "plain words of a good text" if good[k] else "!!! BUY 1000 $$$ ###") for k in first]
    # The labelled and the other key with the smallest hashes fill both bounds.
    marked = [k for i, k in enumerate(first) if i % 4 < 2]
    rows += [(k, f"copy {i % texts}") for k in (marked[0], next(k for k in first if k not in marked)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, good[k]) for k in marked], "doc_id bigint, quality int")
    model, y, others = sampled_rows(monkeypatch, docs, labels, max_labelled=60, max_pool=60)
    assert model.constant is None and min(y.count(0.0), y.count(1.0)) >= 29 and others >= 59


def test_a_rare_class_and_the_whole_pool_are_sampled(spark, monkeypatch):
    # 12 bad ones of 4,000 labelled documents, 400 picked; the first keys in the seeded order are all labelled.
    first = [r.id for r in spark.range(4100).orderBy(F.xxhash64(F.lit(42), F.col("id"))).collect()]
    bad = set(first[3000:3012])
    docs = spark.createDataFrame([(k, "!!! BUY 1000 $$$ ###" if k in bad else f"plain words of good text {k % 7}") for k in first], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, int(k not in bad)) for k in first[:4000]], "doc_id bigint, quality int")
    model, y, others = sampled_rows(monkeypatch, docs, labels, max_labelled=400, max_pool=400)
    assert y.count(0.0) == 12 and y.count(1.0) == 388 and others == 100
    assert model.shift == pytest.approx(math.log(3988 / 12) - math.log(388 / 12))
    scores = {r.doc_id: r.score for r in quality.with_scores(docs, model).collect()}
    assert all((scores[k] < 0.5) == (k in bad) for k in first)


def test_main_text_of_the_given_pages(spark):
    import re
    from html import unescape

    rows = {r.page_id: r for r in op9_main_text(spark, SMALL).collect()}
    for p in spark.read.parquet(f"{SMALL}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        blocks = (" ".join(unescape(re.sub(r"</?b>", "", b).replace("<br>", " ")).split()) for b in re.split(r"</?(?:p|h1)>", article))
        assert rows[p.page_id].text == "\n\n".join(b for b in blocks if b) and rows[p.page_id].n_chars == len(rows[p.page_id].text)


PAGE = """<html><head><title>x</title></head><body><header><h1>Site</h1><nav><a href=/a>A</a></nav></header>
<div id="main"><div class="sidebar"><p>side bar text that is long enough to matter here</p></div>
<div class="post-content"><h2>Head &amp; line</h2><p>First&nbsp;para with <a href="x">a link</a> and more text, long enough.
<p>Second <b>bold<i>x</b> para<br>after br. 5 < 6 &lt;tag&gt; it is</p><ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table><aside>no</aside><form>f<input></form>
<div class="links"><a href=1>more</a> <a href=2>and more</a></div></div>
<section class="comments"><p>Great article! I really liked reading all of this long text.</p></section></div>
<div class="cookie-notice">We use cookies</div><div style="display: none">hidden</div><footer>f</footer><script>if (a<b) "</p>"</script></body></html>"""


@pytest.mark.parametrize(
    "html,text",
    [
        (PAGE, "Head & line\n\nFirst para with a link and more text, long enough.\n\nSecond boldx para after br. 5 < 6 <tag> it is\n\none\n\ntwo\n\nc1\n\nc2"),
        (None, ""), ("", ""), ("<html><body><nav>only</nav></body></html>", ""), ("plain text", "plain text"), ("<p>a &am <!-- b -->c<p", "a &am c"),
        ("</div></p>x<div>", "x"), ("<body><script>never closed", ""), ("<p>&#233;&eacute;&copy;", "éé©"), ('<p title="a>b">q', "q"),
    ],
)
def test_main_text_cases(html, text):
    assert html_text.main_text(html) == text


STORY = "".join(f"<p>Sentence {i} of the story, which goes on for quite a while, as stories do." for i in range(8))


@pytest.mark.parametrize(
    "before,after",
    [
        ('<div class="content-sidebar-wrap">', '</div>'), ('<div class="has-sidebar">', '</div>'), ('<div class="layout no-sidebar">', '</div>'), ('<div class="ad-free content">', '</div>'),
        ('<article class="post comments-open">', '</article>'), ('<div id="sidebar-wrap"><article>', '</article><div class="sidebar"><p>aside text, somewhat long</div></div>'),
        ('<div class="widget"><div class="promo"><main>', '</main></div></div>'), ('<article class="sponsored">', '</article><div class="ad"><p>buy now</div>'),
        ('<div class="related">', '</div><div class="promo">buy</div><div class="header">Site</div>'), ('<div class="replies">', '</div>'),
        ('<div class="post">', '</div><section class="comments">' + '<article><p>I do not agree with any of it at all.</p></article>' * 12 + '</section>'),
        ('<div class="widget">', '</div><ol class="commentlist">' + '<li><p>I do not agree with any of it at all.</p>' * 40 + '</ol>'),
        ('<article>', '</article><div class="no-js sidebar"><p>aside text</div><div id="comments-wrapper"><p>first comment</div><article class="promo"><p>buy this</article>'),
    ],
)
def test_main_text_in_parts_with_names_of_others(before, after):
    want = [" ".join(p.split()) for p in STORY.split("<p>") if p]
    assert html_text.main_text(f"<body>{before}{STORY}{after}</body>").split("\n\n") == want


def test_main_text_of_long_and_deep_pages():
    deep = "<div>" * 3000 + "<p>inner words of the page</p>" + "</div>" * 3000
    assert html_text.main_text(deep) == "inner words of the page"
    many = "<article>" + "".join(f"<p>paragraph {i} with some words" for i in range(20000)) + "</article>"
    assert html_text.main_text(many).count("\n\n") == 19999
    assert html_text.main_text('<a href="' * 2000) == ""


def judged(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = "".join(c.lower() if c.isascii() else c for c in rest[:end]), rest[end:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fits = [(h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, key=lambda f: len(f[0])) if fits else (None, None)
    return host, path, *best


def test_rules_and_graph(spark):
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("bad.org", "/", "block")]
    link = lambda host: f'<a class=x href="https://{host}/x">y</a>'
    rows = [
        (1, "http://WWW.Example.com/en/1", ""), (2, "http://m.example.com/en/1?q=a#b", ""), (3, "https://xcom/", ""), (4, "http://a.net/es", ""), (5, "http://a.net/es/2#t", ""),
        (6, None, None), (7, "no host", link("bad.org")), (8, "http://com", ""), (9, "http://good.io/1", ""), (10, "http://trusted.com/", link("good.io")),
        (11, "http://spam.io/p", link("bad.org") * 3), (12, "http://bad.org/x", link("good.io")), (13, "http://bad.org/x?", None), (13, "http://bad.org/x?", None), (14, "http://a://b/c", ""),
        (15, "http://ÄÖ.net/ES/", ""), (16, "http:///path", ""), (17, "http://far.io", link("spam.io")),
    ] + [(100 + i, "http://bad.org/many", "") for i in range(60)]
    pages = spark.createDataFrame([(*r, 1, "z") for r in rows], "page_id bigint, url string, html string, host int, rule string")
    got = urls.url_verdicts(pages, urls.rules_frame(spark, rules)).collect()
    assert Counter((r.page_id, r.host, r.path, r.rule) for r in got) == Counter((i, *judged(u, rules)[:3]) for i, u, _ in rows)
    verdicts = {r.page_id: r.verdict for r in got}
    for i, u, _ in rows:
        assert verdicts[i] == (judged(u, rules)[3] or verdicts[i])
    assert verdicts[11] == "block" and verdicts[17] == "block" and verdicts[9] == "allow" and verdicts[6] == "allow"
    assert urls.url_verdicts(pages.limit(0), urls.rules_frame(spark, rules)).count() == 0


def test_spread_matches_plain_iteration(spark):
    rng = random.Random(8)
    links = {(f"h{rng.randrange(20)}", f"h{rng.randrange(20)}") for _ in range(50)}
    links = sorted((a, b) for a, b in links if a != b)
    seeds = {"h1": (5.0, 0.0), "h2": (0.0, 3.0), "h40": (1.0, 1.0)}
    frame = spark.createDataFrame([(h, *s) for h, s in seeds.items()], "host string, trust double, distrust double")
    got = {r.host: (r.trust, r.distrust) for r in urls.spread(frame, spark.createDataFrame(links, "a string, b string"), rounds=5, tolerance=0.0).collect()}
    nodes = {x for link in links for x in link} | set(seeds)
    out, into = Counter(a for a, _ in links), Counter(b for _, b in links)
    now = {h: seeds.get(h, (0.0, 0.0)) for h in nodes}
    for _ in range(5):
        trust = {h: now[h][0] if not out[h] else 0.0 for h in nodes}
        distrust = {h: now[h][1] if not into[h] else 0.0 for h in nodes}
        for a, b in links:
            trust[b] += now[a][0] / out[a]
            distrust[a] += now[b][1] / into[b]
        now = {h: tuple(0.15 * s + 0.85 * m for s, m in zip(seeds.get(h, (0.0, 0.0)), (trust[h], distrust[h]))) for h in nodes}
    assert set(got) == nodes and all(np.allclose(got[h], now[h]) for h in nodes)


def test_verdicts_do_not_depend_on_unrelated_pages(spark):
    link = lambda host: f'<a href="https://{host}/x">y</a>'
    chain = [(f"http://bad.org/{i}", "") for i in range(60)] + [("http://spam.io/p", link("bad.org")), ("http://far.io/", link("spam.io"))]
    pages = spark.createDataFrame([(-1 - i, *r) for i, r in enumerate(chain)], "page_id bigint, url string, html string")
    flat = spark.range(600_000).select("id", F.concat(F.lit("http://h"), F.col("id") % 1000, F.lit(".com/")), F.lit(""))
    rules = urls.rules_frame(spark, [("bad.org", "/", "block"), ("com", "/", "allow")])
    few, many = ({r.host: r for r in urls.url_verdicts(p, rules).filter("page_id < 0").collect()} for p in (pages, pages.union(flat)))
    assert all(r.verdict == "block" for r in [*few.values(), *many.values()]) and set(few) == set(many) == {"bad.org", "spam.io", "far.io"}
    assert all(abs(few[h].distrust - many[h].distrust) < 1e-4 and few[h].distrust > 5 for h in few)


def test_spread_runs_until_every_host_is_settled(spark):
    # A long chain to the seed, a circle, and a host that keeps what it gets.
    links = [(f"c{i}", f"c{i + 1}") for i in range(12)] + [("x", "y"), ("y", "x"), ("y", "z"), ("c3", "x")]
    seeds = {"c12": (0.0, 1e5), "x": (40.0, 2.0), "z": (3.0, 7.0)}
    frame = spark.createDataFrame([(h, *s) for h, s in seeds.items()], "host string, trust double, distrust double")
    got = {r.host: (r.trust, r.distrust) for r in urls.spread(frame, spark.createDataFrame(links, "a string, b string"), damping=0.5).collect()}
    names = sorted(got)
    steps = np.zeros((2, len(names), len(names)))
    for v, pairs in enumerate((links, [(b, a) for a, b in links])):
        for h in names:
            goals = [b for a, b in pairs if a == h] or [h]
            for b in goals:
                steps[v, names.index(b), names.index(h)] += 1 / len(goals)
    start = np.array([seeds.get(h, (0.0, 0.0)) for h in names])
    want = [np.linalg.solve(np.eye(len(names)) - 0.5 * steps[v], 0.5 * start[:, v]) for v in (0, 1)]
    assert all(np.abs([got[h][v] for h in names] - want[v]).max() < 1e-4 for v in (0, 1))


def test_pipeline_stages_hand_on_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    sizes, columns = [docs.count()], docs.columns
    names = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage_table(stage(spark, docs, SMALL))
        names.append(docs.columns)
        sizes.append(docs.count())
    assert all(n == columns for n in names[:-1])
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3] and sizes[5] > 0
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, spark.read.parquet(f"{SMALL}/documents.parquet").limit(0), SMALL)
        assert empty.count() == 0


def test_stray_end_tags_cost_nothing():
    start = time.perf_counter()
    text = html_text.main_text("<body>" + "<div>" * 4000 + "<p>" + "Some words of the article. " * 20 + "</span></b></x>" * 33_000)
    assert text.startswith("Some words") and time.perf_counter() - start < 5


def test_a_page_inside_one_form():
    body = "<h1>Title here</h1>" + "".join(f"<p>Paragraph {i} with many words of the article in it.</p>" for i in range(8))
    assert "Paragraph 7" in html_text.main_text(f"<body><form id=f action=/x/><input name=q>{body}<button>Go</button></form></body>")
    assert html_text.main_text(f"<body><div>{body}</div><form><p>Your name</p><input></form></body>").endswith("Paragraph 7 with many words of the article in it.")
    assert html_text.main_text("<body><form><label>User name and password please</label><input></form></body>") == ""


def test_a_slash_in_an_unquoted_value_closes_nothing():
    body = "".join(f"<p>Paragraph {i} with many words of the article in it.</p>" for i in range(5))
    assert "<" not in html_text.main_text(f"<body><div>{body}<p><a href=/x/>linked</a> text</p></div></body>")
    tree = html_text.parse("<a href=/x/>linked</a>")
    assert tree.children[0].children == ["linked"]


def test_scores_keep_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a text", 5, 6, 0.5)], "doc_id bigint, text string, _scores int, row int, score double")
    scored = quality.with_scores(docs, quality.CoTrained(0.25)).first()
    assert (scored._scores, scored.row, scored.score, scored.content_score) == (5, 6, 0.25, 0.25)
    assert quality.with_scores(docs.limit(0), quality.CoTrained(0.25)).count() == 0
