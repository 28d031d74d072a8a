"""URL verdicts by rules, and by the link graph where no rule fits.

Trust spreads from hosts with allowed pages along links, as a personalised
PageRank; distrust spreads from hosts with blocked pages against the links, to
those who link to them. A threshold on the balance judges a host.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.session import drop_stages, stage_table, staged

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """Between the first :// and the next /, ? or #, A-Z lower-cased; '' for null or no ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """Behind the host up to ? or #; '' for null or no ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _suffixes(host: Column) -> Column:
    """The host and all domains above it."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def rules_frame(spark, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "rule_host string, rule_path string, verdict string")


def judged_by_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """pages with (host, path) get (rule, rule_verdict) of the longest rule that fits, null if none does.

    A rule fits its host and all subdomains if the path starts with its own; of
    equally long ones the first by code point counts. Hosts meet the rules once
    each, however many pages they have.
    """
    texts = rules.select(
        "rule_host", "rule_path", F.concat("rule_host", "rule_path").alias("rule"), F.col("verdict").alias("rule_verdict")
    ).dropDuplicates(["rule"])
    hosts = pages.select("host").filter("host <> ''").distinct().withColumn("rule_host", F.explode(_suffixes(F.col("host"))))
    found = hosts.join(texts, "rule_host").groupBy("host").agg(
        F.array_sort(F.collect_list(F.struct((-F.char_length("rule")).alias("n"), "rule", "rule_path", "rule_verdict"))).alias("_rules")
    )
    fitting = F.filter("_rules", lambda r: F.col("path").startswith(r["rule_path"]))
    best = F.when(F.col("_rules").isNotNull(), F.get(fitting, F.lit(0)))
    return pages.join(found, "host", "left").withColumns({"rule": best["rule"], "rule_verdict": best["rule_verdict"]}).drop("_rules")


def host_links(pages: DataFrame, html: str = "html", subdomains: bool = True) -> DataFrame:
    """(a, b): distinct host edges a -> b: absolute links in the pages, and each host to the domain above it.

    Links to the own host are no edges. Domains above a host end at two labels.
    """
    targets = F.regexp_extract_all(F.col(f"`{html}`"), F.lit(r"(?is)<a\s[^>]*?href\s*=\s*[\"']?\s*((?:https?:)?//[^\"'\s>]+)"), F.lit(1))
    linked = pages.select(F.col("host").alias("a"), F.explode(targets).alias("link"))
    linked = linked.select("a", host_of(F.concat(F.lit("x:"), F.regexp_replace("link", "^[a-zA-Z]+:", ""))).alias("b"))
    edges = linked.distinct()
    if subdomains:
        known = pages.select(F.col("host").alias("a")).union(edges.select(F.col("b").alias("a"))).distinct()
        chain = known.select(F.explode(_suffixes(F.col("a"))).alias("a")).distinct()
        above = F.regexp_extract("a", r"^[^.]*\.(.*\..*)$", 1)
        edges = edges.union(chain.select("a", above.alias("b"))).distinct()
    return edges.filter("a <> b and a <> '' and b <> ''")


def spread(seeds: DataFrame, links: DataFrame, damping: float = 0.85, rounds: int | None = None, tolerance: float = 1e-4) -> DataFrame:
    """(host, trust, distrust): seeds' trust along the links and their distrust against them.

    Each round a host hands `damping` of its trust to the hosts it links to and of
    its distrust to those that link to it, in equal parts, and gets the rest of
    its own seed back; who has nobody to hand it to keeps it. Ends when no value
    of any host can be farther than `tolerance`, an absolute number in the unit of
    the seeds, from where the rounds lead, so other seeds do not end it early.
    What a host keeps is summed up at once, which leads to the same values; without
    circles of links the values are then final after as many rounds as the longest
    chain has links. With `rounds`, what is kept goes round as well and at most so
    many rounds are done. A round's values are a written table, deleted after the
    next; the driver sees one number a round.
    """
    if rounds is None and not (tolerance > 0 and 0 < damping < 1):
        raise ValueError("without rounds, tolerance must be positive and damping between 0 and 1")
    spark = seeds.sparkSession
    zero, one = F.lit(0.0), F.lit(1.0)
    nodes = seeds.select("host").union(links.select("a")).union(links.select("b")).distinct()
    out, into = links.groupBy("a").agg(F.count("*").alias("n")), links.groupBy("b").agg(F.count("*").alias("n"))
    start = nodes.join(seeds, "host", "left").fillna(0.0, ["trust", "distrust"])
    start = start.join(out.select(F.col("a").alias("host"), F.col("n").alias("n_out")), "host", "left")
    start = start.join(into.select(F.col("b").alias("host"), F.col("n").alias("n_in")), "host", "left")
    # dt, dd: what a value is divided by, 1 - damping where all of it is kept and that is summed up at once.
    kept = lambda n: F.when(F.col(n).isNull(), 1 - damping).otherwise(one) if rounds is None else one
    start = stage_table(start.select("host", F.col("trust").alias("t0"), F.col("distrust").alias("d0"), kept("n_out").alias("dt"), kept("n_in").alias("dd")))
    hands = links.join(out, "a").select("a", "b", (1 / F.col("n")).alias("wt"), zero.alias("wd")).union(
        links.join(into, "b").select(F.col("b").alias("a"), F.col("a").alias("b"), zero, 1 / F.col("n"))
    )
    if rounds is not None:
        hands = hands.union(nodes.join(out.withColumnRenamed("a", "host"), "host", "left_anti").select("host", "host", one, zero)).union(
            nodes.join(into.withColumnRenamed("b", "host"), "host", "left_anti").select("host", "host", zero, one)
        )
    hands = stage_table(hands)
    total = start.agg(F.coalesce(F.sum(F.col("t0") + F.col("d0")), zero).alias("n")).first().n
    now = start.select("host", F.col("t0").alias("trust"), F.col("d0").alias("distrust"), "dt", "dd")
    # All changes of a round sum up to at most `damping` times those of the round before.
    enough = tolerance * (1 - damping) ** 2
    if rounds is None:
        rounds = max(1, math.ceil(math.log(enough / (2 * total)) / math.log(damping))) if total else 0
    others = staged(spark)
    for _ in range(rounds):
        moved = hands.join(now, hands["a"] == now["host"]).groupBy("b").agg(
            F.sum(F.col("trust") * F.col("wt")).alias("t"), F.sum(F.col("distrust") * F.col("wd")).alias("d")
        )
        after = start.join(moved, start["host"] == moved["b"], "left").select(
            "host", (((1 - damping) * F.col("t0") + damping * F.coalesce("t", zero)) / F.col("dt")).alias("trust"),
            (((1 - damping) * F.col("d0") + damping * F.coalesce("d", zero)) / F.col("dd")).alias("distrust"), "dt", "dd",
        )
        after = stage_table(after)
        old = now.select("host", F.col("trust").alias("ot"), F.col("distrust").alias("od"))
        changes = F.abs(F.col("trust") - F.col("ot")) * F.col("dt") + F.abs(F.col("distrust") - F.col("od")) * F.col("dd")
        change = after.join(old, "host").agg(F.sum(changes).alias("m")).first().m
        now = after
        drop_stages(spark, among=[n for n in staged(spark) if n not in others][:-1])
        if change is None or damping * change <= enough:
            break
    return now.select("host", "trust", "distrust")


def url_verdicts(
    pages: DataFrame, rules: DataFrame, url: str = "url", html: str = "html", key: str = "page_id", block_share: float = 0.5, **options
) -> DataFrame:
    """(key, host, path, rule, verdict, trust, distrust): one row per row of pages.

    The rule's verdict counts where a rule fits. Elsewhere the host is judged: its
    seeds are the numbers of its pages that rules allow and block, spread over
    the host edges, and it is blocked if distrust makes up more than
    `block_share` of trust, distrust and its pages without a rule. Hosts without
    any evidence, and urls without a host, are allowed; for the latter, trust and
    distrust are 0. Null urls have empty host and path. Repeated rows are judged
    alike and all count. An empty table gives no rows; other columns are ignored.
    """
    parts = pages.select(F.col(f"`{key}`").alias("key"), host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))
    judged = stage_table(judged_by_rules(parts, rules))
    count = lambda what: F.count_if(what).cast("double")
    seeds = stage_table(judged.filter("host <> ''").groupBy("host").agg(
        count(F.col("rule_verdict") == "allow").alias("trust"), count(F.col("rule_verdict") == "block").alias("distrust"),
        count(F.col("rule").isNull()).alias("open"),
    ))
    links = stage_table(host_links(pages.select(host_of(F.col(f"`{url}`")).alias("host"), F.col(f"`{html}`").alias("html"))))
    scores = spread(seeds.select("host", "trust", "distrust"), links, **options)
    blocked = F.col("distrust") > block_share * (F.col("trust") + F.col("distrust") + F.col("open"))
    hosts = seeds.select("host", "open").join(scores, "host").select("host", "trust", "distrust", F.when(blocked, "block").otherwise("allow").alias("host_verdict"))
    zero = F.lit(0.0)
    return judged.join(hosts, "host", "left").select(
        F.col("key").alias(key), "host", "path", "rule", F.coalesce("rule_verdict", "host_verdict", F.lit("allow")).alias("verdict"),
        F.coalesce("trust", zero).alias("trust"), F.coalesce("distrust", zero).alias("distrust"),
    )
