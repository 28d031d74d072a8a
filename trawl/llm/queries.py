"""The numbered queries over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.catalog.registry import query
from trawl.llm import conversations, fingerprints, host_rules, html_text, mixing, neighbours, packing, quality, simhash, substrings, token_counts, urls, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_vocabulary() -> str:
    """Path of the public word-level BPE vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op10_simhash_near_duplicates")
def op10_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its 3-word SimHash and the smallest document it is linked to."""
    groups = simhash.near_duplicate_groups(_table(spark, sf_dir, "documents"), words=3, max_bits=2)
    return groups.select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )


_MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5('42|' || coalesce(doc_id::VARCHAR, '')) AS k
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS weight
  FROM sized GROUP BY source),
filled AS (
  SELECT *, row_number() OVER w AS place,
    1.5::DOUBLE * (SELECT sum(size) FROM sources)::DOUBLE - coalesce(sum(2.0::DOUBLE * size) OVER b, 0) AS rest,
    (sum(weight) OVER ())::BIGINT - coalesce(sum(weight) OVER b, 0)::BIGINT AS free
  FROM sources
  WINDOW w AS (ORDER BY 2.0::DOUBLE * size / weight, source),
    b AS (ORDER BY 2.0::DOUBLE * size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT rest, free, place FROM filled WHERE rest * weight <= 2.0::DOUBLE * size * free ORDER BY place LIMIT 1),
goals AS (
  SELECT f.source, f.size AS source_size,
    CASE WHEN f.place < l.place THEN 2.0::DOUBLE * f.size ELSE l.rest * f.weight / l.free END AS target
  FROM filled f, level l),
planned AS (
  SELECT s.doc_id, s.size, g.source_size, g.target,
    (CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size) ELSE 0 END)::BIGINT AS whole,
    round(g.target)::BIGINT AS goal,
    (sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - s.size)::BIGINT AS ahead
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
  (whole * size + least(greatest(goal - whole * source_size - ahead, 0), size))::BIGINT AS taken
FROM planned
"""


@query("op6_mix_sources", _MIX_SQL)
def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken from every document when sources weigh 5, 2, 1 and share 150 % of all words, twice at most."""
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), weights=[5, 2, 1], share=1.5, max_epochs=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query("op8_repeated_substrings")
def op8_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 200-byte strings that start elsewhere, too."""
    left = substrings.without_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), length=200, output="digest")
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.col("kept").alias("kept_sha256"))


@query("op1_pack_documents")
def op1_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents"), word_vocabulary(), size=4096)


@query("op5_quality_scores")
def op5_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of good quality of every document by its words, by its metadata, and by both."""
    scored = quality.cotrained_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "content_score", "metadata_score", "score", (F.col("score") >= 0.5).alias("keep"))


@query("op9_main_text")
def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article text of every page."""
    pages = html_text.with_main_text(_table(spark, sf_dir, "pages"), out="main_text")
    return pages.select("page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("bigint").alias("n_chars"))


#: (host, path, verdict)
_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


@query("op7_url_verdicts")
def op7_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict."""
    judged = urls.url_verdicts(_table(spark, sf_dir, "pages"), urls.rules_frame(spark, _RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict", "trust", "distrust")


@query("op4_version_fingerprints")
def op4_version_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they are."""
    return fingerprints.edited_likeness(_table(spark, sf_dir, "documents"))


def byte_vocabulary() -> str:
    """Path of the public byte-level BPE ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@query("op3_edited_token_counts")
def op3_edited_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document before and after three edits of its text.

    At a third the first 24 characters are put in once more; then 40 characters
    from the middle go; then 20 characters at three quarters become the word "edit".
    """
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    n = F.coalesce(F.char_length("text"), F.lit(0)).cast("bigint")

    def change(start, length: int, text):
        return F.struct(F.floor(start).alias("start"), (F.floor(start) + length).alias("stop"), text.alias("text"))

    edits = F.array(change(n / 3, 0, F.substring("text", 1, 24)), change(n / 2, 40, F.lit("")), change(n * 0.75, 20, F.lit("edit")))
    counted = token_counts.with_edit_counts(docs, byte_vocabulary(), edits)
    c = F.col("token_counts")
    return counted.select("doc_id", c["tokens"].alias("tokens"), c["edited_tokens"].alias("edited_tokens"), c["encoded_chars"].alias("encoded_chars"), F.sha2(c["edited"].cast("binary"), 256).alias("edited_sha256"))


@query("op2_nearest_vectors")
def op2_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest other vectors of every 50th vector."""
    vectors = _table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, F.col("vec_id") % 50 == 0, k=5).select("query_id", "rank", "vec_id", "score")


@query("op13_repaired_conversations")
def op13_repaired_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, least-cost edits and the repaired text's digest of every damaged conversation."""
    return conversations.repair(conversations.damaged(_table(spark, sf_dir, "conversations")))


_HOST_SQL = r"""
WITH texts AS (SELECT row_number() OVER () AS i, doc_id, source, coalesce(text, '') AS text FROM documents),
split AS (
  SELECT i, doc_id, source, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, len(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM texts),
windows AS (
  SELECT i, pos, count(*) OVER (PARTITION BY i, a, b, c) AS n
  FROM (SELECT i, pos, w[pos] AS a, w[pos + 1] AS b, w[pos + 2] AS c FROM (SELECT i, w, unnest(range(1, greatest(len(w) - 1, 1))) AS pos FROM split))),
repeats AS (SELECT i, count(DISTINCT pos) AS n_repeat_words FROM (SELECT i, unnest([pos, pos + 1, pos + 2]) AS pos FROM windows WHERE n > 1) GROUP BY i),
counted AS (
  SELECT doc_id, source, len(w)::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines
  FROM split LEFT JOIN repeats USING (i)),
failures AS (
  SELECT source, unnest(['short', 'repeats', 'symbols', 'dup_lines']) AS rule,
    unnest([n_words < 50, 100 * n_repeat_words > 50 * n_words, 10 * n_symbols > word_chars, 10 * n_dup_lines > 3 * n_lines]) AS failed
  FROM counted WHERE source IS NOT NULL),
hosts AS (SELECT source, rule, count(*)::DOUBLE AS n, count_if(failed)::DOUBLE AS f FROM failures GROUP BY ALL),
rates AS (SELECT rule, count(*)::DOUBLE AS k, sum(n) AS n, sum(f) AS f, sum(n * n) AS nn, sum(f * f / n) AS ff, sum(f) / sum(n) AS mean FROM hosts GROUP BY rule),
prior AS (
  SELECT rule, mean, CASE WHEN n - nn / n - (k - 1) <= 0 OR mean = 0 OR mean = 1 THEN 1.0::DOUBLE / 3
    ELSE least(greatest(((ff - f * mean) / (mean * (1 - mean)) - (k - 1)) / (n - nn / n - (k - 1)), 1e-4::DOUBLE), 0.9999::DOUBLE) END AS alike
  FROM rates),
posterior AS (
  SELECT source, n, f, f + mean * (1 - alike) / alike AS a, n - f + (1 - mean) * (1 - alike) / alike AS b FROM hosts JOIN prior USING (rule)),
bad AS (
  SELECT DISTINCT source FROM posterior
  WHERE round(a / (a + b) - 2 * sqrt(a / (a + b) * (b / (a + b)) / (a + b + 1)), 9) > 0.5 AND f > 0.5 * n)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND bad.source IS NULL AS kept
FROM counted LEFT JOIN bad USING (source)
"""


@query("op12_host_rules", _HOST_SQL)
def op12_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document, whether it fails a rule, and whether it stays; a document's host is its source."""
    judged = host_rules.judge_by_host(_table(spark, sf_dir, "documents"), F.col("source"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op11_whitened_vectors")
def op11_whitened_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the 16 largest principal components, with unit variance over the distinct vectors."""
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))
