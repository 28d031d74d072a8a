"""Column functions on edge cases and worked numbers."""

import math

import pytest
from pyspark.sql import functions as F

from trawl.functions import scores, text, vectors


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_fusion_examples(spark):
    assert one(spark, scores.fuse(F.lit(0.85), F.lit(0.30), 0.6)) == pytest.approx(0.52)
    assert one(spark, scores.fuse(F.lit(0.60), F.lit(0.90), 0.6)) == pytest.approx(0.78)


def test_boost_examples(spark):
    assert one(spark, scores.recency_boost(F.lit(0.85), F.lit(1.0), 0.3)) == pytest.approx(0.895)
    assert one(spark, scores.recency_boost(F.lit(0.85), F.lit(0.74), 0.3)) == pytest.approx(0.817)
    day, now = 86400.0, 1e9
    for score, age, want in ((0.85, 60, 0.6356), (0.70, 3, 0.7615)):
        recency = scores.recency_score(F.lit(now - age * day), F.lit(now))
        assert one(spark, scores.recency_boost(F.lit(score), recency, 0.3)) == pytest.approx(want, abs=1e-4)


def test_whitespace_is_unicode(spark):
    raw = "  a  b\x1c\tc \x85"
    assert one(spark, text.normalize_ws(F.lit(raw))) == " ".join(raw.split())
    assert one(spark, text.normalize_ws(F.lit(None).cast("string"))) == ""
    assert one(spark, text.strip(F.lit(" x y\n"))) == "x y"


def test_lines_match_python(spark):
    raw = "a\r\n b \x0b\x0cc\x1c\x1d\x1ed\x85e f  \n\n  \ng"
    want = [line for line in raw.splitlines() if line.strip()]
    assert one(spark, text.split_lines(F.lit(raw))) == want


def test_terms_keep_marks_and_split_digits(spark):
    raw = "Ti\u1ebfng VI\u1ec6T abc12x \u0663\u0664 \u0301z e\u0301a"
    got = one(spark, text.tokenize_terms(F.lit(raw)))
    # A combining mark ends its run of letters.
    assert got == ["ti\u1ebfng", "vi\u1ec7t", "abc", "12", "x", "\u0663\u0664", "z", "e\u0301", "a"]


@pytest.mark.parametrize(
    "name,want",
    [("a.b.pdf", "a.b"), (".bashrc", ".bashrc"), ("..x.pdf", "..x"), ("noext", "noext"), ("x.", "x"), ("...", "...")],
)
def test_stem(spark, name, want):
    assert one(spark, text.stem(F.lit(name))) == want


@pytest.mark.parametrize("raw,want", [("  ", None), ("a/b", None), ("a\\b", None), ("x..y", None), (" ab ", "ab"), ("f" * 32, "f" * 32), (None, None)])
def test_session_ids(spark, raw, want):
    assert one(spark, text.normalize_session_id(F.lit(raw).cast("string"))) == want


def test_question_type_order(spark):
    assert one(spark, text.question_type(F.lit("So sánh cách làm"))) == "comparison"
    assert one(spark, text.question_type(F.lit("window"))) == "causal"  # holds the substring "do"
    assert one(spark, text.question_type(F.lit(None).cast("string"))) == "general"


def test_probability_and_sigmoid(spark):
    for v, want in ((None, 0), (60.0, 1), (-60.0, 0), (0.4, 0.4), (2.0, 1 / (1 + math.exp(-2))), (-0.5, 0.25), (-3.0, 0)):
        assert one(spark, scores.score_to_probability(F.lit(v).cast("double"))) == pytest.approx(want)
    assert one(spark, scores.sigmoid(F.lit(None).cast("double"), True)) == 0


def test_age_bucket(spark):
    now = 1e9
    for days, want in ((0.5, ("today", 0)), (1.2, ("yesterday", 1)), (6.9, ("days", 6)), (20, ("weeks", 2)), (200, ("months", 6)), (800, ("years", 2))):
        assert tuple(one(spark, scores.age_bucket(F.lit(now - days * 86400), F.lit(now)))) == want
    assert one(spark, scores.age_bucket(F.lit(None).cast("double"), F.lit(now))) is None


def test_l2_normalize_zero_vector(spark):
    v = F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, vectors.l2_normalize(v)) == [0.0, 0.0]
