"""Text columns: whitespace, lines, terms, names, keys and question classes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from trawl.functions import fixed_values as fv

# Unicode white space plus the four ASCII separators Java leaves out.
_SPACE = r"[\s\x1c-\x1f]"
_LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
TERM_PATTERN = r"\p{L}++\p{M}*+|\p{Nd}++"  # possessive: the classes are disjoint
WORD_PATTERN = r"(\S+\s*)"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^{_SPACE}+|{_SPACE}+\z", "")


def normalize_ws(c: Column) -> Column:
    """Collapse white space to single spaces and trim; NULL becomes ''."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), rf"(?U){_SPACE}+", " "))


def has_text(c: Column) -> Column:
    return c.rlike(r"(?U)[^\s\x1c-\x1f]")


def split_lines(c: Column) -> Column:
    """Non-blank lines of a text, as an array."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), _LINE_END), has_text)


def terms(c: Column) -> Column:
    """Raw term matches of a text; lower-case them after exploding."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(TERM_PATTERN), F.lit(0))


def tokenize_terms(c: Column) -> Column:
    """Lower-cased runs of letters (with trailing marks) or of digits."""
    return F.transform(terms(c), F.lower)


def words(c: Column) -> Column:
    """Lossless word tokens: each keeps the white space after it."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(WORD_PATTERN), F.lit(1))


def sanitize_filename(c: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"[^a-zA-Z0-9_.-]+", "_")


def stem(c: Column) -> Column:
    """File name without its last extension; leading dots are no extension."""
    return F.regexp_replace(c, r"^(\.*[^.].*)\.[^.]*$", "$1")


def normalize_session_id(c: Column) -> Column:
    sid = strip(c)
    unsafe = sid.contains("..") | sid.contains("/") | sid.contains("\\")
    return (
        F.when(sid == "", None)
        .when(sid.rlike(r"^[0-9a-fA-F]{32}\z"), sid)
        .when(~unsafe, sid)
    )


def question_error(question: Column, session: Column) -> Column:
    """NULL for a valid question, else the message of the first failed rule."""
    q = strip(F.coalesce(question, F.lit("")))
    return (
        F.when(q == "", fv.MSG_BLANK_QUESTION)
        .when(F.length(q) > fv.MAX_QUESTION_CHARS, fv.MSG_LONG_QUESTION)
        .when(normalize_session_id(session).isNull(), fv.MSG_BAD_SESSION)
    )


def contains_any(c: Column, phrases: list[str]) -> Column:
    """True when ``c`` holds one of the phrases; stays inside generated code."""
    return reduce(lambda a, b: a | b, [c.contains(p) for p in phrases])


def is_summary_question(c: Column, phrases: list[str] = fv.SUMMARY_PHRASES) -> Column:
    return contains_any(F.lower(F.coalesce(c, F.lit(""))), phrases)


def question_type(c: Column, types: dict[str, list[str]] = fv.QUESTION_TYPES) -> Column:
    q = F.lower(F.coalesce(c, F.lit("")))
    chain = reduce(
        lambda acc, kv: acc.when(contains_any(q, kv[1]), kv[0]), types.items(), F
    )
    return chain.otherwise(fv.DEFAULT_QUESTION_TYPE)


def reasoning_guide(kind: Column, guides: dict[str, str] = fv.REASONING_GUIDES) -> Column:
    """Guide text of a question type; a literal map, so no join is needed."""
    table = F.create_map(*[F.lit(x) for kv in guides.items() for x in kv])
    return F.coalesce(F.try_element_at(table, kind), F.lit(guides[fv.DEFAULT_QUESTION_TYPE]))


def truncate(c: Column, limit: int, keep: int | None = None) -> Column:
    """Texts over ``limit`` characters are cut to ``keep`` plus an ellipsis."""
    kept = F.substring(c, 1, limit if keep is None else keep)
    return F.when(F.length(c) > limit, F.concat(kept, F.lit("…"))).otherwise(c)


def sha1_key(c: Column) -> Column:
    return F.sha1(F.coalesce(c, F.lit("")).cast("binary"))


def sha256_key(c: Column) -> Column:
    return F.sha2(F.coalesce(c, F.lit("")).cast("binary"), 256)


def answer_key(question: Column, docs: Column) -> Column:
    """Cache key: folded question, two bars, sorted distinct document names."""
    names = F.array_join(F.array_sort(F.array_distinct(docs)), ",")
    return F.concat(F.lower(normalize_ws(question)), F.lit("||"), names)


def keyword_match(answer: Column, expected: Column) -> Column:
    text = F.lower(F.coalesce(answer, F.lit("")))
    return F.exists(expected, lambda k: text.contains(F.lower(k)))
