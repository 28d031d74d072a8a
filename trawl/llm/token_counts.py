"""Token counts that follow edits without encoding the whole text again.

A byte-level BPE vocabulary never merges across its pre-tokens, so a text's count
is the sum over its pre-tokens. Each document keeps a segment tree whose leaves
are runs of pre-tokens with their characters and tokens. An edit encodes the
leaves it touches, from the one two characters before it until a pre-token
ends where an untouched leaf ends, and updates the sums above them.
"""

from __future__ import annotations

import base64
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Pre-tokens in a leaf of a new tree.
LEAF = 32
_SLICE = 1 << 20
#: Unicode white space, and the pre-token pattern of the vocabulary.
_WS = r"\t-\r \x85\xa0  -     　"
_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"


class Counter:
    """Tokens of pre-tokens, each distinct one encoded once; `path` is a file of BPE ranks."""

    def __init__(self, path: str, most: int = 400_000) -> None:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern, self.cut = regex.compile(_PATTERN), regex.compile(rf"(?<=[^{_WS}])[{_WS}]")
        self.known: dict[str, int] = {}
        self.most = most

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens in order, by slices that end before white space."""
        start = 0
        while start < len(text):
            cut = self.cut.search(text, start + _SLICE) if len(text) - start > _SLICE else None
            end = cut.start() if cut else len(text)
            yield self.pattern.findall(text[start:end])
            start = end

    def counts(self, pieces: list[str]) -> list[int]:
        known = self.known
        new = set(pieces).difference(known)
        if new:
            if len(known) + len(new) > self.most:
                known.clear()
                new = set(pieces)
            encode = self.encoding.encode_ordinary
            known.update((p, len(encode(p))) for p in new)
        return list(map(known.__getitem__, pieces))


class Tree:
    """A segment tree over leaves (characters, tokens); node i has the children 2i and 2i + 1."""

    def __init__(self, chars: Iterable[int], tokens: Iterable[int]) -> None:
        own = np.array([list(chars), list(tokens)], np.int64)
        self.leaves = own.shape[1]
        self.base = 1 << max(0, (max(self.leaves, 1) - 1).bit_length())
        self.sums = np.zeros((2, 2 * self.base), np.int64)
        self.sums[:, self.base : self.base + self.leaves] = own
        width = self.base
        while width > 1:
            self.sums[:, width // 2 : width] = self.sums[:, width : 2 * width].reshape(2, -1, 2).sum(axis=2)
            width //= 2

    @property
    def chars(self) -> int:
        return int(self.sums[0, 1])

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def find(self, place: int) -> tuple[int, int]:
        """(leaf, its first character) of the character at `place`, the last one with characters if it is behind the end."""
        at, before, sums = 1, 0, self.sums[0]
        place = max(0, min(place, self.chars - 1))
        while at < self.base:
            at *= 2
            if place - before >= sums[at]:
                before += int(sums[at])
                at += 1
        return at - self.base, before

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        at = self.base + leaf
        change = np.array([chars, tokens]) - self.sums[:, at]
        while at:
            self.sums[:, at] += change
            at //= 2


def build(text: str, counter: Counter, leaf: int = LEAF) -> Tree:
    """The tree of a whole text."""
    chars: list[np.ndarray] = []
    tokens: list[np.ndarray] = []
    for pieces in counter.pieces(text):
        heads = np.arange(0, len(pieces), leaf)
        if len(heads):
            chars.append(np.add.reduceat(np.fromiter(map(len, pieces), np.int64, len(pieces)), heads))
            tokens.append(np.add.reduceat(np.array(counter.counts(pieces), np.int64), heads))
    none = [np.zeros(0, np.int64)]
    return Tree(np.concatenate(chars or none), np.concatenate(tokens or none))


def edit(text: str, tree: Tree, counter: Counter, start: int, stop: int, new: str) -> tuple[str, Tree, int]:
    """(text, tree, characters encoded) after text[start:stop] became `new`; the tree is changed in place.

    A pre-token depends on its own characters and the next two, so all that ends
    two characters before the edit stays. Behind the edit, everything is as
    it was from the first pre-token on that begins where a leaf begins.
    """
    start = max(0, min(start, len(text)))
    stop = max(start, min(stop, len(text)))
    edited, shift = text[:start] + new + text[stop:], len(new) - (stop - start)
    if not tree.chars:
        return edited, build(edited, counter), len(edited)
    first, begin = tree.find(start - 2)
    last, at = tree.find(start)
    end = at + int(tree.sums[0, tree.base + last])
    place, tokens = begin, 0
    while place < len(edited):
        pieces = []
        for m in counter.pattern.finditer(edited, place):
            pieces.append(m[0])
            place = m.end()
            while end + shift < place and end < len(text):
                last += 1
                end += int(tree.sums[0, tree.base + last])
            if (end >= stop and place == end + shift) or len(pieces) == 4096:
                break
        tokens += sum(counter.counts(pieces))
        if end >= stop and place == end + shift:
            break
    else:
        last, end = tree.leaves - 1, len(text)
    tree.put(first, place - begin, tokens)
    for leaf in range(first + 1, last + 1):
        if tree.sums[0, tree.base + leaf] or tree.sums[1, tree.base + leaf]:
            tree.put(leaf, 0, 0)
    return edited, tree, place - begin


def with_edit_counts(docs: DataFrame, vocabulary: str, edits: Column, text: str = "text") -> DataFrame:
    """docs with token_counts: struct<edited string, tokens, edited_tokens, encoded_chars, leaves, tree_chars array, tree_tokens array>.

    edits is an array of struct<start, stop, text>, applied one after another,
    each to the text the one before left; places are code points and are moved
    into the text where they lie outside, null texts insert nothing. The tree
    after the edits is returned by its leaves, so that `Tree(chars, tokens)` and
    `edit` carry on from it. A null text counts as empty, null edits as none.
    Rows are independent. A column named token_counts is replaced.
    """

    def counted(texts: pa.Array, changes: pa.Array) -> pa.Array:
        counter, out = Counter(vocabulary), []
        for value, steps in zip(texts, changes):
            now = value.as_py() or ""
            tree = build(now, counter)
            tokens, encoded = tree.tokens, 0
            for step in steps.as_py() or []:
                now, tree, n = edit(now, tree, counter, step["start"] or 0, step["stop"] or 0, step["text"] or "")
                encoded += n
            leaves = tree.sums[:, tree.base : tree.base + tree.leaves]
            out.append({"edited": now, "tokens": tokens, "edited_tokens": tree.tokens, "encoded_chars": encoded, "leaves": tree.leaves, "tree_chars": leaves[0], "tree_tokens": leaves[1]})
        long = pa.int64()
        kind = pa.struct([("edited", pa.string()), ("tokens", long), ("edited_tokens", long), ("encoded_chars", long), ("leaves", long), ("tree_chars", pa.list_(long)), ("tree_tokens", pa.list_(long))])
        return pa.array(out, kind)

    kind = "struct<edited:string,tokens:bigint,edited_tokens:bigint,encoded_chars:bigint,leaves:bigint,tree_chars:array<bigint>,tree_tokens:array<bigint>>"
    return docs.withColumn("token_counts", F.arrow_udf(counted, kind)(F.col(f"`{text}`"), edits))
