"""Token ids of whole texts with a public word-level BPE vocabulary, word by word.

Words between white space never share tokens, so a distinct word is encoded once
and remembered for the life of the worker process; long texts are cut at white
space. Texts with characters that the plain rules below do not cover go through
the library's own pipeline.
"""

from __future__ import annotations

import re
import sys
import types
from collections.abc import Callable, Iterator

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Latin letters whose lower case is one letter of this set.
_LETTERS = "a-zA-ZÀ-ÖØ-öø-įı-ſ"
#: Characters outside the plain rules: anything but ASCII text, white space and those letters.
_OTHER = rf"[^\t-\r\x20-\x7e{_LETTERS}]"
#: Fixed pattern of the vocabulary's pre-tokens, for these characters.
_PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\s0-9{_LETTERS}]+"
_SPACE = r"[\t-\r\x20]"
_SLICE = 1 << 20


def _byte_letters() -> dict[int, int]:
    """Byte to printable letter: printable Latin-1 stands for itself, the others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}


def slices(text: str, size: int = _SLICE) -> Iterator[str]:
    """The text in parts of about `size` characters, cut before white space only."""
    space, start = re.compile(_SPACE), 0
    while len(text) - start > size:
        cut = space.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text


class Memo(dict):
    """A function's results by argument; forgets what was not used for long.

    When `most` are held they become the older half, and the half before goes;
    one that is met again moves to the newer half, so frequent ones stay.
    """

    def __init__(self, make: Callable[[str], bytes], most: int) -> None:
        super().__init__()
        self.make, self.most = make, most
        self.older: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = found
        return found


class WordEncoder:
    """encode(text) gives the ids as little-endian unsigned 32-bit numbers.

    It remembers at most 2 * `most` words between white space and as many
    pre-tokens.
    """

    def __init__(self, path: str, most: int = 500_000) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model, self.letters = self.whole.model, _byte_letters()
        self.other, self.pattern = re.compile(_OTHER), re.compile(_PIECES)
        self.words, self.pieces = Memo(self._word, most), Memo(self._piece, most)

    def _piece(self, piece: str) -> bytes:
        spelled = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(spelled)])

    def _word(self, word: str) -> bytes:
        pieces = self.pattern.findall(word.lower())
        return self.pieces[pieces[0]] if len(pieces) == 1 else b"".join(map(self.pieces.__getitem__, pieces))

    def encode(self, text: str) -> bytes:
        return b"".join(self._slice(s) for s in slices(text))

    def _slice(self, text: str) -> bytes:
        if self.other.search(text) or "<|" in text:
            import numpy as np

            ids = self.whole.encode(text, add_special_tokens=False).ids
            return np.array(ids, "<u4").tobytes()
        return b"".join(map(self.words.__getitem__, text.split()))


def process_encoder(path: str) -> WordEncoder:
    """The encoder of this process for a vocabulary, so that later tasks find the words of earlier ones.

    Task code is pickled by value, so its globals do not outlive a task; the
    process's module table does.
    """
    kept = sys.modules.setdefault("_trawl_word_encoders", types.ModuleType("_trawl_word_encoders"))
    encoders = vars(kept).setdefault("by_path", {})
    if path not in encoders:
        encoders[path] = WordEncoder(path)
    return encoders[path]
