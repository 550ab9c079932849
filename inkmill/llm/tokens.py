"""Token ids of many texts.

The tokenizer splits a lower-cased text at white space and within the runs between into
words, and encodes each word for itself, so equal runs have equal ids. For texts of plain
characters (Latin letters below U+0250, no apostrophe, ordinary white space) a table keeps
the ids of the runs that were seen, and the words of new runs go to the tokenizer's model. All
other texts, and those that hold an added token (<|endoftext|>), go to the tokenizer as they are.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from array import array

import numpy as np

#: Runs that the table holds at most.
CACHE_RUNS = 400_000
_PROBE = "Probe 12ab, (c)d--x\n\u00e9t\u00c9 na\u00efve\u017f\u0142 \u00b0\u00bd ..! Zz_9"
_TOP = 0x250


def _classes() -> tuple[str, str, str, str]:
    """Letters, digits, white space and odd characters below U+0250, as members of pattern classes."""
    letters, digits, odd = [], [], [*range(0x09), 0x0B, 0x0C, *range(0x0E, 0x20), *range(0x7F, 0xA1), 0x27, 0xAD]
    for c in range(_TOP):
        low = chr(c).lower()
        if len(low) != 1 or ord(low) >= _TOP:
            odd.append(c)
        elif unicodedata.category(chr(c))[0] == "L":
            letters.append(c)
        elif unicodedata.category(chr(c))[0] == "N":
            digits.append(c)
    return tuple("".join(f"\\u{c:04x}" for c in kind) for kind in (letters, digits, (0x20, 0x09, 0x0A, 0x0D), odd))


_LETTER, _DIGIT, _SPACE, _ODD = _classes()
_odd_in = re.compile(f"[{_ODD}\\u{_TOP:04x}-\\U0010ffff]").search
_words_of = re.compile(f"[{_LETTER}]+|[{_DIGIT}]|[^{_LETTER}{_DIGIT}{_SPACE}]+").findall


def byte_letters() -> dict[int, str]:
    """The character that byte-level vocabularies write for each byte: itself where it is printable, else one from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) if b in shown else chr(256 + rest.index(b)) for b in range(256)}


_LETTERS = byte_letters()


class _Words(dict):
    """The ids of words, from the tokenizer's model."""

    def __init__(self, model):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> bytes:
        spelt = word if word.isascii() else word.encode().decode("latin-1").translate(_LETTERS)
        self[word] = ids = array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()
        return ids


class _Runs(dict):
    """The ids of runs of anything but white space."""

    def __init__(self, words: _Words):
        super().__init__()
        self.words = words

    def __missing__(self, run: str) -> bytes:
        own = _words_of(run)
        self[run] = ids = self.words[own[0]] if len(own) == 1 else b"".join([self.words[w] for w in own])
        return ids


class WordCache:
    """The tokenizer, and the ids of runs that it has encoded, as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Contents of added tokens, which the tokenizer matches in the text before it splits words.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words = _Words(self.tokenizer.model)
        self.known = _Runs(self.words)
        #: Whether this tokenizer splits and spells words as described here; one that doesn't encodes all texts itself.
        self.splits = self._ids(_PROBE) == self.encode(_PROBE)

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _ids(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, text.lower().split()))

    def ids(self, text: str | None) -> bytes:
        """The ids of a text; null counts as empty."""
        if not text:
            return b""
        if not self.splits or _odd_in(text) or any(x in text for x in self.added):
            return self.encode(text)
        if len(self.known) > CACHE_RUNS:
            self.known.clear()
            self.words.clear()
        return self._ids(text)


@functools.lru_cache(maxsize=1)
def word_cache(path: str) -> WordCache:
    """One tokenizer and table a worker process: tasks that follow one another don't load it again."""
    return WordCache(path)
