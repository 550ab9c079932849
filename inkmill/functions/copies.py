"""Texts made ready for the detectors many at a time: what text.prose_scan, text.folded and text.word_count give, in Arrow and numpy.

The patterns run in Arrow's RE2, which reads a text once whatever the pattern, as the SQL's does. Which characters are
letters and digits is told from Python's tables.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from inkmill.functions import text as T

#: Bytes of text that are worked on together, about; a longer text is a block of its own.
BLOCK = 1 << 20
#: What all that prose_scan removes holds, and its steps.
_MARKED = "---|`|>"
_STEPS = ((T.FRONT_MATTER, ""), (T.FENCE, ""), (T.INLINE_CODE, " "), (T.QUOTED, ""))
_BLANKS = (0x0B, *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_WORD, _JOINT = np.zeros(256, bool), np.zeros(256, bool)
_WORD[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_"]] = True
_JOINT[[*b"'-"]] = True


def blocks(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts, a block at a time; null counts as empty."""
    texts = texts.fill_null("")
    number = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64)) // BLOCK
    cut = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(texts)]
    yield from (texts.slice(a, b - a) for a, b in zip(cut[:-1], cut[1:], strict=True) if b > a)


def prose_scan(texts: pa.Array) -> pa.Array:
    """As text.prose_scan; the steps run on the texts that hold a mark."""
    marked = pc.match_substring_regex(texts, _MARKED)
    some = texts.filter(marked)
    if not len(some):
        return texts
    for pattern, by in _STEPS:
        some = pc.replace_substring_regex(some, pattern, by)
    return pc.replace_with_mask(texts, marked, some)


@functools.lru_cache(maxsize=1)
def _ascii() -> np.ndarray:
    """The ASCII character that stands for each character; made once a worker."""
    own = np.fromiter((unicodedata.category(chr(c))[0] in "LN" for c in range(0x110000)), bool, 0x110000)
    table = np.where(own, ord("0"), ord("#")).astype(np.uint8)
    table[:128] = np.arange(128)
    table[list(_BLANKS)] = ord(" ")
    return table


def folded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """As text.folded: the copies side by side, and where each begins and the last ends."""
    codes = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), "<u4")
    return _ascii()[codes], np.concatenate(([0], np.cumsum(pc.utf8_length(texts).to_numpy().astype(np.int64))))


def as_texts(copies: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(copies))


def word_counts(copies: np.ndarray, at: np.ndarray) -> np.ndarray:
    """As text.word_count, of texts from their copies. Without apostrophes and hyphens a word begins wherever a letter follows none."""
    kept = np.flatnonzero(~_JOINT[copies])
    word, start = _WORD[copies[kept]], np.searchsorted(kept, at)
    first = word.copy()
    first[1:] &= ~word[:-1]
    head = start[:-1][start[:-1] < start[1:]]
    first[head] = word[head]
    return np.diff(np.concatenate(([0], np.cumsum(first)))[start])
