"""Patterns, words and ASCII copies of whole texts, as Columns that are worked out in Arrow batches.

For queries that try dozens of patterns on every text. RE2 reads a text once a pattern, from the first character to the
last; lookbehinds it doesn't have. Inside lambdas the functions of text are used.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType

from inkmill.functions import copies

_BLANK, _SMALL, _LARGE, _END = (np.zeros(256, bool) for _ in range(4))
_BLANK[[*b"\t\n\x0b\f\r "]] = _SMALL[[*b"abcdefghijklmnopqrstuvwxyz"]] = _LARGE[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = _END[[*b".!?"]] = True
#: Stands behind each match while matches are counted.
_MARK = "\x01"


def _all(parts: Iterable[np.ndarray], kind: type) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *parts])


def _valid(texts: pa.Array, values: np.ndarray) -> pa.Array:
    """The values, null where the text is."""
    return pa.array(values, mask=~texts.is_valid().to_numpy(zero_copy_only=False))


def _of_copies(texts: pa.Array, of: Callable[[np.ndarray, np.ndarray], np.ndarray], kind: type = np.int64) -> np.ndarray:
    return _all((of(*copies.folded(some)) for some in copies.blocks(texts)), kind)


@arrow_udf(StringType())
def folded(text: pa.Array) -> pa.Array:
    """As text.folded."""
    made = pa.concat_arrays([pa.array([], pa.string()), *(copies.as_texts(*copies.folded(some)) for some in copies.blocks(text))])
    return pc.if_else(text.is_valid(), made, pa.scalar(None, pa.string()))


@arrow_udf(LongType())
def word_count(text: pa.Array) -> pa.Array:
    """As text.word_count."""
    return _valid(text, _of_copies(text, copies.word_counts))


@arrow_udf(LongType())
def blank_words(text: pa.Array) -> pa.Array:
    """As text.blank_words: a copy has blanks for all white space."""

    def count(own: np.ndarray, at: np.ndarray) -> np.ndarray:
        first = ~_BLANK[own]
        inside = first.copy()
        first[1:] &= ~inside[:-1]
        head = at[:-1][at[:-1] < at[1:]]
        first[head] = inside[head]
        return np.diff(np.concatenate(([0], np.cumsum(first)))[at])

    return _valid(text, _of_copies(text, count))


def times(text: Column, pattern: str) -> Column:
    """How often the pattern occurs; null in null."""

    @arrow_udf(IntegerType())
    def run(texts: pa.Array) -> pa.Array:
        count = lambda some: pc.count_substring(some, _MARK).to_numpy()
        # counting as such goes on after a match as if the text began there
        found = (count(pc.replace_substring_regex(some, f"({pattern})", rf"\1{_MARK}")) - count(some) for some in copies.blocks(texts))
        return _valid(texts, _all(found, np.int32).astype(np.int32))

    return run(text)


def held(text: Column, patterns: tuple[str, ...]) -> Column:
    """Which of the patterns occur, by their places from 0; none in null."""

    @arrow_udf(ArrayType(IntegerType()))
    def run(texts: pa.Array) -> pa.Array:
        own = [np.stack([pc.match_substring_regex(some, p).to_numpy(zero_copy_only=False) for p in patterns], axis=1) for some in copies.blocks(texts)]
        there = np.concatenate([np.zeros((0, len(patterns)), bool), *own])
        at = np.concatenate(([0], np.cumsum(there.sum(axis=1)))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(at), pa.array(np.nonzero(there)[1].astype(np.int32)))

    return run(text)


@arrow_udf(DoubleType())
def lowercase_ratio(plain: pa.Array) -> pa.Array:
    """Of the letters that begin a line or follow a sentence's end and a blank in ASCII texts, how many are small; 0 without any."""

    def share(own: np.ndarray, at: np.ndarray) -> np.ndarray:
        letter = _SMALL[own] | _LARGE[own]
        begins = np.zeros(len(own), bool)
        begins[1:] = own[:-1] == ord("\n")
        behind = np.zeros(len(own), bool)
        behind[2:] = _END[own[:-2]] & _BLANK[own[1:-1]]
        first = at[:-1][at[:-1] < at[1:]]
        behind[first] = False
        second = first[np.diff(at)[np.diff(at) > 0] > 1] + 1
        behind[second] = False
        begins[first] = True
        starts = letter & (begins | behind)
        small, total = (np.diff(np.concatenate(([0], np.cumsum(x)))[at]) for x in (starts & _SMALL[own], starts))
        return small / np.maximum(total, 1)

    return pa.array(_of_copies(plain, share, float))
