"""Rhythm and range of a text as Column expressions; lexical diversity in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import DoubleType

from inkmill.functions.text import TOKEN

# Fixed values.
MTLD_THRESHOLD, MTLD_TOKENS, MTLD_LEAST = 0.72, 100, 1e-9
OPENING_WORDS, FLAT_TOLERANCE, FLAT_SENTENCES = 2, 2, 4


def rounded(value: Column | str, places: int) -> Column:
    """A double to so many places as SQL has it: half up, away from zero, of the value times a power of ten."""
    scale = 10.0**places
    return F.round((F.col(value) if isinstance(value, str) else value) * scale) / scale


def rate(count: Column, words: Column) -> Column:
    """In 1,000 words, to two places; 0 without words."""
    return F.when(words == 0, F.lit(0.0)).otherwise(rounded(count * 1000.0 / F.nullif(words, F.lit(0)), 2))


def lengths(segments: Column) -> Column:
    return F.transform(segments, lambda s: F.regexp_count(s, F.lit(TOKEN)).cast("long"))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def mean_length(values: Column) -> Column:
    """To one place; null without values."""
    return rounded(F.try_divide(total(values), F.size(values)), 1)


def variation(values: Column) -> Column:
    """The population's standard deviation over the mean, to three places; null under three values or where the mean is 0.

    From whole-number sums, so that it doesn't depend on the order of the values.
    """
    n, s, q = F.size(values).cast("long"), total(values), total(F.transform(values, lambda x: x * x))
    return F.when(n >= 3, rounded(F.try_divide(F.sqrt((n * q - s * s).cast("double")), s.cast("double")), 3))


def longest_flat_run(values: Column) -> Column:
    """The longest run of neighbours that differ by two words at most; 0 under four sentences."""
    start = F.struct(F.lit(0).cast("long").alias("best"), F.lit(0).cast("long").alias("run"), F.lit(None).cast("long").alias("last"))

    def step(state: Column, x: Column) -> Column:
        run = F.when(F.abs(x - state["last"]) <= FLAT_TOLERANCE, state["run"] + 1).otherwise(F.lit(1).cast("long"))
        return F.struct(F.greatest(state["best"], run).alias("best"), run.alias("run"), x.alias("last"))

    return F.when(F.size(values) < FLAT_SENTENCES, F.lit(0).cast("long")).otherwise(F.aggregate(values, start, step, lambda s: s["best"]))


#: Tokens of each text that a round looks at, and of all texts that go through the rounds together, about.
_REACH, _TOGETHER = 64, 1 << 20


def _earlier(codes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Where each token stood last before in its row, or a place before all rows."""
    order = np.argsort(row * (int(codes.max(initial=0)) + 1) + codes, kind="stable")
    out, same = np.full(len(codes), -1), (codes[order[1:]] == codes[order[:-1]]) & (row[order[1:]] == row[order[:-1]])
    out[order[1:][same]] = order[:-1][same]
    return out


def _factors(codes: np.ndarray, row: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Factors of each row's tokens. A factor ends at the first token at which the share of types since its start is down to the threshold; what is left at the end is part of one.

    All rows go on together, a stretch of each in a round. A token is a new type if it stood last before the factor's start.
    """
    earlier, factors = _earlier(codes, row), np.zeros(len(begin))
    start, at, types, open_ = begin.copy(), begin.copy(), np.zeros(len(begin), int), np.flatnonzero(begin < end)
    step = np.arange(_REACH)
    while len(open_):
        place = at[open_, None] + step
        inside = place < end[open_, None]
        new = inside & (earlier[np.minimum(place, len(earlier) - 1)] < start[open_, None])
        so_far = types[open_, None] + np.cumsum(new, axis=1)
        down = inside & (so_far / (place - start[open_, None] + 1) <= MTLD_THRESHOLD)
        hit, first = down.any(axis=1), down.argmax(axis=1)
        done, rest = open_[hit], open_[~hit]
        factors[done] += 1
        start[done] = at[done] = at[done] + first[hit] + 1
        types[done] = 0
        types[rest], at[rest] = so_far[~hit, -1], np.minimum(at[rest] + _REACH, end[rest])
        left = rest[at[rest] == end[rest]]
        factors[left] += (1 - types[left] / (end[left] - start[left])) / (1 - MTLD_THRESHOLD)
        open_ = open_[at[open_] < end[open_]]
    return factors


def lexical_diversity(tokens: pa.ListArray) -> np.ndarray:
    """Tokens a factor, forwards and backwards, of each list; nan under MTLD_TOKENS tokens."""
    every = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(int)
    long, out = np.flatnonzero(every >= MTLD_TOKENS), np.full(len(every), np.nan)
    block = np.cumsum(every[long]) // _TOGETHER
    for own in np.split(long, np.flatnonzero(np.diff(block)) + 1) if len(long) else []:
        size = every[own]
        codes = tokens.take(pa.array(own)).flatten().dictionary_encode().indices.to_numpy().astype(np.int64)
        row, end = np.repeat(np.arange(len(own)), size), np.cumsum(size)
        forth = _factors(codes, row, end - size, end)
        back = _factors(codes[::-1], row[::-1], len(codes) - end, len(codes) - end + size)
        out[own] = (size / np.maximum(forth, MTLD_LEAST) + size / np.maximum(back, MTLD_LEAST)) / 2
    return out


@arrow_udf(DoubleType())
def mtld(tokens: pa.Array) -> pa.Array:
    """Lexical diversity: tokens a factor, forwards and backwards; null under 100 tokens. Factors that start where the last one ended have no built-in form."""
    found = lexical_diversity(tokens)
    return pa.array(found, mask=np.isnan(found))
