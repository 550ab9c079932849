"""License scans: which texts hold a license template.

Templates are in classes by the power of two of their number of word shingles. For a class
up to n shingles a text is cut in overlapping windows of blocks of about n / 16 shingles,
one window from each block on, so long that any run of n shingles lies whole in one. The
MinHash signature of a window, and that of a template, is one minimum a band; a template
is a candidate where a band's minima are the same. A template of which a run of the text no
longer than it holds `percent` of a hundred shingles has with that run's window at least the Jaccard
similarity s = held / (template + window - held), and shares a band with a probability of
1 - (1 - s) ** bands; the number of bands of a class is set such that this is 1 - MISS at
least for each of its templates. Candidates are verified by the exact share of the
template's shingles that the whole text holds. Minima of blocks are made from those of the
class below, so a further class costs half of the one before.

The registered query also looks for standard notices and whole license texts; their words
lose edge punctuation. Very long texts are worked on whole, by one task.

Null and empty texts hold nothing; templates without a word are refused. Repeated rows each
give their own matches; an empty table gives no rows. Other columns are ignored, also ones
named as results are.
"""

from __future__ import annotations

import math
from collections import namedtuple
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmill.llm.license_texts import NOTICES, whole_texts
from inkmill.llm.store import documents
from inkmill.llm.words import mix, span_hashes, text_blocks, word_hashes, word_spans

PERCENT = 75
SHINGLE = 5
MISS = 1e-4
#: (template, SPDX-like name, whether it permits reuse without further conditions); lines as they stand in files.
TEMPLATES = (
    ("Licensed under the Apache License, Version 2.0.", "apache-2.0"),
    ("Released under the MIT License.", "mit"),
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc-4.0"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl-3.0"),
    ("Licensed under CC BY 4.0.", "cc-by-4.0"),
    ("Licensed under CC BY-SA 4.0.", "cc-by-sa-4.0"),
    ("Released under the BSD 3-Clause License.", "bsd-3-clause"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl-2.0"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "mit"),
)


def _shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """The hash of every run of size words of a whole array; the caller drops those that cross rows."""
    out = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size):
        out += mix(words[k : k + len(out)] + np.uint64(k + 1))
    return mix(out)


_EDGE = np.zeros(256, bool)
_EDGE[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def bare_word_hashes(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As word_hashes, of words without punctuation at their edges."""
    begin, end = word_spans(raw, starts)
    place, inner = np.arange(len(raw)), ~_EDGE[raw]
    after = np.minimum.accumulate(np.where(inner, place, len(raw))[::-1])[::-1]
    before = np.maximum.accumulate(np.where(inner, place, -1))
    left, right = after[begin], before[end - 1] + 1
    some = left < end
    return span_hashes(raw, left[some], right[some]), np.searchsorted(begin[some], starts)


#: A class of templates: block size, blocks a window, bands, its templates, and for each band the minima they have.
Class = namedtuple("Class", "block blocks bands members minima")


class Templates:
    """Word shingles of the templates, and the bands of their classes."""

    def __init__(self, templates: tuple = TEMPLATES, percent: int = PERCENT, miss: float = MISS, hashes=word_hashes):
        self.names, self.percent, self.sets = [n for _, n in templates], percent, []
        kinds: dict[tuple[int, int], list[int]] = {}
        for k, (text, name) in enumerate(templates):
            words, at = hashes(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
            if not at[1]:
                raise ValueError(f"the template of {name} has no word")
            width = min(SHINGLE, len(words))
            self.sets.append(np.unique(_shingles(words, width)))
            kinds.setdefault((width, len(self.sets[k]).bit_length() - 1), []).append(k)
        self.sizes = np.array([len(s) for s in self.sets])
        self.widths: dict[int, dict[int, Class]] = {}
        for (width, level), members in sorted(kinds.items()):
            block = max(1, (1 << level) >> 3)
            blocks = -(-((2 << level) - 1 + block - 1) // block)
            held = -(-self.sizes[members] * percent // 100)
            least = float((held / (self.sizes[members] + block * blocks - held)).min())
            bands = 1 if least >= 1 else math.ceil(math.log(miss) / math.log(1 - least))
            minima = [{} for _ in range(bands)]
            for k in members:
                for i, x in enumerate(_permuted(self.sets[k], bands).min(axis=1).tolist()):
                    minima[i].setdefault(x, []).append(k)
            self.widths.setdefault(width, {})[level] = Class(block, blocks, bands, members, minima)

    def matches(self, words: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int]]:
        """(row, template, shingles in common) of the templates that rows of words hold."""
        found = []
        for width, classes in self.widths.items():
            hashes, begin = _rows_of_shingles(words, at, width)
            if not len(hashes):
                continue
            last, own = -1, hashes
            for r, k in sorted(_candidates(hashes, begin, classes)):
                if r != last:
                    last, own = r, np.unique(hashes[begin[r] : begin[r + 1]])
                common = int((own[np.minimum(np.searchsorted(own, self.sets[k]), len(own) - 1)] == self.sets[k]).sum())
                if 100 * common >= self.percent * self.sizes[k]:
                    found.append((r, k, common))
        return found


def _rows_of_shingles(words: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of rows of words, none across rows, and where each row's begin and the end."""
    begin = np.concatenate(([0], np.cumsum(np.maximum(0, np.diff(at) - width + 1))))
    row = np.repeat(np.arange(len(at) - 1), np.diff(begin))
    return _shingles(words, width)[at[:-1][row] + np.arange(begin[-1]) - begin[:-1][row]] if begin[-1] else np.zeros(0, np.uint64), begin


_FACTORS = np.random.default_rng(20240711).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _permuted(hashes: np.ndarray, bands: int) -> np.ndarray:
    """A row a band: the upper half of each hash times an odd number of the band."""
    out = np.empty((bands, len(hashes)), np.uint32)
    for i in range(bands):
        out[i] = hashes * _FACTORS[i] >> np.uint64(32)
    return out


def _candidates(hashes: np.ndarray, begin: np.ndarray, classes: dict[int, Class]) -> set[tuple[int, int]]:
    """(row, template) where a window of the row and the template share a band."""
    low, block, out = _permuted(hashes, max(c.bands for c in classes.values())), 1, set()
    for level in sorted(classes):
        c = classes[level]
        while block < c.block:
            count = (np.diff(begin) + 1) // 2
            half = np.concatenate(([0], np.cumsum(count)))
            pairs = 2 * np.arange(half[-1]) + np.repeat(begin[:-1] - 2 * half[:-1], count)
            low, begin, block = np.minimum.reduceat(low, pairs, axis=1), half, 2 * block
        left = np.repeat(begin[1:], np.diff(begin)) - np.arange(begin[-1])
        low = low[: max(x.bands for k, x in classes.items() if k >= level)]
        windows = _windows(low[: c.bands], left, c.blocks)
        fresh = np.ones(windows.shape[1], bool)
        for i, known in enumerate(c.minima):
            fresh[1:] = windows[i, 1:] != windows[i, :-1]
            fresh[begin[:-1][np.diff(begin) > 0]] = True
            maybe = np.zeros(1 << 16, bool)
            maybe[[x & 0xFFFF for x in known]] = True
            places = np.flatnonzero(maybe[windows[i] & np.uint32(0xFFFF)] & fresh)
            if len(places):
                rows = np.searchsorted(begin, places, "right") - 1
                out.update((r, k) for r, x in zip(rows.tolist(), windows[i, places].tolist(), strict=True) for k in known.get(x, ()))
    return out


def _windows(low: np.ndarray, left: np.ndarray, blocks: int) -> np.ndarray:
    """The minima over so many blocks from each one on, or to the end of its row; left: blocks from each to that end."""
    reach, out = 1, low
    while reach < blocks:
        step = min(reach, blocks - reach)
        wider = out.copy()
        np.minimum(out[:, :-step], out[:, step:], out=wider[:, :-step])
        ends = np.flatnonzero(left <= step)
        wider[:, ends] = out[:, ends]
        reach, out = reach + step, wider
    return out


class Scanner:
    """Templates as they stand, and notices and whole texts by bare words."""

    def __init__(self, templates: tuple, bare: tuple = ()):
        self.names = [n for _, n in (*templates, *bare)]
        self.exact, self.bare = Templates(templates), Templates(bare, hashes=bare_word_hashes) if bare else None
        self.sizes = np.concatenate([self.exact.sizes, self.bare.sizes]) if bare else self.exact.sizes

    def matches(self, raw: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int]]:
        found = self.exact.matches(*word_hashes(raw, starts))
        if self.bare:
            found += [(r, len(self.exact.sizes) + k, c) for r, k, c in self.bare.matches(*bare_word_hashes(raw, starts))]
        return found


def scan(docs: DataFrame, templates: tuple = TEMPLATES, bare: tuple = ()) -> DataFrame:
    """(doc_id, license, template, n_common, n_template, containment) of the templates that rows of docs (doc_id, text) hold."""
    held = docs.sparkSession.sparkContext.broadcast(Scanner(templates, bare))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = held.value
        for batch in batches:
            for first, to, raw, starts in text_blocks(batch.column(1)):
                found = t.matches(raw, starts)
                ids = batch.column(0).slice(first, to - first).cast(pa.int64()).take(pa.array([r for r, _, _ in found], pa.int64()))
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array([t.names[k] for _, k, _ in found], pa.string()), pa.array([k for _, k, _ in found], pa.int64()), pa.array([c for _, _, c in found], pa.int64()),
                    pa.array([int(t.sizes[k]) for _, k, _ in found], pa.int64()), pa.array([c / t.sizes[k] for _, k, c in found], pa.float64()),
                ], names=["doc_id", "license", "template", "n_common", "n_template", "containment"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, license string, template long, n_common long, n_template long, containment double")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The license templates that documents hold."""
    return scan(documents(spark, sf_dir), bare=(*NOTICES, *whole_texts()))


def _template_sql() -> str:
    rows = ", ".join(f"({k}, '{name}', '{text.lower()}')" for k, (text, name) in enumerate(TEMPLATES))
    return f"(VALUES {rows}) AS t(template, license, text)"


_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS v FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(v) - {SHINGLE - 2}), lambda i: array_to_string(v[i:i + {SHINGLE - 1}], ' '))) AS h FROM d),
t AS (SELECT template, license, {_WORDS} AS v FROM {_template_sql()}),
k AS (SELECT DISTINCT template, license, unnest(list_transform(range(1, len(v) - {SHINGLE - 2}), lambda i: array_to_string(v[i:i + {SHINGLE - 1}], ' '))) AS h FROM t),
n AS (SELECT template, count(*) AS n_template FROM k GROUP BY template)
SELECT doc_id, license, template::BIGINT AS template, count(*) AS n_common, n_template, count(*)::DOUBLE / n_template AS containment
FROM s JOIN k USING (h) JOIN n USING (template) GROUP BY doc_id, license, template, n_template HAVING 100 * count(*) >= {PERCENT} * n_template
"""
