"""Ranked lexical search over a two-level quantised index of all documents.

The index is divided by documents, not by terms: each task turns its own texts into
segments of bounded size, so no posting is shuffled and a term that every document holds is
in no task more than that task's documents. A segment is one row: its terms in order, the
documents of each, and two levels for every posting. The first is a byte, the term's share
of a score without the term's weight, divided by STEP and rounded up; the second is what the
share is made of, occurrences and the documents' lengths. N and L, which the shares depend
on, are counted in a pass before.

A search takes the items in blocks of bounded size. It counts the documents of the block's
terms, which gives their weights; sums the bytes of each item's terms in every document,
which bounds the score from above, and the bytes less one, which bounds it from below;
takes the k-th highest lower bound over all segments; and scores exactly, in whole numbers
from the second level, every document whose upper bound reaches it. None of the k best can
be missed, and nothing but these documents is scored. Tasks keep k numbers an item, in
whatever number of segments, and send these only.

Terms are known by 64-bit hashes. Null and empty texts, and those without a term, are in no
segment and don't count for N; such items have no results. Repeated rows of documents are
documents of their own; equal rows of items are one item, rows of one item id with differing
texts are ranked each by itself. A null doc_id comes after all others of its score. Very
long texts are hashed in pieces that end between terms, but are counted as a whole. Empty
tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkmill.llm.store import documents, small_batches
from inkmill.llm.words import span_hashes, text_blocks, word_spans
from inkmill.sources.scratch import new_path

TOP = 10
#: A share is below SHARES; a byte says how many STEPs it is, rounded up.
SHARES = 1_000_000
STEP = -(-SHARES // 255)
#: Terms, with repeats, and documents from which on a segment is closed.
SEGMENT_TERMS, SEGMENT_DOCS = 1_000_000, 65_000
#: Bytes of a text that are hashed at a time, and characters of items that a task holds at most, but for a longer single one.
CHUNK, BLOCK_CHARS = 1 << 20, 8 << 20
#: Groups that an item's bounds are first gathered in.
SALT = 64

_APART = np.ones(256, bool)
_APART[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_AS_SPACE = np.where(_APART, 32, 65).astype(np.uint8)


def _pieces(raw: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in pieces of about CHUNK bytes that end where a term does."""
    at = 0
    while at < len(raw):
        to = min(at + CHUNK, len(raw))
        while to < len(raw):
            gap = np.flatnonzero(_APART[raw[to : to + CHUNK]])
            to += int(gap[0]) if len(gap) else min(CHUNK, len(raw) - to)
            if len(gap):
                break
        yield raw[at:to]
        at = to


def text_terms(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each term in text order, first term of each text and the end) of a block of texts."""
    if len(raw) > CHUNK and len(starts) == 2:
        found = [_hashed(x, np.array([0, len(x)]))[0] for x in _pieces(raw)]
        return np.concatenate(found), np.array([0, sum(map(len, found))])
    return _hashed(raw, starts)


def _hashed(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    begin, end = word_spans(_AS_SPACE[raw], starts)
    return span_hashes(raw, begin, end), np.searchsorted(begin, starts)


def counted(docs: DataFrame) -> tuple[int, int]:
    """How many rows have a term, and how many terms all of them have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for batch in batches:
            for _, _, raw, starts in text_blocks(batch.column(0)):
                begin, _ = word_spans(_AS_SPACE[raw], starts)
                own = np.diff(np.searchsorted(begin, starts))
                n, total = n + int((own > 0).sum()), total + int(own.sum())
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total], pa.int64())], names=["n", "total"])

    row = docs.select("text").mapInArrow(run, "n long, total long").agg(F.sum("n"), F.sum("total")).first()
    return row[0] or 0, row[1] or 0


def shares(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term that occurs tf times in a document of n terms adds to a score, without its weight."""
    m = 100 - 75 + (75 * n * n_docs) // n_terms
    return (SHARES * 1000 * tf) // (1000 * tf + 8 * m)


_SEGMENT = pa.schema([
    ("ids", pa.list_(pa.int64())), ("lengths", pa.binary()), ("terms", pa.binary()), ("starts", pa.binary()), ("docs", pa.binary()), ("impacts", pa.binary()), ("tfs", pa.binary()),
])
_SEGMENT_DDL = "ids array<long>, lengths binary, terms binary, starts binary, docs binary, impacts binary, tfs binary"


def _segment(ids: list[pa.Array], lengths: list[np.ndarray], hashes: list[np.ndarray], n_docs: int, n_terms: int) -> pa.RecordBatch:
    n, h = np.concatenate(lengths), np.concatenate(hashes)
    some = np.flatnonzero(n)
    n, own = n[some].astype(np.int64), pa.concat_arrays(ids).take(pa.array(some))
    doc = np.repeat(np.arange(len(n), dtype=np.uint16), n)
    order = np.argsort(h, kind="stable")
    h, doc = h[order], doc[order]
    first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))[: len(h)])
    tf = np.diff(np.append(first, len(h)))
    h, doc = h[first], doc[first]
    new = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))[: len(h)])
    impacts = -(-shares(tf, n[doc], n_docs, n_terms) // STEP)
    parts = (n, h[new], np.append(new, len(h)).astype(np.uint32), doc, impacts.astype(np.uint8), tf.astype(np.uint32))
    lists = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)
    return pa.RecordBatch.from_arrays([lists, *(pa.array([x.tobytes()], pa.binary()) for x in parts)], schema=_SEGMENT)


@dataclass(frozen=True)
class Index:
    """The segments, and how many documents and terms are in them."""

    segments: DataFrame
    n_docs: int
    n_terms: int


def build(docs: DataFrame) -> Index:
    """The index of all rows of docs (doc_id, text), written as a table."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n_docs, n_terms = counted(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, hashes, rows, terms = [], [], [], 0, 0
        for batch in batches:
            for first, to, raw, starts in text_blocks(batch.column(1)):
                h, at = text_terms(raw, starts)
                ids.append(batch.column(0).slice(first, to - first))
                lengths.append(np.diff(at))
                hashes.append(h)
                rows, terms = rows + to - first, terms + len(h)
                if terms >= SEGMENT_TERMS or rows >= SEGMENT_DOCS:
                    if terms:
                        yield _segment(ids, lengths, hashes, n_docs, n_terms)
                    ids, lengths, hashes, rows, terms = [], [], [], 0, 0
        if terms:
            yield _segment(ids, lengths, hashes, n_docs, n_terms)

    path = new_path(spark, "lexical-index")
    # rows are some megabytes each, so the writer must look at the size after each row
    each = {"parquet.block.size": 16 << 20, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 1, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1, "parquet.enable.dictionary": "false"}
    docs.mapInArrow(run, _SEGMENT_DDL).write.options(**each).parquet(path)
    return Index(spark.read.schema(_SEGMENT_DDL).parquet(path), n_docs, n_terms)


class Queries:
    """A block of items: their distinct terms, and which of these each item has how often."""

    def __init__(self, ids: list[int | None], texts: list[str]):
        self.ids, own = ids, []
        for _, _, raw, starts in text_blocks(pa.array(texts, pa.string())):
            h, at = text_terms(raw, starts)
            own += [h[at[k] : at[k + 1]] for k in range(len(at) - 1)]
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *own]))
        self.items = [[x.astype(np.int64) for x in (np.searchsorted(self.vocabulary, t), times)] for t, times in (np.unique(h, return_counts=True) for h in own)]

    def weigh(self, df: dict[int, int], n_docs: int) -> None:
        """Multiplies each item's counts by the terms' weights, of which those of no document, or weightless, are gone."""
        weight = np.zeros(len(self.vocabulary), np.int64)
        for term, n in df.items():
            weight[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1)))
        self.items = [(t[weight[t] > 0], (times * weight[t])[weight[t] > 0]) for t, times in self.items]

    def places(self, terms: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the postings of each term of the vocabulary begin and end in a segment."""
        slot = np.minimum(np.searchsorted(terms, self.vocabulary), len(terms) - 1)
        there = terms[slot] == self.vocabulary
        return np.where(there, starts[slot], 0), np.where(there, starts[slot + 1], 0)


class Segment:
    """The first level of a row of the index, ready for the items of a block."""

    def __init__(self, batch: pa.RecordBatch, row: int, queries: Queries):
        column = lambda name, kind: np.frombuffer(batch.column(name)[row].as_buffer(), kind)
        self.ids, self.column = batch.column("ids")[row].values, column
        self.size, self.docs, self.impacts = len(self.ids), column("docs", np.uint16), column("impacts", np.uint8)
        self.low, self.high = queries.places(column("terms", np.uint64), column("starts", np.uint32).astype(np.int64))

    def postings(self, term: int) -> slice:
        return slice(self.low[term], self.high[term])

    def bounds(self, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the scores of all documents are at most and at least."""
        up, down = np.zeros(self.size, np.int64), np.zeros(self.size, np.int64)
        for term, weight in zip(terms[self.high[terms] > 0].tolist(), weights[self.high[terms] > 0].tolist(), strict=True):
            own = self.postings(term)
            docs, impact = self.docs[own], self.impacts[own].astype(np.int64)
            up[docs] += weight * STEP * impact
            down[docs] += weight * STEP * np.maximum(impact - 1, 0)
        return up, down

    def scores(self, terms: np.ndarray, weights: np.ndarray, chosen: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
        """The exact scores of chosen documents, from the second level."""
        tfs, n, out = self.column("tfs", np.uint32), self.column("lengths", np.int64)[chosen], np.zeros(len(chosen), np.int64)
        for term, weight in zip(terms[self.high[terms] > 0].tolist(), weights[self.high[terms] > 0].tolist(), strict=True):
            own = self.postings(term)
            at = np.minimum(np.searchsorted(self.docs[own], chosen), own.stop - own.start - 1)
            hit = self.docs[own][at] == chosen
            out[hit] += weight * shares(tfs[own][at[hit]].astype(np.int64), n[hit], n_docs, n_terms)
        return out


def _frequencies(index: Index, queries: Broadcast) -> dict[int, int]:
    """In how many documents each term of a block is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = queries.value
        df = np.zeros(len(known.vocabulary), np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                low, high = known.places(np.frombuffer(batch.column("terms")[row].as_buffer(), np.uint64), np.frombuffer(batch.column("starts")[row].as_buffer(), np.uint32).astype(np.int64))
                df += high - low
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(df[some], pa.int64())], names=["term", "df"])

    rows = index.segments.select("terms", "starts").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {r["term"]: r["df"] for r in rows.collect()}  # the terms of a block at most


def _floors(index: Index, queries: Broadcast, k: int) -> dict[int, int]:
    """The k-th highest lower bound of each item of a block that has so many above 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = queries.value
        best = [np.zeros(0, np.int64)] * len(known.items)
        for batch in batches:
            for row in range(batch.num_rows):
                segment = Segment(batch, row, known)
                for i, (terms, weights) in enumerate(known.items):
                    _, down = segment.bounds(terms, weights)
                    down = np.concatenate((best[i], down[down > (best[i][0] if len(best[i]) == k else 0)]))
                    best[i] = np.sort(down if len(down) <= k else np.partition(down, len(down) - k)[-k:])
        item = np.repeat(np.arange(len(best)), [len(x) for x in best])
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(np.concatenate([np.zeros(0, np.int64), *best]))], names=["item", "bound"])

    highest = lambda c: F.slice(F.sort_array(c, asc=False), 1, k)
    sent = index.segments.select("ids", "terms", "starts", "docs", "impacts").mapInArrow(run, "item long, bound long").withColumn("part", F.pmod(F.spark_partition_id(), F.lit(SALT)))
    some = sent.groupBy("item", "part").agg(highest(F.collect_list("bound")).alias("bounds"))  # k of each task whose number falls to the part
    rows = some.groupBy("item").agg(highest(F.flatten(F.collect_list("bounds"))).alias("bounds")).where(F.size("bounds") >= k)
    return {r["item"]: r["bound"] for r in rows.select("item", F.element_at("bounds", k).alias("bound")).collect()}  # the items of a block at most


_HIT = "item long, item_id long, doc_id long, score long"


def _hits(index: Index, queries: Broadcast, floors: Broadcast, k: int) -> DataFrame:
    """The k best documents of each item and task, of those whose upper bound reaches the item's floor."""
    n_docs, n_terms = index.n_docs, index.n_terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, least = queries.value, floors.value
        best: list[list[tuple]] = [[] for _ in known.items]
        for batch in batches:
            for row in range(batch.num_rows):
                segment = Segment(batch, row, known)
                for i, (terms, weights) in enumerate(known.items):
                    up, _ = segment.bounds(terms, weights)
                    chosen = np.flatnonzero(up >= max(1, least.get(i, 0)))
                    if len(chosen):
                        scores = segment.scores(terms, weights, chosen, n_docs, n_terms)
                        found = [(-s, d is None, d or 0) for s, d in zip(scores.tolist(), segment.ids.take(pa.array(chosen)).to_pylist(), strict=True) if s > 0]
                        best[i] = sorted(best[i] + found)[:k]
        out = [(i, known.ids[i], None if null else d, -s) for i, rows in enumerate(best) for s, null, d in rows]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(4)], names=["item", "item_id", "doc_id", "score"])

    return index.segments.mapInArrow(run, _HIT)


def search(index: Index, items: DataFrame, k: int = TOP, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k highest-scoring documents above 0 of each item (item_id, text), equal scores by doc_id."""
    spark = items.sparkSession
    items = items.where(F.length("text") > 0).select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    blocks = -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars)
    hits = None
    for block in range(blocks if index.n_docs else 0):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()  # about block_chars
        queries = Queries([r["item_id"] for r in rows], [r["text"] for r in rows])
        if not len(queries.vocabulary):
            continue
        queries.weigh(_frequencies(index, spark.sparkContext.broadcast(queries)), index.n_docs)
        sent = spark.sparkContext.broadcast(queries)
        found = _hits(index, sent, spark.sparkContext.broadcast(_floors(index, sent, k)), k).withColumn("block", F.lit(block))
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = Window.partitionBy("block", "item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all documents for every item of benchmark."""
    return search(build(documents(spark, sf_dir)), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = rf"""
WITH t AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS v FROM documents),
d AS (SELECT doc_id, r, len(v)::BIGINT AS n, v FROM t WHERE len(v) > 0),
s AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM d),
p AS (SELECT r, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, n, unnest(v) AS term FROM d) GROUP BY ALL),
q AS (SELECT item_id, term, count(*)::BIGINT AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY term, nn),
sc AS (SELECT item_id, doc_id, r, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * nn) // ll))))::BIGINT AS score FROM q JOIN p USING (term) JOIN w USING (term), s GROUP BY ALL),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM sc WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM k WHERE rank <= {TOP}
"""
