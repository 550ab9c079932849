"""Benchmark decontamination: which documents contain the shingles of a test item.

Containment search with MinHash over size partitions. Items are partitioned by the power
of two of the number of their shingles, documents by the power of two above theirs. A
document's signature for a partition of items has one minimum for each bin of the hash
range; bins grow in number with the document, so that each holds `load` of its shingles on
average and short items are not drowned in long documents. A shingle of the document is its
bin's minimum with a probability of (1 - exp(-load)) / load at least; the load of a
partition is the largest at which an item of its smallest size, of which the document holds
just enough, is missed with a probability of `miss` at most: 1/2 or so for items of a dozen
shingles, over 8 for those of a hundred, whose signatures are thin. The signature of a
coarser load is part of that of a finer one. Only minima are looked up, in the index of the
shingles of the partition's items; an item that owns one is a candidate, and the exact
share of its shingles that the document's set holds decides. With a `miss` of 0, every
shingle is looked up.

Items are a stated query set. Up to `block_chars` characters of them are held by every
task. A larger set is not: minima and item shingles are then dealt out by hash and joined,
and the candidates' texts are joined for the verification, so the corpus is read twice
however many items there are.

An item of fewer than five words has no shingle of that size: its whole sequence of words is looked
for among the documents' runs of as many words, one lookup a run, as there are no parts to miss.

Null and empty texts have no shingles: such items are in no document. Items
without id are searched like others. Repeated items give a row each; repeated rows of
documents too, whatever their ids. Very long texts are worked on whole, by one task. Empty
tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmill.llm.store import documents, materialise
from inkmill.llm.words import SHINGLE, row_runs, row_sets, set_signatures, text_blocks, word_hashes

PERCENT = 75
MISS = 1e-4
#: Characters of items that a task holds at most.
BLOCK_CHARS = 16 << 20


def bin_load(smallest: int, miss: float = MISS, percent: int = PERCENT) -> float:
    """The largest power of two (64 at most) as load at which an item of so many shingles is missed with at most this probability."""
    common, load = max(1, -(-smallest * percent // 100)), 64.0
    while (1 - (1 - math.exp(-load)) / load) ** common > miss:
        load /= 2
    return load


def minima(hashes: np.ndarray, at: np.ndarray, load: float) -> np.ndarray:
    """The places of the shingles that are the minimum of their bin; hashes are sorted within each row. A load of 0: all."""
    if not load:
        return np.arange(len(hashes))
    n = np.diff(at)
    bits = np.clip(np.ceil(np.log2(np.maximum(n, 1))) + math.ceil(-math.log2(load)), 1, 63).astype(np.uint64)
    bins = hashes >> np.repeat(np.uint64(64) - bits, n)
    first = np.ones(len(hashes), bool)
    first[1:] = bins[1:] != bins[:-1]
    first[at[:-1][n > 0]] = True
    return np.flatnonzero(first)


def _item_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of all items, and where each item's begin and the end."""
    found = [row_sets(raw, starts) for _, _, raw, starts in text_blocks(texts)]
    hashes = np.concatenate([np.zeros(0, np.uint64), *(h for h, _ in found)])
    return hashes, np.concatenate(([0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *(np.diff(at) for _, at in found)]))))


def _word_counts(texts: pa.Array) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *(np.diff(word_hashes(raw, starts)[1]) for _, _, raw, starts in text_blocks(texts))])


def partition_of(size: np.ndarray) -> np.ndarray:
    """The partition of an item of so many shingles: the power of two at or below it."""
    return np.frexp(np.maximum(size, 1))[1] - 1


class ItemIndex:
    """The shingles of items and, for each partition of items, which of them have each of its shingles."""

    def __init__(self, ids: list[int | None], texts: list[str | None], percent: int = PERCENT, miss: float = MISS):
        self.ids, self.percent = pa.array(ids, pa.int64()), percent
        self.hashes, self.at = _item_sets(pa.array(texts, pa.string()))
        self.size = np.diff(self.at)
        owner, kind = np.repeat(np.arange(len(self.size)), self.size), partition_of(self.size)
        self.partitions, words = [], _word_counts(pa.array(texts, pa.string()))
        for k in np.unique(kind[words >= SHINGLE]):
            mine = np.flatnonzero((kind[owner] == k) & (words[owner] >= SHINGLE))
            order = mine[np.argsort(self.hashes[mine], kind="stable")]
            shingles, first = np.unique(self.hashes[order], return_index=True)
            load = bin_load(int(self.size[(kind == k) & (words >= SHINGLE)].min()), miss, percent) if miss else 0.0
            self.partitions.append((load, shingles, np.append(first, len(order)), owner[order]))
        self.short = {}  # items of fewer words than a shingle, by how many
        for width in np.unique(words[(words > 0) & (words < SHINGLE)]).tolist():
            mine = np.flatnonzero(words == width)
            order = mine[np.argsort(self.hashes[self.at[mine]], kind="stable")]
            runs, first = np.unique(self.hashes[self.at[order]], return_index=True)
            self.short[width] = (runs, np.append(first, len(order)), order)

    def candidates(self, hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """(row, item) of the items that own a minimum of the row, as row * number of items + item, sorted."""
        out = [np.zeros(0, np.int64)]
        for load, shingles, first, owner in self.partitions:
            place = minima(hashes, at, load)
            probes = hashes[place]
            slot = np.minimum(np.searchsorted(shingles, probes), len(shingles) - 1)
            hit = np.flatnonzero(shingles[slot] == probes)
            n = first[slot[hit] + 1] - first[slot[hit]]
            row = np.repeat(np.searchsorted(at, place[hit], "right") - 1, n)
            out.append(row * len(self.size) + owner[np.repeat(first[slot[hit]] - np.cumsum(n) + n, n) + np.arange(n.sum())])
        return np.unique(np.concatenate(out))

    def short_items(self, raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, item) for the items of few words that rows hold as a run of words."""
        out = [np.zeros(0, np.int64)]
        for width, (known, first, item) in self.short.items():
            runs, row = row_runs(raw, starts, width)
            slot = np.minimum(np.searchsorted(known, runs), len(known) - 1)
            met = np.unique(row[known[slot] == runs] * len(known) + slot[known[slot] == runs])
            row, slot = np.divmod(met, len(known))
            n = first[slot + 1] - first[slot]
            out.append(np.repeat(row, n) * len(self.size) + item[np.repeat(first[slot] - np.cumsum(n) + n, n) + np.arange(n.sum())])
        return np.divmod(np.concatenate(out), max(1, len(self.size)))

    def search(self, raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, shingles in common) for the items that a block of texts contains."""
        hashes, at = row_sets(raw, starts)
        row, item = np.divmod(self.candidates(hashes, at), max(1, len(self.size)))
        common = np.zeros(len(row), np.int64)
        for k, (r, i) in enumerate(zip(row.tolist(), item.tolist(), strict=True)):
            common[k] = held(hashes[at[r] : at[r + 1]], self.hashes[self.at[i] : self.at[i + 1]])
        good = 100 * common >= self.percent * self.size[item]
        few = self.short_items(raw, starts)
        return np.append(row[good], few[0]), np.append(item[good], few[1]), np.append(common[good], np.ones(len(few[0]), np.int64))


def held(own: np.ndarray, wanted: np.ndarray) -> int:
    """How many of wanted are in own; both are sorted and not empty."""
    return int((own[np.minimum(np.searchsorted(own, wanted), len(own) - 1)] == wanted).sum())


_OUT = "doc_id long, item_id long, n_common long, n_item long, containment double"


def contained(docs: DataFrame, items: DataFrame, percent: int = PERCENT, block_chars: int = BLOCK_CHARS, miss: float = MISS) -> DataFrame:
    """(doc_id, item_id, n_common, n_item, containment) of the items (item_id, text) that rows of docs (doc_id, text) contain."""
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    if chars > block_chars:
        few = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")) < SHINGLE
        out = _joined(docs, items.where(~few), percent, miss)
        blocks = -(-(items.where(few).agg(F.sum(F.length("text"))).first()[0] or 0) // max(1, block_chars))
        for block in range(blocks):  # those of few words, a part of them at a time
            own = items.where(few & (F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block))
            out = out.unionByName(_looked_up(docs, own, percent, miss))
        return out
    return _looked_up(docs, items, percent, miss)


def _looked_up(docs: DataFrame, items: DataFrame, percent: int, miss: float) -> DataFrame:
    """As contained, with all items in every task."""
    rows = items.select("item_id", "text").orderBy("item_id", "text").collect()  # about BLOCK_CHARS at most
    index = docs.sparkSession.sparkContext.broadcast(ItemIndex([r["item_id"] for r in rows], [r["text"] for r in rows], percent, miss))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = index.value
        for batch in batches:
            for first, to, raw, starts in text_blocks(batch.column(1)):
                row, item, common = known.search(raw, starts)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, to - first).cast(pa.int64()).take(pa.array(row)), known.ids.take(pa.array(item)), pa.array(common),
                    pa.array(known.size[item].astype(np.int64)), pa.array(common / known.size[item], pa.float64()),
                ], names=["doc_id", "item_id", "n_common", "n_item", "containment"])

    return docs.select("doc_id", "text").mapInArrow(run, _OUT)


def _minima_rows(docs: DataFrame, loads: dict[int, float]) -> DataFrame:
    """(sig, kind, hash): for each partition of items, the minima of each text; texts of one set, known by its signature, are the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, raw, starts in text_blocks(batch.column(0)):
                hashes, at = row_sets(raw, starts)
                sig = set_signatures(hashes, at).view(np.int64)
                for kind, load in loads.items():
                    place = minima(hashes, at, load)
                    row = np.searchsorted(at, place, "right") - 1
                    yield pa.RecordBatch.from_arrays([pa.array(sig[row]), pa.array(np.full(len(place), kind, np.int32)), pa.array(hashes[place].view(np.int64))], names=["sig", "kind", "hash"])

    return docs.select("text").mapInArrow(run, "sig long, kind int, hash long")


def _signed(rows: DataFrame, key: str) -> DataFrame:
    """rows (key, text) with the signature of each text's set of shingles and the set's size; none without shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(set_signatures(*s).view(np.int64), np.diff(s[1])) for _, _, raw, starts in text_blocks(batch.column(1)) for s in [row_sets(raw, starts)]]
            sig, n = (np.concatenate([np.zeros(0, np.int64), *(f[k] for f in found)]) for k in (0, 1))
            some = pa.array(np.flatnonzero(n))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()).take(some), batch.column(1).take(some), pa.array(sig).take(some), pa.array(n).take(some)], names=[key, "text", "sig", "n"])

    return rows.select(key, "text").mapInArrow(run, f"{key} long, text string, sig long, n long")


def _joined(docs: DataFrame, items: DataFrame, percent: int, miss: float) -> DataFrame:
    """As contained, with minima and item shingles dealt out by hash."""
    signed = materialise(_signed(items, "item_id"), "items")
    kind = F.floor(F.log2("n") + F.lit(1e-9)).cast("int")
    smallest = {r["kind"]: r["n"] for r in signed.groupBy(kind.alias("kind")).agg(F.min("n").alias("n")).collect()}  # a row a power of two
    loads = {k: bin_load(n, miss, percent) if miss else 0.0 for k, n in smallest.items()}
    shingles = _minima_rows(signed, dict.fromkeys(loads, 0.0)).join(signed.select("sig", kind.alias("kind")).distinct(), ["sig", "kind"], "left_semi")
    pairs = materialise(
        _minima_rows(docs, loads).join(shingles.withColumnRenamed("sig", "item_sig").distinct(), ["kind", "hash"]).select("sig", "item_sig").distinct(), "candidates"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for doc_text, item_text, row in zip(batch.column(1), batch.column(3), range(batch.num_rows), strict=True):
                (own, _), (wanted, _) = (_item_sets(pa.array([t.as_py()], pa.string())) for t in (doc_text, item_text))
                common = held(own, wanted)
                if 100 * common >= percent * len(wanted):
                    for column, value in zip(out, (row, common, len(wanted)), strict=True):
                        column.append(value)
            rows = pa.array(out[0], pa.int64())
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(rows), batch.column(2).take(rows), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array([c / n for c, n in zip(*out[1:], strict=True)], pa.float64()),
            ], names=["doc_id", "item_id", "n_common", "n_item", "containment"])

    both = _signed(docs, "doc_id").select("doc_id", F.col("text").alias("doc_text"), "sig").join(pairs, "sig").join(
        signed.select("item_id", F.col("text").alias("item_text"), F.col("sig").alias("item_sig")), "item_sig"
    )
    return both.select("doc_id", "doc_text", "item_id", "item_text").mapInArrow(run, _OUT)


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that contain no item, with all columns. Rows of one id go together, and so do those without id."""
    gone = contained(docs, items).select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("gone")), "left_anti")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that contain an item of benchmark, with the item and the share of its shingles."""
    return contained(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def shingle_sql(table: str, key: str) -> str:
    """DuckDB SQL for (key, n, h): every distinct shingle h of the n that each row of table has."""
    return rf"""SELECT {key}, len(g) AS n, unnest(g) AS h FROM (
      SELECT {key}, CASE WHEN len(v) = 0 THEN []::VARCHAR[] WHEN len(v) < 5 THEN [array_to_string(v, ' ')]
        ELSE list_distinct(list_transform(range(1, len(v) - 3), lambda i: array_to_string(v[i:i + 4], ' '))) END AS g FROM (
        SELECT {key}, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS v FROM {table}))"""


ORACLE = rf"""
WITH d AS ({shingle_sql("documents", "doc_id")}), b0 AS ({shingle_sql("benchmark", "item_id")}), b AS (SELECT * FROM b0 WHERE len(string_split(h, ' ')) >= 5),
w AS (SELECT doc_id, ' ' || regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g') || ' ' AS t FROM documents)
SELECT doc_id, item_id, count(*) AS n_common, b.n::BIGINT AS n_item, count(*)::DOUBLE / b.n AS containment
FROM d JOIN b USING (h) GROUP BY doc_id, item_id, b.n HAVING 100 * count(*) >= 75 * b.n
UNION ALL SELECT doc_id, item_id, 1, 1, 1 FROM w JOIN b0 ON len(string_split(h, ' ')) < 5 AND contains(t, ' ' || h || ' ')
"""
