"""Removal of repeated byte strings by external induced suffix sorting.

A byte goes where a string of `size` bytes covers it that also starts earlier: in a
document with a smaller id, or before in the same one. Every such string holds a gram that
is the leftmost smallest by hash in it, wherever the string stands, so all its occurrences
meet at that gram. The work is done in these steps, each by key, none in one place:

1. Documents equal as wholes are grouped by digest. All but the first repeat entirely.
2. Every document lists its grams, each with the starts for which it is the smallest and
   a hash of their context, all bytes that these strings cover. The grams go to shards; one
   that a sample of the documents tells to be frequent goes to several, by document. Of
   equal contexts (128 bits of gram and context, lengths included) all but the first are
   repeats. A gram with one context is done.
3. The first occurrences of the differing contexts of a gram may still overlap in a string.
   Their bytes go to shards by gram, and each shard sorts its suffixes by induction, with
   queues on the task's own disk where it is larger than its memory bound. Neighbours with
   `size` bytes in common are one string; all but its first occurrence repeat.
4. A gram whose contexts are more than a shard's bytes, or that is frequent, is cut in
   pieces, each sorted for itself. The first occurrences in each piece then go to shards by
   a digest of their string, so that a string comes at most once from each piece; the first
   one stays.
5. The repeats of a document are united and cut from it.

Null text counts as empty; texts shorter than `size` bytes lose nothing. Rows of one id with
equal texts are one document and get one answer. Rows of one id with differing texts, and
rows without id, which come first, are documents of their own, in order of their digests. A
very long text is worked on whole, by one task. An empty table gives no rows. Other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmill.llm.store import documents, materialise
from inkmill.llm.suffix import common_at_least, suffix_array
from inkmill.llm.words import _power, mix, text_blocks

SIZE, GRAM = 100, 24
#: Bytes of listed grams and of contexts in a shard, about.
ENTRY_BYTES, CONTEXT_BYTES = 8 << 20, 2 << 20
#: One document in so many is sampled for frequent grams; a gram is frequent if it has more occurrences than that by the sample.
SAMPLED, FREQUENT = 16, 200_000
BLOCK_BYTES = 512 << 10
#: Neighbouring pieces of a gram go so many shards further.
_STEP = 0x9E3779B1
_LOW32 = np.uint64(0xFFFFFFFF)
#: A string that is the first in its piece of a gram: its digest, and where it starts.
_STRING = np.dtype([("high", "<u8"), ("low", "<u8"), ("doc", "<i8"), ("at", "<i8")])
_VALUE = np.random.default_rng(77).integers(0, 2**64, 256, dtype=np.uint64)


def _rolling(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    power, inverse = _power(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_VALUE[raw] * power[:-1], out=total[1:])
    return total, inverse


def grams(raw: np.ndarray, starts: np.ndarray, size: int = SIZE, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(row, first start in the row, number of starts, hash of the gram, hash of the context) for each run of starts with one smallest gram."""
    n, none = len(raw), np.zeros(0, np.int64)
    if n < size:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    total, inverse = _rolling(raw)
    bits = np.uint64(max(20, int(n).bit_length()))
    mask = (np.uint64(1) << bits) - np.uint64(1)
    hashes = mix((total[gram:] - total[:-gram]) * inverse[: n - gram + 1])
    low = (hashes & ~mask) | np.arange(len(hashes), dtype=np.uint64)
    window, width = size - gram + 1, 1
    while width * 2 <= window:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: n - size + 1], low[window - width : window - width + n - size + 1])
    place = (low & mask).astype(np.int64)
    row = np.searchsorted(starts, np.arange(n - size + 1), "right") - 1
    whole = np.arange(n - size + 1) + size <= starts[row + 1]
    change = np.concatenate(([True], (place[1:] != place[:-1]) | (row[1:] != row[:-1])))
    first = np.flatnonzero(change & whole)
    # a start that isn't whole ends the row's starts
    ends = np.flatnonzero(np.concatenate((change[1:], [True])) | (whole & ~np.concatenate((whole[1:], [False])))) + 1
    stop = ends[np.searchsorted(ends, first, "right")]
    context = mix((total[stop + size - 1] - total[first]) * inverse[first] + (stop - first).astype(np.uint64))
    return row[first], first - starts[row[first]], stop - first, hashes[place[first]], context


def frequent_grams(docs: DataFrame, size: int, gram: int) -> dict[int, int]:
    """The grams that a sample of the documents tells to be frequent, and in how many parts their occurrences go: one for FREQUENT of them.

    They are at most the number of all occurrences over FREQUENT. The sample decides where occurrences go, not what is found.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, raw, starts in text_blocks(batch.column(0), BLOCK_BYTES):
                keys, n = np.unique(grams(raw, starts, size, gram)[3], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["gram", "n"])

    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLED)) == 0).select("text").mapInArrow(run, "gram long, n long")
    counted = sample.groupBy("gram").agg((F.sum("n") * SAMPLED).alias("n")).where(F.col("n") > FREQUENT).collect()
    return {r["gram"]: -(-r["n"] // FREQUENT) for r in counted}


class Frequent:
    """Parts of frequent grams."""

    def __init__(self, parts: dict[int, int]):
        self.gram = np.sort(np.array(list(parts), np.int64).view(np.uint64))
        self.parts = np.array([parts[k] for k in self.gram.view(np.int64).tolist()], np.uint64)

    def part(self, key: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """0 for grams that aren't frequent, else the document's part of them, from 1 on."""
        out = np.zeros(len(key), np.uint64)
        if len(self.gram):
            slot = np.minimum(np.searchsorted(self.gram, key), len(self.gram) - 1)
            hit = np.flatnonzero(self.gram[slot] == key)
            out[hit] = mix(ids[hit].view(np.uint64)) % self.parts[slot[hit]] + np.uint64(1)
        return out


def _listed(docs: DataFrame, shards: int, size: int, gram: int, frequent: Frequent) -> DataFrame:
    """The grams of every document, packed by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).cast(pa.int64()).to_numpy(zero_copy_only=False)
            for at, _, raw, starts in text_blocks(batch.column(1), BLOCK_BYTES):
                row, first, n, key, context = grams(raw, starts, size, gram)
                own_ids = ids[at + row]
                part = frequent.part(key, own_ids)
                to = np.where(part > 0, mix(key + part * np.uint64(_STEP)), key)
                shard = ((to & _LOW32) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)
                order = np.argsort(shard, kind="stable")
                sorted_shard = shard[order]
                cut = np.flatnonzero(np.concatenate(([True], sorted_shard[1:] != sorted_shard[:-1]))) if len(order) else np.zeros(0, np.int64)
                out: list[list] = [[], [], [], [], [], []]
                for begin, end in zip(cut, np.append(cut[1:], len(order)), strict=True):
                    own = order[begin:end]
                    for column, value in zip(out, (int(sorted_shard[begin]), own_ids[own].tobytes(), first[own].astype(np.int64).tobytes(), n[own].astype(np.uint16).tobytes(), key[own].tobytes(), context[own].tobytes()), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(c, pa.binary()) for c in out[1:])], names=["shard", "ids", "first", "n", "gram", "context"])

    return docs.select("doc_id", "text").mapInArrow(run, "shard int, ids binary, first binary, n binary, gram binary, context binary")


_MARK = "doc_id long, first long, n long, gram long, piece long, split boolean"


def _sifted(size: int, bound: int, frequent: Frequent):
    """Of a shard's grams: repeats (gram null; first and n in bytes), and contexts that differ (first and number of starts), a gram's in pieces of about bound bytes."""

    def of(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        read = lambda c, kind: np.concatenate([np.frombuffer(x, kind) for x in rows[c]])
        ids, first, n, gram, context = read("ids", np.int64), read("first", np.int64), read("n", np.uint16).astype(np.int64), read("gram", np.uint64), read("context", np.uint64)
        part = frequent.part(gram, ids)
        order = np.lexsort((first, ids, context, part, gram))
        ids, first, n, gram, context, part = ids[order], first[order], n[order], gram[order], context[order], part[order]
        new_gram = np.concatenate(([True], (gram[1:] != gram[:-1]) | (part[1:] != part[:-1])))
        new = new_gram | np.concatenate(([True], (context[1:] != context[:-1]) | (n[1:] != n[:-1])))
        number = np.cumsum(new_gram) - 1
        several = new & ((np.bincount(number, weights=new)[number] > 1) | (part > 0))
        again = ~new
        volume = np.where(several, n + size - 1, 0)
        before, total = np.cumsum(volume) - volume, np.bincount(number, weights=volume)
        piece, split = (before - before[new_gram][number]) // bound + part.astype(np.int64) * 1_000_003, (total[number] > bound) | (part > 0)
        return pd.DataFrame({
            "doc_id": np.concatenate((ids[again], ids[several])), "first": np.concatenate((first[again], first[several])), "n": np.concatenate((n[again] + size - 1, n[several])),
            "gram": pd.array(np.concatenate((np.zeros(again.sum(), np.int64), (gram[several] >> np.uint64(1)).astype(np.int64))), "Int64").astype("Int64"),
            "piece": np.concatenate((np.zeros(again.sum(), np.int64), piece[several])), "split": np.concatenate((np.zeros(again.sum(), bool), split[several])),
            "whole": np.concatenate((np.ones(again.sum(), bool), np.zeros(several.sum(), bool))),
        })

    return of


def _contexts(marks: DataFrame, texts: DataFrame, shards: int, size: int) -> DataFrame:
    """The bytes of the contexts that differ, by shard."""
    wanted = marks.where("not whole").groupBy("doc_id").agg(F.collect_list(F.struct("first", "n", "gram", "piece", "split")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc, text, spans in zip(*(batch.column(k) for k in range(3)), strict=True):
                raw = (text.as_py() or "").encode()
                for s in spans.as_py():
                    for column, value in zip(out, ((s["gram"] + s["piece"] * _STEP) % shards, doc.as_py(), s["first"], s["n"], s["split"], raw[s["first"] : s["first"] + s["n"] + size - 1]), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()), strict=True)], names=["shard", "doc_id", "first", "n", "split", "raw"])

    return texts.join(wanted, "doc_id").select("doc_id", "text", "spans").mapInArrow(run, "shard long, doc_id long, first long, n long, split boolean, raw binary")


def _runs(doc: np.ndarray, place: np.ndarray, size: int) -> dict[str, np.ndarray]:
    """The bytes that strings of size bytes from these places cover."""
    order = np.lexsort((place, doc))
    d, p = doc[order], place[order]
    new = np.concatenate(([True], (d[1:] != d[:-1]) | (p[1:] > p[:-1] + size))) if len(d) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(d)) - 1 if len(d) else begin
    return {"doc_id": d[begin], "first": p[begin], "n": p[last] + size - p[begin]}


def _sorted_repeats(size: int, parts: int):
    """The bytes that strings of a shard's contexts cover which start earlier too, as runs; and the strings of split grams that don't, packed by part of parts."""

    def of(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "first"], kind="stable")
        data = np.frombuffer(b"".join(rows["raw"]), np.uint8)
        n = rows["n"].to_numpy(np.int64)
        at = np.concatenate(([0], np.cumsum(n + size - 1)))[:-1]
        # of each place in data: its rank among starts in order of document and place, or none
        starts = np.repeat(at - np.cumsum(n) + n, n) + np.arange(n.sum())
        rank = np.full(len(data), -1, np.int64)
        rank[starts] = np.arange(len(starts))
        order = suffix_array(data, size)
        order = order[rank[order] >= 0]
        same = common_at_least(data, order[1:], order[:-1], size)
        group = np.cumsum(np.concatenate(([True], ~same))) - 1
        ranks = rank[order]
        doc, place = np.repeat(rows["doc_id"].to_numpy(np.int64), n), np.repeat(rows["first"].to_numpy(np.int64) - np.cumsum(n) + n, n) + np.arange(n.sum())
        least = np.full(group[-1] + 1, len(starts), np.int64)
        np.minimum.at(least, group, ranks)
        first = least[group]
        # the same start can be in the data once only: contexts of one gram don't share starts
        again = ranks[(doc[ranks] != doc[first]) | (place[ranks] != place[first])]
        out = pd.DataFrame(_runs(doc[again], place[again], size)).assign(part=0, packed=None)
        ours = np.unique(first[np.repeat(rows["split"].to_numpy(bool), n)[first]])
        if not len(ours):
            return out
        raw = data.tobytes()
        strings = np.empty(len(ours), _STRING)
        digests = np.frombuffer(b"".join(hashlib.blake2b(raw[k : k + size], digest_size=16).digest() for k in starts[ours].tolist()), "<u8").reshape(-1, 2)
        strings["high"], strings["low"], strings["doc"], strings["at"] = digests[:, 0], digests[:, 1], doc[ours], place[ours]
        part = (strings["high"] % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cut = np.searchsorted(part[order], np.arange(parts + 1))
        sent = np.flatnonzero(np.diff(cut))
        packed = [strings[order[cut[k] : cut[k + 1]]].tobytes() for k in sent]
        return pd.concat([out, pd.DataFrame({"doc_id": -1, "first": 0, "n": 0, "part": sent, "packed": packed})], ignore_index=True)

    return of


def _later(size: int):
    """The bytes of a part's strings that came from other pieces of their gram, where they start earlier."""

    def of(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        strings = np.concatenate([np.frombuffer(x, _STRING) for x in rows["packed"]])
        strings = strings[np.lexsort((strings["at"], strings["doc"], strings["low"], strings["high"]))]
        new = np.concatenate(([True], (strings["high"][1:] != strings["high"][:-1]) | (strings["low"][1:] != strings["low"][:-1])))
        first = strings[np.flatnonzero(new)[np.cumsum(new) - 1]]
        again = strings[(strings["doc"] != first["doc"]) | (strings["at"] != first["at"])]
        return pd.DataFrame(_runs(again["doc"], again["at"], size))

    return of


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[] for _ in range(4)]
        for doc, text, runs in zip(*(batch.column(k) for k in range(3)), strict=True):
            raw = (text.as_py() or "").encode()
            spans = np.array([(r["first"], r["first"] + r["n"]) for r in runs.as_py()], np.int64)
            spans = spans[np.argsort(spans[:, 0], kind="stable")]
            end = np.maximum.accumulate(spans[:, 1])
            new = np.concatenate(([True], spans[1:, 0] > end[:-1]))
            begin, stop = spans[new, 0], end[np.append(np.flatnonzero(new)[1:], len(end)) - 1]
            kept = b"".join(raw[a:b] for a, b in zip([0, *stop.tolist()], [*begin.tolist(), len(raw)], strict=True))
            for column, value in zip(out, (doc.as_py(), len(raw) - len(kept), len(begin), hashlib.sha256(kept).hexdigest()), strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["doc_id", "n_removed", "n_spans", "kept_sha256"])


def repeats(docs: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """(doc_id, first, n): runs of bytes of docs (doc_id, text; no two equal texts) that repeat; they may overlap."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = int(max(1, -(-total * 34 * 2 // (size - gram) // ENTRY_BYTES)))
    frequent = Frequent(frequent_grams(docs, size, gram))
    marks = materialise(
        _listed(docs, shards, size, gram, frequent).groupBy("shard").applyInPandas(_sifted(size, CONTEXT_BYTES, frequent), _MARK + ", whole boolean"), "marks"
    )
    volume, split = marks.where("not whole").agg(F.sum(F.col("n") + size - 1), F.sum(F.when(F.col("split"), F.col("n")))).first()
    sorts = int(max(1, -(-(volume or 0) // CONTEXT_BYTES)))
    parts = int(max(1, -(-(split or 0) * _STRING.itemsize // ENTRY_BYTES)))
    found = _contexts(marks, docs, sorts, size).groupBy("shard").applyInPandas(_sorted_repeats(size, parts), "doc_id long, first long, n long, part int, packed binary")
    whole = marks.where("whole").select("doc_id", "first", "n")
    if not split:
        return whole.unionByName(found.select("doc_id", "first", "n"))
    found = materialise(found, "pieces")
    later = found.where("packed is not null").groupBy("part").applyInPandas(_later(size), "doc_id long, first long, n long")
    return whole.unionByName(found.where("packed is null").select("doc_id", "first", "n")).unionByName(later)


def deduplicate(docs: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of docs (doc_id, text)."""
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"))
    facts = materialise(keyed.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest"), "digests")
    order_of = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    groups = facts.where(f"n_bytes >= {size}").groupBy("digest").agg(F.min(order_of).alias("winner"), F.count("*").alias("size")).where("size > 1").drop("size")
    copies = materialise(facts.join(groups, "digest").where(order_of != F.col("winner")).select("doc_id", "digest").distinct(), "copies")
    long_ = keyed.where(F.octet_length("text") >= size)
    alone = facts.where(f"n_bytes >= {size}").join(copies, ["doc_id", "digest"], "left_anti")
    if alone.where("doc_id is null").isEmpty() and alone.groupBy("doc_id").count().where("count > 1").isEmpty():
        firsts = long_.join(copies.hint("merge"), ["doc_id", "digest"], "left_anti").select("doc_id", "text")
        number = None
    else:  # ids that don't tell documents apart: they are numbered, in the order of id and digest
        number = materialise(alone.select("doc_id", "digest").distinct().orderBy("doc_id", "digest").withColumn("seq", F.monotonically_increasing_id()), "numbers")
        firsts = long_.join(number.withColumnRenamed("doc_id", "own"), "digest").where(F.col("doc_id").eqNullSafe(F.col("own"))).dropDuplicates(["seq"]).select(F.col("seq").alias("doc_id"), "text")
    firsts = materialise(firsts, "firsts")
    found = materialise(repeats(firsts, size, gram), "repeats")
    runs = found.groupBy("doc_id").agg(F.collect_list(F.struct("first", "n")).alias("runs"))
    cut = firsts.join(runs, "doc_id").select("doc_id", "text", "runs").mapInArrow(_cut, "doc_id long, n_removed long, n_spans long, kept_sha256 string")
    empty = hashlib.sha256(b"").hexdigest()
    rows = facts.alias("f").join(copies.withColumn("copy", F.lit(True)).alias("c"), (F.col("f.digest") == F.col("c.digest")) & (F.col("f.doc_id") == F.col("c.doc_id")), "left").select("f.*", "copy")
    if number is None:
        rows = rows.join(cut, "doc_id", "left")
    else:
        cut = cut.withColumnRenamed("doc_id", "seq").join(number, "seq").drop("seq")
        rows = rows.alias("f").join(cut.alias("n"), (F.col("f.digest") == F.col("n.digest")) & F.col("f.doc_id").eqNullSafe(F.col("n.doc_id")), "left").select("f.*", "n_removed", "n_spans", "kept_sha256")
    return rows.select(
        "doc_id", "n_bytes",
        F.when(F.col("copy"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("copy"), F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(F.col("copy"), F.lit(empty)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("digest")))).alias("kept_sha256"),
    )


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each row of documents loses to earlier strings of 100 bytes."""
    return deduplicate(documents(spark, sf_dir))
