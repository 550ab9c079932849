"""Packing of tokenised documents into sequences of a fixed capacity by minimum bin slack.

A document becomes its token ids and an end id. Whole windows of its ids fill sequences
of their own; what remains of each document, 1 to capacity - 1 ids, is a piece. The
pieces are known to the packer only as a histogram over lengths, so its input has at
most capacity - 1 entries whatever the corpus. It takes the longest length left, and a
subset-sum over bit sets (one integer whose bit s says that the sum s can be reached,
lengths with their counts in binary parts) finds the multiset of the other remaining
lengths that comes closest to the capacity; the counts are traced back through the
kept bit sets. The pattern is used as often as the counts allow. Patterns say which
ranks of each length go where, so pieces find their sequence by their rank: the rank
in a partition, written with the pieces, and the number in the partitions before it.

Null text counts as empty, which still has the end id. Repeated rows, with one id or several,
are packed each for itself; an empty table gives no rows. A very long text is tokenised as a
whole by one task and cut there. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zlib
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkmill.llm.store import documents, materialise
from inkmill.llm.tokens import word_cache

CAPACITY = 4096
END_ID = 2


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("part", pa.int32()), ("rank", pa.int64())])


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of every document, with the task that made them and their rank there among those of their length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, part, seen, end, width = word_cache(tokenizer), TaskContext.get().partitionId(), [0] * (capacity + 1), np.uint32(end_id).astype("<u4").tobytes(), 4 * capacity
        for batch in batches:
            rows: list[tuple] = []
            for row, text in enumerate(batch.column(1)):
                own = cache.ids(text.as_py()) + end
                for at in range(0, len(own), width):
                    piece = own[at : at + width]
                    n = len(piece) // 4
                    rows.append((row, at // 4, n, zlib.crc32(piece), len(own) // 4, part, seen[n]))
                    seen[n] += 1
            row, *columns = zip(*rows, strict=True) if rows else [()] * 7
            ids_of = batch.column(0).cast(pa.int64()).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids_of, *(pa.array(c, t) for c, t in zip(columns, _PIECE.types[1:], strict=True))], schema=_PIECE)

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, rank long")


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, no more of each than counted, whose sum is closest to room from below."""
    mask, parts, reached = (1 << (room + 1)) - 1, [], [1]
    for length in sorted((x for x in counts if 0 < x <= room and counts[x] > 0), reverse=True):
        left, k = min(counts[length], room // length), 1
        while left > 0:
            take = min(k, left)
            reached.append((reached[-1] | reached[-1] << (length * take)) & mask)
            parts.append((length, take))
            left, k = left - take, k * 2
        if reached[-1] >> room & 1:
            break
    total, chosen = reached[-1].bit_length() - 1, {}
    for k in range(len(parts) - 1, -1, -1):
        if not reached[k] >> total & 1:
            length, take = parts[k]
            chosen[length] = chosen.get(length, 0) + take
            total -= length * take
    return chosen


def patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(how many pieces of each length, how often): together they use every piece once."""
    left, out = {k: v for k, v in counts.items() if v > 0}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        chosen = fill(left, capacity - longest)
        left[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(left[x] // n for x, n in chosen.items())
        out.append((chosen, times))
        for x, n in chosen.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
    return out


class Placement:
    """Where the piece of a length with a rank among all of that length goes; whole windows follow one another."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        whole = counts.get(capacity, 0)
        found = patterns({k: v for k, v in counts.items() if k < capacity}, capacity)
        used, rows, sequence = {}, [], whole
        for chosen, times in found:
            offset = 0
            for length in sorted(chosen, reverse=True):
                rows.append((length, used.get(length, 0), chosen[length], sequence, offset))
                used[length] = used.get(length, 0) + chosen[length] * times
                offset += length * chosen[length]
            sequence += times
        if whole:
            rows.append((capacity, 0, 1, 0, 0))
        self.rows = np.array(sorted(rows), np.int64).reshape(-1, 5)
        self.sequences = sequence
        self.first = {int(x): int(np.searchsorted(self.rows[:, 0], x)) for x in np.unique(self.rows[:, 0])}
        self.last = {int(x): int(np.searchsorted(self.rows[:, 0], x, "right")) for x in np.unique(self.rows[:, 0])}

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for x in np.unique(length):
            own = np.flatnonzero(length == x)
            table = self.rows[self.first[int(x)] : self.last[int(x)]]
            at = table[np.searchsorted(table[:, 1], rank[own], "right") - 1]
            within = rank[own] - at[:, 1]
            sequence[own] = at[:, 3] + within // at[:, 2]
            offset[own] = at[:, 4] + within % at[:, 2] * x
        return sequence, offset


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    made = materialise(pieces(docs, tokenizer or default_tokenizer(), capacity, end_id), "pieces")
    by_part = made.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    counts = {int(r["length"]): int(r["n"]) for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    place = Placement(counts, capacity)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, offset = place(b.column("length").to_numpy(), b.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")), pa.array(sequence), pa.array(offset)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    ranked = made.join(bases, ["part", "length"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("rank") + F.col("base")).alias("rank"))
    return ranked.mapInArrow(put, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    return pack(documents(spark, sf_dir))
