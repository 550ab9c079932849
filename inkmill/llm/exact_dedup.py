"""Exact deduplication through minimal perfect hashes over the digests seen before.

The rows are split in a history (the lower half of the id range) and new arrivals.
History digests are distinct already after a grouped minimum; they are dealt to shards
by their leading bits, and each shard gets a minimal perfect hash by hash-and-displace:
buckets are placed from the largest to the smallest, each with the first displacement
that sends its digests to free slots, so n digests fill n slots. A slot holds the whole
32-byte digest, the winner's id and the number of rows, so a lookup is checked byte by
byte and a foreign digest can't pass. Arrivals that are found are repeats; those that
aren't group among themselves.

Null text counts as empty; an empty table gives no rows. Texts are equal when identical
after each run of white space becomes one space. Ties go to the smallest id. Of equal rows
of one id, drop_repeats keeps one; rows of one id with differing texts are texts of their
own. Rows without id are in groups with others, never the first unless all lack one, and
stay. Very long texts are normalised and hashed whole. Further columns of the input are
ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmill.llm.store import documents, materialise

#: Digests in a shard, about; a shard's hash is built and used in one task's memory.
SHARD_DIGESTS = 50_000
_BUCKET = 4
_DIGEST = "_inkmill_digest"  # beside the columns of documents
_HASH = "shard int, seeds binary, digests binary, winners binary, sizes binary"


def normalised(text: str = "text") -> F.Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and the SHA-256 of the normalised text."""
    return docs.select("doc_id", F.unhex(F.sha2(normalised(), 256)).alias("digest"))


def _spread(h: np.ndarray, seed: np.ndarray) -> np.ndarray:
    x = (h ^ (seed.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def build_hash(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """keys: distinct digests as n x 4 words. (displacement by bucket, slot by key): the slots are 0 to n - 1, each once."""
    n = len(keys)
    n_buckets = max(1, -(-n // _BUCKET))
    bucket = (keys[:, 1] % np.uint64(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    at = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
    seeds, slots, free = np.zeros(n_buckets, np.uint32), np.zeros(n, np.int64), np.ones(n, bool)
    for b in np.argsort(-np.diff(at), kind="stable"):
        own = order[at[b] : at[b + 1]]
        if not len(own):
            break
        h, first = keys[own, 2] ^ keys[own, 3], 0
        while True:
            tried = np.arange(first, first + 64, dtype=np.uint32)
            put = (_spread(h[None, :], tried[:, None]) % np.uint64(n)).astype(np.int64)
            good = free[put].all(axis=1)
            if len(own) > 1:
                ordered = np.sort(put, axis=1)
                good &= (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
            if good.any():
                k = int(np.argmax(good))
                seeds[b], slots[own] = tried[k], put[k]
                free[put[k]] = False
                break
            first += 64
            if first > 1 << 26:
                raise RuntimeError("no displacement found: are the digests distinct?")
    return seeds, slots


def find_slots(keys: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    bucket = (keys[:, 1] % np.uint64(len(seeds))).astype(np.int64)
    return (_spread(keys[:, 2] ^ keys[:, 3], seeds[bucket]) % np.uint64(n)).astype(np.int64)


def _words(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(digests), ">u8").reshape(-1, 4).astype(np.uint64)


def _hash_shard(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    seeds, slots = build_hash(_words(rows["digest"]))
    by_slot = rows.iloc[np.argsort(slots)]
    return pd.DataFrame([{
        "shard": key[0], "seeds": seeds.tobytes(), "digests": b"".join(by_slot["digest"]),
        "winners": by_slot["winner"].to_numpy(np.int64).tobytes(), "sizes": by_slot["size"].to_numpy(np.int64).tobytes(),
    }])


def _merge(key: tuple, rows: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    """The groups of a shard that have two rows or more: repeats of history under its winners, the others among themselves."""
    digest, keep, size = list(rows["digest"]), rows["winner"].astype("Int64"), rows["size"].to_numpy(np.int64)
    if not len(index):
        out = pd.DataFrame({"digest": digest, "keep_id": keep, "group_size": size})
        return out[out["group_size"] > 1]
    held = index.iloc[0]
    slots = np.frombuffer(held["digests"], np.uint8).reshape(-1, 32)
    winners, sizes = (np.frombuffer(held[c], np.int64) for c in ("winners", "sizes"))
    sizes = sizes.copy()
    member = np.zeros(len(rows), bool)
    if len(rows):
        slot = find_slots(_words(rows["digest"]), np.frombuffer(held["seeds"], np.uint32), len(slots))
        member = (slots[slot] == np.frombuffer(b"".join(digest), np.uint8).reshape(-1, 32)).all(axis=1)
        np.add.at(sizes, slot[member], size[member])
    again = np.flatnonzero(sizes > 1)
    old = pd.DataFrame({"digest": [slots[k].tobytes() for k in again], "keep_id": pd.array(winners[again], "Int64"), "group_size": sizes[again]})
    new = pd.DataFrame({"digest": digest, "keep_id": keep, "group_size": size})[~member]
    return pd.concat([old, new[new["group_size"] > 1]])


def _shard(n: int) -> F.Column:
    return F.expr(f"cast(pmod(conv(substring(hex(digest), 1, 12), 16, 10), {n}) as int)")


def grouped(keyed: DataFrame) -> DataFrame:
    """Rows of one digest become one, before anything is dealt by shard: a digest with a third of all rows is one row here."""
    return keyed.groupBy("digest").agg(F.min("doc_id").alias("winner"), F.count("*").alias("size"))


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """One row a shard with the perfect hash over the distinct digests of (doc_id, digest)."""
    return grouped(history).withColumn("shard", _shard(shards)).groupBy("shard").applyInPandas(_hash_shard, _HASH)


def groups(arrivals: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """digest, keep_id and group_size of each group of two rows or more in the history and the arrivals."""
    return (
        grouped(arrivals).withColumn("shard", _shard(shards)).groupBy("shard").cogroup(index.groupBy("shard"))
        .applyInPandas(_merge, "digest binary, keep_id long, group_size long")
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """doc_id, digest, keep_id and group_size of every row."""
    keyed = materialise(digests(docs), "digests")
    low, high, n = keyed.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    split = 0 if low is None else (low + high) // 2
    shards = max(1, -(-n // SHARD_DIGESTS))
    old = F.coalesce(F.col("doc_id") <= split, F.lit(False))
    index = materialise(build_index(keyed.where(old), shards), "perfect-hash", shards * SHARD_DIGESTS)
    found = groups(keyed.where(~old), index, shards)
    return keyed.join(found, "digest", "left").select(
        "doc_id", "digest", F.coalesce("keep_id", "doc_id").alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size")
    )


def drop_repeats(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    found = deduplicate(docs)
    gone = found.where("doc_id <> keep_id").select("doc_id", "digest").distinct()
    keyed = docs.withColumn(_DIGEST, F.unhex(F.sha2(normalised(), 256)))
    kept = keyed.alias("d").join(gone.alias("g"), (F.col("d.doc_id") == F.col("g.doc_id")) & (F.col(f"d.{_DIGEST}") == F.col("g.digest")), "left_anti")
    if not found.groupBy("doc_id", "digest").count().where("doc_id is not null and count > 1").isEmpty():
        named = kept.where("doc_id is not null").dropDuplicates(["doc_id", _DIGEST])  # equal rows of one id
        kept = named.unionByName(kept.where("doc_id is null"))
    return kept.drop(_DIGEST)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row of documents with the row that stays for it."""
    return deduplicate(documents(spark, sf_dir)).select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


ORACLE = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
