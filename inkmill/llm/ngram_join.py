"""Jaccard self-join on word shingles, size-aware: subsets for light sets, inverted lists for heavy ones.

Links of equal sets need no join: rows are classes by their set, and one set of each class
goes on. A set of s shingles may lack at most m = floor(s / 4) shingles of any partner, so
two partners meet among the first m + 1 shingles of both in any order that all sets share,
and in two shingles among the first m + 2. The order used is by number of sets that hold
the shingle, then by hash: shingles of passages that many documents share come last, and
a set with more than m shingles of its own has no partner at all. Numbers are counted over
all sets: first on a share of the shingles, those with the smallest hashes, which tells most
sets without a partner, and then on all shingles of the other sets.

Light sets (at most `boundary` shingles) are paired where they share one of the fixed-size
subsets (two shingles of the first m + 2); heavy sets scan the inverted lists of their first
m + 1. The boundary is where the estimated work is least: subsets made against list
entries scanned.

Only components are wanted, so a list isn't expanded into its pairs. In a few rounds each set
is held against a hub of its lists, first the one whose shingles are the most common, as
those of a text are that others were copied from. Lists whose sets have become one component
drop out, and the pairs between different components that remain are all verified, where
sizes and the shared shingle's places leave room for a link. Which sizes and places do is
told on the distinct ones of a list first, so that a list of many sets that can't be linked,
as of texts that share most but not enough, is never paired. Every link between classes is
verified on the exact sets: 100 * intersection >= 75 * union. That the sets of a class are
equal is told by a 64-bit signature, over the set and its size.

Null, empty and blank texts have no set, no links and themselves as component. Repeated
rows are one class, also with one id; where rows of one id have differing texts, each takes
part, and drop_near keeps all of them if any is the first of its component. Rows without id take part, aren't
the smallest, and stay. A very long text is one task's work. An empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmill.llm.components import components
from inkmill.llm.store import FILE_ROWS, documents, materialise
from inkmill.llm.words import mix, row_sets, set_signatures, text_blocks

PERCENT = 75
#: Bytes of packed shingles in a shard, about, and the largest size that can be light.
SHARD_BYTES = 8 << 20
MAX_LIGHT = 64
#: Entries of a row of packed shingles, whose sets are known by 16 bits in it, and texts that are packed together.
MOST = 60_000
#: Shards up to which each task writes a row for each of them.
DIRECT = 4096
#: Hub rounds before the remaining pairs are enumerated.
ROUNDS = 2
#: Share of the shingles, those with the smallest hashes, on which sets without a partner are told.
SIFTED = 3 / 8
_LOW16 = np.uint64(0xFFFF)


def lacking(s: np.ndarray) -> np.ndarray:
    """How many shingles of a set of s a partner may lack at most."""
    return s - -(-s * PERCENT // 100)


def set_rows(docs: DataFrame) -> DataFrame:
    """doc_id, n (size of the set) and sig (a hash of the set; null if it is empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sig = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for _, _, raw, starts in text_blocks(batch.column(1)):
                hashes, at = row_sets(raw, starts)
                n.append(np.diff(at))
                sig.append(set_signatures(hashes, at).view(np.int64))
            n, sig = np.concatenate(n), np.concatenate(sig)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(sig, pa.int64(), mask=n == 0)], names=["doc_id", "n", "sig"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, sig long")


def _runs(numbers: np.ndarray) -> list[tuple[int, int]]:
    """Where each run of equal numbers begins and ends: as much work as there are numbers, whatever they could be."""
    cut = np.concatenate(([0], np.flatnonzero(numbers[1:] != numbers[:-1]) + 1, [len(numbers)])).tolist() if len(numbers) else []
    return list(zip(cut[:-1], cut[1:], strict=True))


def _cut(number: np.ndarray, rows: np.ndarray, head: np.ndarray, of: dict[str, np.ndarray], pack, step: int) -> pd.DataFrame:
    """A row a number, or a row `step` numbers in a row: the heads of the sets that occur, what pack makes of the sorted columns, and the numbers themselves if they are several."""
    order = np.argsort(number, kind="stable")
    number, rows, of = number[order], rows[order], {c: x[order] for c, x in of.items()}
    out: list[dict] = []
    for s, e in ((k, min(k + MOST, e)) for s, e in _runs(number // step) for k in range(s, e, MOST)):
        used, renamed = np.unique(rows[s:e], return_inverse=True)
        row = {"number": int(number[s] // step), "head": head[:, used].tobytes(), **pack({c: x[s:e] for c, x in of.items()}, renamed)}
        out.append(row | ({"numbers": number[s:e].astype(np.uint32).tobytes()} if step > 1 else {}))
    return pd.DataFrame(out)


def _regrouped(rows: DataFrame, pack, columns: list[str], nodes, step: int) -> DataFrame:
    """Rows that hold `step` numbers each, as rows of one number.

    Where there are very many numbers, what one task makes for each of them is a few entries, in rows that cost more than
    these. So it goes by ranges of numbers first; a task gathers a range from a `step`-th of the tasks, about as much as
    one number has of all of them, and cuts it by number.
    """

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        heads = [np.frombuffer(x, np.uint64).reshape(3, -1) for x in part["head"]]
        base = np.concatenate(([0], np.cumsum([h.shape[1] for h in heads])))
        own = np.concatenate([nodes(row) + b for row, b in zip(part.itertuples(), base, strict=False)])
        of = {"packed": np.concatenate([np.frombuffer(x, np.uint64) for x in part["packed"]])}
        return _cut(np.concatenate([np.frombuffer(x, np.uint32) for x in part["numbers"]]), own, np.concatenate(heads, axis=1), of, pack, 1)[["number", "head", *columns]]

    return rows.groupBy("number", "part").applyInPandas(run, "number int, head binary, " + ", ".join(f"{c} binary" for c in columns))


def _tokens_of(of: dict, renamed: np.ndarray) -> dict:
    """Shingles by 48 bits over the place of their set in the head."""
    return {"packed": ((of["packed"] & ~_LOW16) | renamed.astype(np.uint64)).tobytes()}


def _values_of(of: dict, renamed: np.ndarray) -> dict:
    """Values as they are, and the place of the set of each."""
    return {"packed": of["packed"].tobytes(), "node": renamed.astype(np.uint32).tobytes()}


def _packed(docs: DataFrame, shards: int, share: float, step: int = 1) -> DataFrame:
    """(number, head, packed): the shingles that can be among the first of their set, by shard."""
    limit = min(2**64 - 1, int(share * 2**64))
    made = pa.schema([("number", pa.int32()), ("head", pa.binary()), ("packed", pa.binary()), *([("numbers", pa.binary())] if step > 1 else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, _, raw, starts in text_blocks(batch.column(0)):
                hashes, at = row_sets(raw, starts)
                n, sig = np.diff(at), set_signatures(hashes, at)
                if len(seen) > 500_000:
                    seen.clear()
                fresh = np.zeros(len(n), bool)
                for r in np.flatnonzero(n):
                    if int(sig[r]) not in seen:
                        seen.add(int(sig[r]))
                        fresh[r] = True
                below = np.concatenate(([0], np.cumsum(hashes <= np.uint64(limit))))
                lower = below[at[1:]] - below[at[:-1]]
                wide = np.where(fresh, np.minimum(n, np.maximum(lower, lacking(n) + 2)), 0)
                rows = np.flatnonzero(fresh)
                for part in range(0, len(rows), MOST):
                    own = rows[part : part + MOST]
                    size = wide[own]
                    first = np.concatenate(([0], np.cumsum(size)))
                    idx = np.repeat(np.arange(len(own)), size)
                    h = hashes[at[own][idx] + np.arange(first[-1]) - first[:-1][idx]]
                    shard = ((mix(h) >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)
                    head = np.stack([sig[own], n[own].astype(np.uint64), lower[own].astype(np.uint64)])
                    rows_of = _cut(shard, idx, head, {"packed": h}, _tokens_of, step)
                    if len(rows_of):
                        yield pa.RecordBatch.from_pandas(rows_of, schema=made, preserve_index=False)

    found = docs.select("text").mapInArrow(run, "number int, head binary, packed binary" + (", numbers binary" if step > 1 else ""))
    if step == 1:
        return found
    return _regrouped(found.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(step))), _tokens_of, ["packed"], lambda row: (np.frombuffer(row.packed, np.uint64) & _LOW16).astype(np.int64), step)


def _shared(key: tuple, rows: pd.DataFrame, buckets: int, step: int = 1) -> pd.DataFrame:
    """The shingles of this shard that several sets have, each over the number of its sets, packed by a bucket of sets."""
    heads = [np.frombuffer(x, np.uint64).reshape(3, -1) for x in rows["head"]]
    base = np.concatenate(([0], np.cumsum([h.shape[1] for h in heads])))
    tokens = np.concatenate([np.frombuffer(x, np.uint64) for x in rows["packed"]])
    node = np.concatenate([(np.frombuffer(x, np.uint64) & _LOW16).astype(np.int64) + b for x, b in zip(rows["packed"], base, strict=False)])
    head = np.concatenate(heads, axis=1)
    sigs, first, name = np.unique(head[0], return_index=True, return_inverse=True)
    node, token = name[node], tokens >> np.uint64(16)
    order = np.lexsort((node, token))
    token, node = token[order], node[order]
    new = np.concatenate(([True], (token[1:] != token[:-1]) | (node[1:] != node[:-1])))
    token, node = token[new], node[new]
    begin = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
    count = np.diff(np.append(begin, len(token)))
    df = np.repeat(count, count)
    keep = df > 1
    token, node, df = token[keep], node[keep], df[keep]
    value = (token << np.uint64(16)) | np.minimum(df, 65535).astype(np.uint64)  # numbers over that only tie in the order, which then goes by hash
    bucket = (sigs[node] % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((node, bucket))
    out = _cut(bucket[order], node[order], head[:, first], {"packed": value[order]}, _values_of, step)
    columns = ["number", "head", "packed", "node", *(["numbers", "part"] if step > 1 else [])]
    return out.assign(part=key[0] % step)[columns] if len(out) else pd.DataFrame(columns=columns)


_PREFIX = "sig long, n long, k1 int, k2 int, alone long, scan long, tokens array<long>"


def _prefixes(key: tuple, rows: pd.DataFrame, share: float) -> pd.DataFrame:
    """The shared shingles among the first m + 1 (k1 of them) and m + 2 (k2) of each set of a bucket, in order; the rest of these nobody else has."""
    limit = np.uint64(min(2**64 - 1, int(share * 2**64)) >> 16)
    heads = [np.frombuffer(x, np.uint64).reshape(3, -1) for x in rows["head"]]
    base = np.concatenate(([0], np.cumsum([h.shape[1] for h in heads])))
    head = np.concatenate(heads, axis=1)
    node = np.concatenate([np.frombuffer(x, np.uint32).astype(np.int64) + b for x, b in zip(rows["node"], base, strict=False)])
    value = np.concatenate([np.frombuffer(x, np.uint64) for x in rows["packed"]])
    sigs, first, name = np.unique(head[0], return_index=True, return_inverse=True)
    node, token, df = name[node], value >> np.uint64(16), (value & _LOW16).astype(np.int64)
    outside = token > limit
    order = np.lexsort((token, np.where(outside, 0, df), outside, node))
    node, token, df, outside = node[order], token[order], df[order], outside[order]
    at = np.searchsorted(node, np.arange(len(sigs) + 1))
    n, lower = head[1][first].astype(np.int64), head[2][first].astype(np.int64)
    held, m = np.diff(at), lacking(n)
    alone = lower - np.bincount(node[~outside], minlength=len(sigs))
    k1, k2 = (np.where(lower >= p, np.clip(p - alone, 0, held), held) for p in (m + 1, m + 2))
    scanned = np.concatenate(([0], np.cumsum(df - 1)))
    scan = scanned[at[:-1] + k1] - scanned[at[:-1]]
    some = np.flatnonzero(k2)
    return pd.DataFrame({
        "sig": sigs[some].view(np.int64), "n": n[some], "k1": k1[some], "k2": k2[some], "alone": alone[some], "scan": scan[some],
        "tokens": pd.Series([token[at[k] : at[k] + k2[k]].astype(np.int64) for k in some], dtype=object),
    })


def _ordered(texts: DataFrame, shingles: int, share: float) -> DataFrame:
    """What _prefixes gives for all sets, with numbers counted on a share of the shingles."""
    shards = int(max(1, -(-int(shingles * share) * 8 // SHARD_BYTES)))
    step = 1 if shards <= DIRECT else math.isqrt(shards - 1) + 1
    schema = "number int, head binary, packed binary, node binary" + (", numbers binary, part int" if step > 1 else "")
    shared = _packed(texts, shards, share, step).groupBy("number").applyInPandas(lambda key, rows: _shared(key, rows, shards, step), schema)
    if step > 1:
        shared = _regrouped(shared, _values_of, ["packed", "node"], lambda row: np.frombuffer(row.node, np.uint32).astype(np.int64), step)
    return materialise(shared.groupBy("number").applyInPandas(lambda key, rows: _prefixes(key, rows, share), _PREFIX), "prefixes", shards * FILE_ROWS)


def choose_boundary(prefixes: DataFrame, largest: int = MAX_LIGHT) -> int:
    """The size up to which subsets are cheaper than list scans, over the sums for each size of at most `largest`."""
    sums = prefixes.where(F.col("n") <= largest).groupBy("n").agg(F.sum(F.expr("k2 * (k2 - 1) / 2")).alias("subsets"), F.sum(F.expr("k1 + scan")).alias("scans")).collect()
    cost = {0: 0.0}
    for b in range(1, largest + 1):
        cost[b] = cost[b - 1] + sum(r["subsets"] - r["scans"] for r in sums if r["n"] == b)
    return min(cost, key=lambda b: (cost[b], b))


def _lists(prefixes: DataFrame, boundary: int) -> DataFrame:
    """Inverted lists of heavy sets and of light ones near the boundary, and subset lists of light sets.

    (key, sig, n, light, pos, center): pos is how many shingles of the set come before the list's in the order, or
    fewer; center is how common the set's first shingles are, which is most for what others were copied from.
    """
    light, center = F.col("n") <= boundary, F.col("scan") / (F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1)
    single = prefixes.where((100 * F.col("n") >= PERCENT * (boundary + 1)) & (F.col("k1") > 0)).select(
        F.posexplode(F.expr("slice(tokens, 1, k1)")).alias("i", "token"), "sig", "n", light.alias("light"), "alone", center.alias("center")
    )
    subset = prefixes.where(light & (F.col("k2") > 1)).select(
        F.explode(F.expr("flatten(transform(slice(tokens, 1, k2 - 1), (x, i) -> transform(slice(tokens, i + 2, k2), y -> named_struct('i', i, 'key', xxhash64(least(x, y), greatest(x, y))))))")).alias("s"),
        "sig", "n", "alone", center.alias("center"),
    )
    return single.select(F.xxhash64("token").alias("key"), "sig", "n", "light", (F.col("alone") + F.col("i")).alias("pos"), "center").unionByName(
        subset.select("s.key", "sig", "n", F.lit(False).alias("light"), (F.col("alone") + F.col("s.i")).alias("pos"), "center")
    )


def _may(a: str, b: str) -> F.Column:
    """Whether sizes, and what is left of both sets from the shared shingle on if it is their first, leave room for a link."""
    needed = f"{PERCENT} * ({a}.n + {b}.n)"
    return F.expr(
        f"100 * least({a}.n, {b}.n) >= {PERCENT} * greatest({a}.n, {b}.n) and not ({a}.light and {b}.light)"
        f" and {100 + PERCENT} * ({a}.n - {a}.pos) >= {needed} and {100 + PERCENT} * ({b}.n - {b}.pos) >= {needed}"
    )


def _hub_pairs(lists: DataFrame, labels: DataFrame | None, turn: int) -> DataFrame:
    """Each set with the hub that most of its lists name: the most central set at first, then that of a component by hash."""
    rows = _labelled(lists, labels)
    rank = F.struct("center", "sig") if turn == 0 else F.struct(F.xxhash64("label", F.lit(turn)).alias("h"), "center", "sig")
    hubs = rows.groupBy("key").agg(F.max_by(F.struct("sig", "n", "light", "pos", "label"), rank).alias("h"))
    met = rows.alias("r").join(hubs, "key").select("r.*", "h").where(
        (F.col("sig") != F.col("h.sig")) & (F.col("label") != F.col("h.label")) & _may("r", "h")
    )
    votes = met.groupBy("sig", F.col("h.sig").alias("hub")).agg(F.count("*").alias("votes"))
    best = votes.groupBy("sig").agg(F.min_by("hub", F.struct(-F.col("votes"), F.col("hub"))).alias("hub"))
    return best.select(F.greatest("sig", "hub").alias("a"), F.least("sig", "hub").alias("b")).distinct()


def _labelled(lists: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The lists with each set's component; lists that are one component are gone."""
    rows = lists.withColumn("label", F.col("sig")) if labels is None else lists.join(labels.withColumnRenamed("node", "sig"), "sig", "left").withColumn("label", F.coalesce("label", "sig"))
    open_ = rows.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    return rows.join(open_, "key", "left_semi")


_PROFILE = ("key", "n", "light", "pos")


def _open_pairs(rows: DataFrame) -> DataFrame:
    """The pairs of sets of different components that a list has and that may be linked.

    Lists are sorted out by their distinct sizes and places first, with the components that each of these has: two kinds
    that are of one component have no pair, and a set meets a kind only if that has another component than its own, and
    a smaller set. So a large component doesn't meet itself.
    """
    kinds = rows.groupBy(*_PROFILE).agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("sig").alias("least"))
    met = kinds.alias("x").join(kinds.alias("y"), "key").where(_may("x", "y")).where("least(x.low, y.low) <> greatest(x.high, y.high)")
    met = met.select("key", *(F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in "xy" for c in _PROFILE[1:]), *(F.col(f"y.{c}").alias(c) for c in ("low", "high", "least")))
    side = lambda s: rows.select("key", F.col("sig").alias(f"{s}_sig"), F.col("label").alias(f"{s}_label"), *(F.col(c).alias(f"{s}_{c}") for c in _PROFILE[1:]))
    some = met.join(side("x"), ["key", *(f"x_{c}" for c in _PROFILE[1:])]).where("x_sig > least and (low <> high or x_label <> low)")
    paired = some.drop("low", "high", "least").join(side("y"), ["key", *(f"y_{c}" for c in _PROFILE[1:])])
    return paired.where("x_sig > y_sig and x_label <> y_label").select(F.col("x_sig").alias("a"), F.col("y_sig").alias("b")).distinct()


def _of_their_sets(rows: DataFrame) -> DataFrame:
    """Of rows (sig, text), those whose text has this signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [set_signatures(*row_sets(raw, starts)).view(np.int64) for _, _, raw, starts in text_blocks(batch.column(1))]
            own = np.concatenate([np.zeros(0, np.int64), *found])
            yield batch.filter(pa.array(own == batch.column(0).to_numpy(zero_copy_only=False)))

    return rows.mapInArrow(run, "sig long, text string")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = np.zeros(batch.num_rows, bool)
            for first in range(0, batch.num_rows, 128):
                part = batch.slice(first, 128)
                sides = [[h[at[r] : at[r + 1]] for _, _, raw, starts in text_blocks(part.column(c)) for h, at in [row_sets(raw, starts)] for r in range(len(at) - 1)] for c in (2, 3)]
                for k, (x, y) in enumerate(zip(*sides, strict=True)):
                    common = int(np.isin(x, y, assume_unique=True, kind="sort").sum())
                    linked[first + k] = 100 * common >= PERCENT * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked)], names=["a", "b", "linked"])

    both = pairs.join(texts.select(F.col("sig").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("sig").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, linked boolean")


def link(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs (doc_id, text)."""
    base = materialise(set_rows(docs), "sets")
    classes = base.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size"))
    sifted = _ordered(docs, base.agg(F.sum("n")).first()[0] or 0, SIFTED)
    n_alive = sifted.count()
    alive = sifted.select("sig").join(classes, "sig").select("sig", F.col("rep").alias("doc_id"))
    held = docs.select(F.col("doc_id").alias("own"), "text").join(alive, F.col("own").eqNullSafe(F.col("doc_id"))).select("sig", "text")
    if not base.where("n > 0").groupBy("doc_id").agg(F.min("sig").alias("low"), F.max("sig").alias("high")).where("low <> high").isEmpty():
        held = _of_their_sets(held)  # an id that has several texts
    texts = materialise(held.dropDuplicates(["sig"]), "texts")
    prefixes = _ordered(texts, sifted.agg(F.sum("n")).first()[0] or 0, 1.0)
    lists = _lists(prefixes, choose_boundary(prefixes))
    lists = materialise(lists.join(lists.groupBy("key").count().where("count > 1").select("key"), "key", "left_semi"), "lists", 10 * n_alive)
    checked, labels = None, None
    for turn in range(ROUNDS + 1):
        if turn < ROUNDS:
            pairs = _hub_pairs(lists, labels, turn)
        else:
            rows = materialise(_labelled(lists, labels), "open-lists", 10 * n_alive)
            pairs = _open_pairs(rows)
        if checked is not None:
            pairs = pairs.join(checked, ["a", "b"], "left_anti")
        found = materialise(_verified(pairs, texts), "verified")  # as many tasks as texts need, and so as many files
        checked = found if checked is None else checked.unionByName(found)
        labels = components(checked.where("linked").select("a", "b"))
    grown = classes.join(labels.withColumnRenamed("node", "sig"), "sig", "left").withColumn("label", F.coalesce("label", "sig"))
    roots = grown.groupBy("label").agg(F.min("rep").alias("component_id"), F.sum("size").alias("rows"))
    roots = materialise(roots.where("rows > 1"), "roots")  # read from a table, so that the join with a large component can be split
    of = grown.join(roots, "label").select("sig", "component_id")
    return base.join(of, "sig", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def drop_near(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay: of each component the one with the smallest doc_id, with all columns."""
    gone = link(docs).groupBy("doc_id").agg(F.bool_and(F.col("component_id") != F.col("doc_id")).alias("gone")).where("gone").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and component of every row of documents."""
    return link(documents(spark, sf_dir))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS v FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(v) = 0 THEN []::VARCHAR[] WHEN len(v) < 5 THEN [array_to_string(v, ' ')]
    ELSE list_distinct(list_transform(range(1, len(v) - 3), lambda i: array_to_string(v[i:i + 4], ' '))) END AS g FROM w
), t AS (SELECT doc_id, len(g) AS n, unnest(g) AS h FROM s),
c AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM t a JOIN t b ON a.h = b.h AND a.doc_id <> b.doc_id AND 4 * a.n >= 3 * b.n AND 4 * b.n >= 3 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), r AS (
  SELECT doc_id, doc_id AS seen FROM s UNION SELECT r.doc_id, c.y FROM r JOIN c ON r.seen = c.x
)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, min(r.seen) AS component_id FROM s JOIN r USING (doc_id) GROUP BY s.doc_id, s.g
"""
