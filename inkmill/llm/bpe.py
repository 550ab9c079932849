"""Byte-level BPE: encoding with a transducer of frequent words, and decoding.

The words of all texts are counted, and those so frequent that at most WORDS remain are
compiled, with their ids, into a minimal acyclic transducer. The file goes to the shared
folder and from there once to each executor, also to one that comes later, where all
workers map the same pages. A word that isn't in it is merged: the pair of neighbours with
the least rank, the leftmost on ties, until none is left. Workers remember the words they
have met, so neither is done for each occurrence; the new words of some texts take each step together.

Words are split as the tokenizer does, by its pattern; texts with characters that Unicode
has not assigned, about which tables differ, are split by the tokenizer itself, and so are the
strings of added tokens found. Decoding joins the bytes of the ids; what isn't UTF-8 becomes
replacement characters, and ids that the vocabulary lacks are skipped.

Null texts count as empty, which have no ids; null lists of ids give empty texts. Repeated
rows are encoded each for itself. Texts are encoded whole, however long, the words of very
long ones a part at a time. An empty table gives no rows and an empty lexicon, with which every
word is merged. Other columns are kept unless they are called like the result.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import json
import re
import unicodedata
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmill.llm.lexicon import Transducer, Words, compiled, mapped
from inkmill.llm.store import documents, materialise, small_batches
from inkmill.llm.tokens import byte_letters
from inkmill.sources.scratch import new_path

#: Words of the lexicon at most, and bytes of one, and of one that is merged along with others.
WORDS, LONGEST = 1 << 16, 48
#: Words that a task counts, and that a worker remembers, at most at a time.
COUNTED, REMEMBERED = 200_000, 200_000
#: Characters of a text from which on its words are taken a part at a time, and words of a part.
LONG, PART = 1 << 20, 200_000
#: Rows that are decoded together.
DECODED = 128
#: Ids whose bytes are gathered together.
JOINED = 1 << 16
#: New words that are looked up and merged together.
BLOCK = 20_000
#: Fixed value: the pattern by which byte-level vocabularies split words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Characters below it, nearly all of Latin texts, have their classes spelt out, which splits them three times as fast.
NARROW = 0x250


def _narrow() -> tuple[re.Pattern, frozenset[str]]:
    """The pattern for texts of assigned characters below NARROW, and these."""
    kind = {chr(c): unicodedata.category(chr(c)) for c in range(NARROW)}
    letter, digit = ("".join(f"\\u{ord(c):04x}" for c in kind if kind[c][0] == k) for k in "LN")
    blank = r"\t-\r \x85\xa0"
    own = f" ?[{letter}]+| ?[{digit}]+|'(?:[stmd]|re|ve|ll)| ?[^{blank}{letter}{digit}]+|[{blank}]+(?![^{blank}])|[{blank}]+"
    return re.compile(own), frozenset(c for c in kind if kind[c] != "Cn")


class Vocabulary:
    """Merges, splitting and bytes of a byte-level tokenizer file."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            own = json.load(file)
        model, splitter = own["model"], own["pre_tokenizer"] or {}
        if model["type"] != "BPE" or own["normalizer"] or splitter.get("type") != "ByteLevel" or splitter.get("add_prefix_space") or not splitter.get("use_regex") or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError(f"{path}: not a plain byte-level BPE")
        self.own_split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.wide = regex.compile(PATTERN)
        self.narrow, self.plain = _narrow()
        letters, ids = byte_letters(), model["vocab"]
        self.single = np.array([ids[letters[b]] for b in range(256)])
        pairs = [pair if isinstance(pair, list) else pair.split(" ") for pair in model["merges"]]
        self.ranks = {(ids[a], ids[b]): rank for rank, (a, b) in enumerate(pairs)}
        self.made = np.array([ids[a + b] for a, b in pairs])
        self.pairs = np.array([ids[a] << 32 | ids[b] for a, b in pairs])
        self.pair_ranks = np.argsort(self.pairs)
        self.pairs = self.pairs[self.pair_ranks]
        self.byte_ranks = self._rank(*np.broadcast_arrays(self.single[:, None], self.single[None, :]))
        of = {letter: b for b, letter in letters.items()}
        own_bytes = {i: bytes(of[c] for c in t) if all(c in of for c in t) else t.encode() for t, i in ids.items()}
        self.added = {}
        for token in own["added_tokens"]:
            if token["lstrip"] or token["rstrip"] or token["single_word"]:
                raise ValueError(f"{path}: an added token takes its surroundings along")
            self.added[token["content"]] = token["id"]
            own_bytes[token["id"]] = token["content"].encode()
        #: The bytes of all ids side by side, how many each has and where they begin; ids that there aren't have none.
        each = [own_bytes.get(i, b"") for i in range(max(own_bytes) + 2)]
        self.bytes, self.size = np.frombuffer(b"".join(each), np.uint8), np.fromiter(map(len, each), np.int64, len(each))
        self.begin = np.cumsum(self.size) - self.size
        self.added_in = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def words(self, text: str) -> Iterator[list[str]]:
        """The words of a text without added tokens, a part at a time."""
        odd = () if text.isascii() else set(text) - self.plain
        pattern = self.wide if odd else self.narrow
        if odd and any(unicodedata.category(c) == "Cn" for c in odd):
            yield [text[a:b] for _, (a, b) in self.own_split(text)]
        elif len(text) < LONG:
            yield pattern.findall(text)
        else:
            found = (m.group() for m in pattern.finditer(text))
            while part := list(itertools.islice(found, PART)):
                yield part

    def pieces(self, text: str) -> list[str]:
        """What stands between added tokens, with these at the odd places."""
        return self.added_in.split(text) if self.added and any(x in text for x in self.added) else [text]

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of pairs of ids; the number of merges for those that aren't merged."""
        wanted = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
        return np.where(self.pairs[at] == wanted, self.pair_ranks[at], len(self.made))

    def joined(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes that ids stand for, side by side, and where those of each begin and the last end."""
        ids = np.where((ids >= 0) & (ids < len(self.size)), ids, len(self.size) - 1)  # which has none
        size = self.size[ids]
        at, parts = np.concatenate(([0], np.cumsum(size))), []
        for low in range(0, len(ids), JOINED):
            part = slice(low, low + JOINED)
            own = np.repeat(self.begin[ids[part]] - at[:-1][part], size[part])
            parts.append(self.bytes[own + np.arange(at[low], at[low] + len(own))].tobytes())
        return b"".join(parts), at

    def merged(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(how many ids each word has, their ids), by merges alone: each round merges a pair in every word that has one left."""
        none, (n, width) = len(self.made), words.letters.shape
        own = np.arange(width) < words.size[:, None]
        ids = np.where(own, self.single[words.letters], -1).astype(np.int32)
        rank = np.full((n, width), none, np.int32)
        rank[:, :-1] = np.where(own[:, 1:], self.byte_ranks[words.letters[:, :-1], words.letters[:, 1:]], none)
        after, before = (np.tile(np.arange(first, first + width, dtype=np.int8), (n, 1)) for first in (1, -1))  # LONGEST is below 127
        row = np.arange(n if width else 0)
        while len(row):
            k = rank[row].argmin(axis=1)
            least = rank[row, k]
            row, k, least = (x[least < none] for x in (row, k, least))
            gone = after[row, k]
            to = after[row, gone]
            ids[row, k], ids[row, gone], rank[row, gone], rank[row, k], after[row, k] = self.made[least], -1, none, none, to
            more = to < words.size[row]
            r, a, b = row[more], k[more], to[more]
            before[r, b], rank[r, a] = a, self._rank(ids[r, a], ids[r, b])
            a = before[row, k]
            r, a, b = row[a >= 0], a[a >= 0], k[a >= 0]
            rank[r, a] = self._rank(ids[r, a], ids[r, b])
        return (ids >= 0).sum(axis=1), ids[ids >= 0]

    def merged_long(self, word: bytes) -> list[int]:
        """As merged, of one word, with the pairs in a queue, so that the work isn't the square of the length."""
        ids, ranks, n = [int(self.single[b]) for b in word], self.ranks, len(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(ranks[pair], k, *pair) for k, pair in enumerate(itertools.pairwise(ids)) if pair in ranks]
        heapq.heapify(queue)
        while queue:
            rank, k, left, right = heapq.heappop(queue)
            to = after[k]
            if ids[k] != left or to >= n or ids[to] != right:
                continue  # one of the two has become part of another
            ids[k], ids[to], after[k] = int(self.made[rank]), -1, after[to]
            if after[k] < n:
                before[after[k]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b < n and (pair := (ids[a], ids[b])) in ranks:
                    heapq.heappush(queue, (ranks[pair], a, *pair))
        return [i for i in ids if i >= 0]


@functools.lru_cache(maxsize=1)
def vocabulary(path: str) -> Vocabulary:
    """One a worker process."""
    return Vocabulary(path)


class Encoder:
    """The ids of the words that this worker has met, as unsigned 32-bit numbers; those not met since the last clearing go with the next."""

    def __init__(self, known: Vocabulary, lexicon: Transducer):
        self.known, self.lexicon, self.now, self.before = known, lexicon, {}, {}

    def learn(self, words: set[str]) -> None:
        """Makes sure that now has all of these: from the lexicon, or merged."""
        if len(self.now) > REMEMBERED:
            self.before, self.now = self.now, {}
        now, before = self.now, self.before
        new = words.difference(now)
        now.update([(word, before[word]) for word in new if word in before])
        rest = sorted(new.difference(before), key=len)
        for low in range(0, len(rest), BLOCK):
            own_words = rest[low : low + BLOCK]
            raw = [w.encode() for w in own_words]
            short = np.flatnonzero(np.fromiter(map(len, raw), np.int64, len(raw)) <= LONGEST)
            own = Words([raw[k] for k in short])
            there, *found = self.lexicon(own)
            other = self.known.merged(own.take(~there))
            for which, (count, ids) in ((short[there], found), (short[~there], other)):
                data, end = ids.astype("<u4").tobytes(), (4 * np.cumsum(count)).tolist()
                now.update(zip(map(own_words.__getitem__, which.tolist()), map(data.__getitem__, map(slice, [0, *end], end)), strict=True))
            if len(short) < len(raw):
                now.update((w, array("I", self.known.merged_long(x)).tobytes()) for w, x in zip(own_words, raw, strict=True) if len(x) > LONGEST)

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text."""
        out: list[list[bytes]] = [[] for _ in texts]
        waiting, n = [], 0

        def write() -> None:
            self.learn(set().union(*(words for _, words in waiting if not isinstance(words, bytes))))
            of = self.now.__getitem__
            for k, words in waiting:
                out[k].append(words if isinstance(words, bytes) else b"".join(map(of, words)))
            waiting.clear()

        for k, text in enumerate(texts):
            for odd, piece in enumerate(self.known.pieces(text or "")):
                if odd % 2:
                    waiting.append((k, array("I", [self.known.added[piece]]).tobytes()))
                    continue
                for words in self.known.words(piece):
                    waiting.append((k, words))
                    n += len(words)
                    if n > PART:
                        write()
                        n = 0
        write()
        return [b"".join(parts) for parts in out]


@functools.lru_cache(maxsize=1)
def encoder(tokenizer: str, lexicon: str) -> Encoder:
    return Encoder(vocabulary(tokenizer), mapped(lexicon))


def word_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(word, n) of all words of LONGEST bytes at most in docs (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = vocabulary(tokenizer), Counter()

        def flush() -> pa.RecordBatch:
            some = [w for w in counts if len(w.encode()) <= LONGEST]
            out = pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([counts[w] for w in some], pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                for piece in known.pieces(text or "")[::2]:
                    for words in known.words(piece):
                        counts.update(words)
                if len(counts) > COUNTED:
                    yield flush()
        yield flush()

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int = WORDS) -> list[str]:
    """The words from the least frequency class, an eighth of a power of two, with which there are no more than `most`."""
    counts = counts.withColumn("kind", F.floor(F.log2("n") * 8))
    sizes = {r["kind"]: r["size"] for r in counts.groupBy("kind").agg(F.count("*").alias("size")).collect()}  # some hundred classes
    least, held = None, 0
    for kind in sorted(sizes, reverse=True):
        held += sizes[kind]
        if held > most:
            break
        least = kind
    return [] if least is None else [r["word"] for r in counts.where(F.col("kind") >= least).select("word").collect()]


def share_file(spark: SparkSession, data: bytes, label: str) -> str:
    """Puts data into the shared folder and from there to each executor; the name by which SparkFiles finds it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(new_path(spark, label))
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    out.write(data)
    out.close()
    spark.sparkContext.addFile(path.toString())
    return path.getName()


def compile_lexicon(docs: DataFrame, tokenizer: str | None = None, most: int = WORDS) -> str:
    """The lexicon of the frequent words of docs (text): the name under which executors have it."""
    tokenizer = tokenizer or default_tokenizer()
    small_batches(docs.sparkSession)
    known = Vocabulary(tokenizer)
    words = frequent(materialise(word_counts(docs, tokenizer), "word-counts"), most)
    return share_file(docs.sparkSession, compiled({(w := word.encode()): tuple(known.merged_long(w)) for word in words}), "lexicon")


def _with(batch: pa.RecordBatch, used: str, name: str, values: pa.Array) -> pa.RecordBatch:
    """The batch without the column used, and with another at its end."""
    kept = [c for c in batch.schema.names if c != used]
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), values], names=[*kept, name])


def _schema(rows: DataFrame, used: str, added: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != used), added])


def encode(docs: DataFrame, lexicon: str, tokenizer: str | None = None) -> DataFrame:
    """docs with ids, the tokens of text, in its place."""
    tokenizer, docs = tokenizer or default_tokenizer(), docs.drop("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer, SparkFiles.get(lexicon))
        for batch in batches:
            found = own(batch.column("text").to_pylist())
            at = np.cumsum([0, *(len(x) // 4 for x in found)]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(found), np.int32))
            yield _with(batch, "text", "ids", pa.ListArray.from_arrays(pa.array(at), values))

    return docs.mapInArrow(run, _schema(docs, "text", "ids array<int>"))


def decode(rows: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """rows with text, which their ids stand for, in their place."""
    tokenizer, rows = tokenizer or default_tokenizer(), rows.drop("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(tokenizer)
        for batch in batches:
            lists, texts = batch.column("ids"), []
            at, own = lists.offsets.to_numpy(), lists.values.fill_null(-1).to_numpy()
            for low in range(0, len(lists), DECODED):  # a null list has no values
                cut = at[low : low + DECODED + 1]
                raw, ends = known.joined(own[cut[0] : cut[-1]])
                ends = ends[cut - cut[0]].tolist()
                texts += [raw[a:b].decode("utf-8", "replace") for a, b in itertools.pairwise(ends)]
            yield _with(batch, "ids", "text", pa.array(texts, pa.string()))

    return rows.mapInArrow(run, _schema(rows, "ids", "text string"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every row of documents, and digests of the ids and of what they decode to."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    rows = encode(docs, compile_lexicon(docs))
    rows = rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"), "ids")
    return decode(rows).select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
