"""Fill-in-the-middle, BPE and ranked search against plain versions, on odd rows and clashing columns."""

import hashlib
import math
import os
import random
import re
from array import array
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkmill.llm import bpe, fill_in_middle, lexical_search, lexicon

SCHEMA = "doc_id long, text string, n long, ids string, form string, item_id long, rank int, score double, term string"


def table(spark, rows):
    """documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, 7, "x", "y", 8, 9, 0.5, "z") for i, t in rows], SCHEMA)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


ODD = [
    (1, None), (2, ""), (3, " \t\r\n"), (4, "a <P> b c d"), (4, "one two three"), (4, "one two three"), (None, "no id here at all"), (6, "\x01\x02 \x02a\x01b x \x02\x02b  "),
    (7, "<S <M P> < a b c"), (8, "日本 語 \U0001f600x  é y　z "), (9, "word " * 40_000), (10, "x" * 200_000), (11, " " * 50_000 + "end"), (12, "a\x00b c"),
]


def filled(doc_id, text, seed=42, share=50, spm=80):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    low, high = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(x in text for x in fill_in_middle.SENTINELS) or h[2] % 100 >= share:
        return len(units), "plain", None, None, None, text
    return (len(units), "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else (len(units), "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("share", [0, 50, 100])
def test_fill_in_middle(spark, share):
    rng = random.Random(share)
    rows = ODD + [(k, "".join(rng.choice(" \n\tab<>PSM\x01\x02é") for _ in range(rng.randint(0, 40)))) for k in range(100, 300)]
    out = fill_in_middle.transform(table(spark, rows), fim_percent=share, spm_percent=50)
    out = out.withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form")))
    got = sorted((repr((r["doc_id"], r["text"], r["n"], r["form"], r["prefix"], r["middle"], r["suffix"], r["output"])) for r in out.collect()))
    assert got == sorted(repr((i, t, *filled(i, t, share=share, spm=50))) for i, t in rows)
    assert out.where("not (back <=> coalesce(text, ''))").isEmpty() and "score" in out.columns
    assert fill_in_middle.transform(table(spark, [])).count() == 0


def test_fill_in_middle_works_in_one_pass(spark):
    plan = fill_in_middle.transform(table(spark, ODD))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_replace(") == 1 and "Exchange" not in plan and "Python" not in plan


tokenizers = pytest.importorskip("tokenizers")
VOCABULARY = bpe.default_tokenizer() if os.path.isdir("/opt/tokenizers") else None


@pytest.fixture(scope="module")
def plain():
    return tokenizers.Tokenizer.from_file(VOCABULARY)


def test_transducer_is_minimal_and_exact(tmp_path):
    rng = random.Random(5)
    words = {bytes(rng.choice(b"abc\xff") for _ in range(rng.randint(1, 7))): tuple(rng.randrange(9) for _ in range(rng.randint(0, 3))) for _ in range(3000)}
    for own in (words, {}, {b"a": (1,)}, {b"a": (1, 2), b"ab": (1, 2, 3), b"abc": (4,)}):
        path = tmp_path / f"lexicon-{len(own)}"
        path.write_bytes(lexicon.compiled(own))
        found, others = lexicon.Transducer(str(path)), [bytes(rng.choice(b"abcd") for _ in range(rng.randint(0, 8))) for _ in range(500)]
        asked = [*own, *others]
        there, count, ids = found(lexicon.Words(asked))
        assert there.tolist() == [w in own for w in asked] and ids.tolist() == [i for w in asked for i in own.get(w, ())]
        assert count.tolist() == [len(own[w]) for w in asked if w in own]
    assert [len(x) for x in found(lexicon.Words([]))] == [0, 0, 0]
    ends = {stem + end: () for stem in (b"walk", b"talk", b"jump") for end in (b"", b"s", b"ed", b"ing")}
    path = tmp_path / "ends"
    path.write_bytes(lexicon.compiled(ends))
    prefixes = {w[:k] for w in ends for k in range(len(w) + 1)}
    futures = {frozenset(w[len(p) :] for w in ends if w.startswith(p)) for p in prefixes}
    assert lexicon.Transducer(str(path)).states == len(futures) == 12

@pytest.mark.skipif(VOCABULARY is None, reason="no tokenizers")
def test_ids_are_joined_without_a_step_an_id(monkeypatch):
    """The bytes of many ids at once; ids that there aren't have none."""
    known = bpe.vocabulary(VOCABULARY)
    monkeypatch.setattr(bpe, "JOINED", 3)
    raw, at = known.joined(np.array([known.single[65], -1, 10**6, known.single[66]]))
    assert raw == b"AB" and at.tolist() == [0, 1, 1, 1, 2]



@pytest.mark.skipif(VOCABULARY is None, reason="no vocabulary here")
def test_bpe_equals_the_tokenizer(spark, plain):
    rng = random.Random(1)
    alphabet = "ab \n\t'sé日本😀͸̀ 1٣…<|endoftext|>"
    rows = ODD + [(13, "a<|endoftext|> b<|endoftext|><|endoftext|>"), (14, "it's we'll  don't\n\n x")]
    rows += [(k, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80)))) for k in range(100, 400)] + [(k, "so it goes on and on") for k in range(400, 420)]
    docs = table(spark, rows)
    for most in (0, 50, 10_000):
        coded = bpe.encode(docs, bpe.compile_lexicon(docs, most=most))
        assert "score" in coded.columns and "text" not in coded.columns
        got = sorted(repr((r["doc_id"], list(r["ids"]))) for r in coded.collect())
        assert got == sorted(repr((i, plain.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
        assert sorted(repr((r["doc_id"], r["text"])) for r in bpe.decode(coded).collect()) == sorted(repr((i, t or "")) for i, t in rows)
    empty = table(spark, [])
    assert bpe.encode(empty, bpe.compile_lexicon(empty)).count() == 0


@pytest.mark.skipif(VOCABULARY is None, reason="no vocabulary here")
def test_decoding_any_ids(spark, plain):
    rng = random.Random(2)
    lists = [None, [], [50256, 5, 50256]] + [[rng.randrange(50257) for _ in range(rng.randint(1, 12))] for _ in range(200)]
    got = bpe.decode(spark.createDataFrame(list(enumerate(lists)), "k long, ids array<int>")).collect()
    assert {r["k"]: r["text"] for r in got} == {k: plain.decode(x or [], skip_special_tokens=False) for k, x in enumerate(lists)}
    assert bpe.decode(spark.createDataFrame([([60_000, None, 5],)], "ids array<int>")).first()["text"] == plain.decode([5], skip_special_tokens=False)


@pytest.mark.skipif(VOCABULARY is None, reason="no vocabulary here")
def test_long_texts_in_parts(plain, monkeypatch, tmp_path):
    monkeypatch.setattr(bpe, "LONG", 10)
    monkeypatch.setattr(bpe, "PART", 3)
    path = tmp_path / "none"
    path.write_bytes(lexicon.compiled({}))
    own = bpe.Encoder(bpe.vocabulary(VOCABULARY), lexicon.Transducer(str(path)))
    for text in ("it goes   on \n\n and on, doesn't it?  ", "日本語 " * 20, "x" * 3000):
        assert list(memoryview(own([text])[0]).cast("I")) == plain.encode(text, add_special_tokens=False).ids


@pytest.mark.skipif(VOCABULARY is None, reason="no vocabulary here")
def test_merging_together_and_alone(plain):
    rng, known = random.Random(9), bpe.vocabulary(VOCABULARY)
    words = [bytes(rng.choice(b"aeinrst thl\xc3\xa9") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    count, ids = known.merged(lexicon.Words(words))
    each = [known.merged_long(w) for w in words]
    assert ids.tolist() == [i for x in each for i in x] and count.tolist() == [len(x) for x in each]
    assert [len(x) for x in known.merged(lexicon.Words([]))] == [0, 0] and known.merged_long(b"") == []


@pytest.mark.skipif(VOCABULARY is None, reason="no vocabulary here")
def test_words_are_forgotten_and_learnt_again(plain, monkeypatch, tmp_path):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    monkeypatch.setattr(bpe, "BLOCK", 3)
    monkeypatch.setattr(bpe, "PART", 4)
    path = tmp_path / "few"
    path.write_bytes(lexicon.compiled({w.encode(): tuple(plain.encode(w, add_special_tokens=False).ids) for w in ("it", " goes", " on")}))
    own = bpe.Encoder(bpe.vocabulary(VOCABULARY), lexicon.Transducer(str(path)))
    texts = ["it goes on and on, and on", None, "a verylongword" + "abc" * 40, "it goes<|endoftext|> up", "and down it goes on"] * 3
    for _ in range(3):
        assert [list(memoryview(x).cast("I")) for x in own(texts)] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]


@pytest.mark.skipif(VOCABULARY is None, reason="no vocabulary here")
def test_words_are_split_like_the_tokenizers():
    known = bpe.vocabulary(VOCABULARY)
    every = [*range(0x600), *range(0x2000, 0x2100), 0x3000, 0x65E5, 0x1F600, 0x10940, 0x323B0]
    for text in [f"a{chr(c)}1{chr(c)} {chr(c)}!{chr(c)}  {chr(c)}'s{chr(c)}\n{chr(c)}'{chr(c)}'ll  " for c in every]:
        assert [w for part in known.words(text) for w in part] == [text[a:b] for _, (a, b) in known.own_split(text)]


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def best(docs, items, k=10):
    held = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in sorted(set(items), key=repr):
        scores = []
        for i, c in held:
            m = 100 - 75 + (75 * sum(c.values()) * n_docs) // total
            scores.append((-sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c), i is None, i))
        out += [(item, rank + 1, i, -s) for rank, (s, _, i) in enumerate(sorted(scores)[:k]) if s < 0]
    return sorted(map(repr, out))


def found(rows):
    return sorted(repr((r["item_id"], r["rank"], r["doc_id"], r["score"])) for r in rows.collect())


def test_ranked_search_equals_scoring_everything(spark):
    rng = random.Random(4)
    vocabulary = ["the", "The", "of"] * 10 + ["".join(rng.choice("abcdé日1") for _ in range(rng.randint(1, 4))) for _ in range(200)]
    prose = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", "-", "_", ". "]) for _ in range(n))
    docs = [(1, None), (2, ""), (3, " .,-"), (None, "the zebra"), (5, "zebra the"), (5, "zebra the"), (6, "zebra, the")] + [(k, prose(rng.randint(1, 90))) for k in range(10, 300)]
    docs += [(k, docs[20][1]) for k in range(300, 340)] + [(400, "ab cd " * 30_000)]
    items = [(1, None), (2, ""), (3, "?!"), (4, "the zebra zebra"), (4, "the zebra zebra"), (5, "nothing-known xyzzy"), (None, "zebra")] + [(k, prose(rng.randint(1, 40))) for k in range(10, 40)] + [(10, "of the 日")]
    wanted = spark.createDataFrame([(i, t, 3) for i, t in items], "item_id long, text string, doc_id long")
    index = lexical_search.build(table(spark, docs).repartition(24))
    assert index.segments.count() > 20
    for k, chars in ((10, 8 << 20), (3, 900), (500, 8 << 20)):
        assert found(lexical_search.search(index, wanted, k, chars)) == best(docs, [x for x in items if x[1]], k)
    none = lexical_search.build(table(spark, []))
    assert lexical_search.search(none, wanted).count() == 0 and lexical_search.search(index, wanted.limit(0)).count() == 0
    assert lexical_search.search(lexical_search.build(table(spark, docs[:3])), wanted).count() == 0


def test_bounds_enclose_scores():
    rng = np.random.default_rng(6)
    tf, n = rng.integers(1, 400, 5000), rng.integers(1, 100_000, 5000)
    share = lexical_search.shares(tf, n, 1000, 400_000)
    impact = -(-share // lexical_search.STEP)
    assert (impact <= 255).all() and (impact * lexical_search.STEP >= share).all() and (np.maximum(impact - 1, 0) * lexical_search.STEP <= share).all()


def test_long_texts_have_the_same_terms(monkeypatch):
    text = ("ab-cd " * 500 + "x" * 5000 + " é日 " * 300).encode()
    raw, starts = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    whole, _ = lexical_search.text_terms(raw, starts)
    monkeypatch.setattr(lexical_search, "CHUNK", 777)
    again, at = lexical_search.text_terms(raw, starts)
    assert (whole == again).all() and at.tolist() == [0, len(whole)] and len(whole) == len(terms(text.decode()))
