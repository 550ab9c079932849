from pyspark.sql import functions as F

from inkmill.functions import detectors as D
from inkmill.operators import tells


def counted(spark, text):
    return {r["key"]: r["count"] for r in D.counts(spark.createDataFrame([(1, text)], "doc_id long, text string"), "doc_id").collect()}


def test_every_detector(spark):
    cases = {
        "em_dash": ("a — b -- c --d", 2), "curly_quotes": ("“a” ‘b’", 4), "emoji": ("☀️ 🇫🇷 →", 5), "bold": ("**a** **b\n**", 1), "ai_vocab": ("Delve, delves; undelved", 2),
        "inline_header_bullets": ("- **A**: x\n* **B:** y", 1), "title_case_headings": ("# The Great Big Plan\n# A plain heading here", 1),
        "negative_parallelism": ("Not only this but that. It isn't just x, it's y; no a, no b, just c", 3), "copula_avoidance": ("It serves as x and marks a day", 2),
        "participial_tail": ("done, ensuring x", 1), "filler": ("In order to win, in terms of cost", 2), "hedge_stack": ("It may, might, could. It may.", 1),
        "chat_artifacts": ("I hope this helps\nCertainly! Here's a plan for you", 3), "cutoff_disclaimer": ("As of my last update, my training data", 2),
        "sycophancy": ("Great question", 1), "generic_uplift": ("only time will tell", 1), "false_range": ("from the small town to the sea", 1),
    }
    for key, (text, n) in cases.items():
        assert counted(spark, text)[key] == n, key
    assert set(counted(spark, "")) == set(D.DETECTORS)
    assert sum(counted(spark, None).values()) == 0


def test_gated_patterns_count_what_plain_ones_do(spark):
    """On texts put together from the words of all patterns, whole and cut, against the patterns as written, case ignored."""
    import random
    import re

    rng = random.Random(11)
    pieces = [*D.VOCABULARY, *D.HEDGES, *(f", {w}" for w in D.PARTICIPLES), *(g for own in D.GATES.values() for g in own), "It's", "isn't just", "no way, no how, just", "from the", "to a", "**b**:", "- ", "\n", ". ", "!", "but", "its", "here's a", "I don't have access to real-time", "serves as", "marks a", "—", "“", "☀", "é", "You're absolutely right", "What a great", "Let me know if you"]
    texts = []
    for _ in range(150):
        words = [rng.choice(pieces) for _ in range(rng.randint(1, 60))]
        texts.append("".join((w[:-1] if rng.random() < 0.1 else w.upper() if rng.random() < 0.1 else w) + rng.choice((" ", " ", " ", "", "\n")) for w in words))
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    from inkmill.functions import text as T

    plain = {r["id"]: (r["p"], r["q"]) for r in docs.select("id", T.prose_scan(F.col("text")).alias("p")).select("id", "p", T.folded(F.col("p")).alias("q")).collect()}
    got = {(r["id"], r["key"]): r["count"] for r in D.counts(docs, "id").collect()}
    for key, (whole, ascii_ones) in D.PATTERNS.items():
        if key != "emoji":
            for k, (p, q) in plain.items():
                want = sum(sum(1 for _ in re.finditer(x, p)) for x in whole) + sum(sum(1 for _ in re.finditer(x, q, re.ASCII)) for x in ascii_ones)
                assert got[k, key] == want, (key, texts[k])


HISTORY = " ".join(["word"] * 195) + " one — two — three — **bold** — **again**"
SLOP = "We delve into a vibrant, robust realm, a testament. " + "plain " * 60 + "I hope this helps. It's not just x, it's y."
CLEAN = "plain words " * 70 + "with one — or two — dashes."


def test_scan_with_and_without_author(spark):
    samples = D.counts(spark.createDataFrame([(1, "ada", HISTORY)], "doc_id long, author string, text string"), "author")
    own = tells.profile(samples)
    rates = {r["key"]: r["rate"] for r in own.collect()}
    assert rates["em_dash"] == 20.0 and rates["ai_vocab"] == 0.0
    drafts = spark.createDataFrame([(1, "ada", SLOP), (2, "ada", CLEAN), (3, "bob", HISTORY)], "doc_id long, author string, text string")
    found = tells.scan(D.counts(drafts, "doc_id", "author"), own).orderBy("doc_id", "place").collect()
    assert [(r["doc_id"], r["key"]) for r in found] == [(1, "ai_vocab"), (1, "negative_parallelism"), (1, "chat_artifacts"), (3, "em_dash")]
    assert found[0]["why"].endswith("vs author 0.0/1k") and found[3]["why"].endswith("vs floor 14.0/1k") and found[1]["why"] == "never author voice"


def test_short_samples_are_named(spark):
    docs = spark.createDataFrame([(1, "ada", "word " * 24), (2, "ada", "word " * 25)], "doc_id long, author string, text string")
    assert [r["used"] for r in tells.samples_used(docs, "author").orderBy("doc_id").collect()] == [False, True]
    assert tells.profile(D.counts(docs, "author")).first()["n_docs"] == 1


def test_register(spark):
    D.register_detector("semicolon", "semicolons", True, 1.0, 1, lambda text, plain: F.regexp_count(plain, F.lit(";")))
    try:
        assert counted(spark, "a; b; c")["semicolon"] == 2
    finally:
        del D.DETECTORS["semicolon"]


def test_stream(spark, tmp_path):
    from inkmill.streaming.detect import stream_counts

    spark.createDataFrame([(1, "a — b — c")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    stream = stream_counts(spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in")), "doc_id")
    query = stream.writeStream.format("memory").queryName("counts").start()
    query.processAllAvailable()
    query.stop()
    assert spark.sql("select count from counts where key = 'em_dash'").first()[0] == 2


def test_matches_on_one_line_and_in_one_word(spark):
    """Where a pattern looks back, what stood before counts, also after a match."""
    assert counted(spark, "- **a**:- **b**: c\n- **d**:")["inline_header_bullets"] == 2
    assert counted(spark, "Certainly! Certainly!\n\n of course, of course,")["chat_artifacts"] == 2
    assert counted(spark, "from the town to afrom the town to bee, from here on to there")["false_range"] == 2


def test_detectors_count_in_one_pass_of_batches(spark):
    """A pattern is no Java expression of its own, which took 18 of 22 seconds, and a filter doesn't make a text be counted twice."""
    docs = spark.createDataFrame([(1, "ada", HISTORY), (2, None, None), (3, "bob", "x " * 1_500_000), (4, "bob", "")], "doc_id long, author string, text string")
    rows = D.counts(docs, "doc_id", "author").where("count > 0 and words >= 25")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "regexp" not in plan.lower() and plan.count("ArrowEvalPython") == 1
    assert {(r["doc_id"], r["key"]): (r["words"], r["count"]) for r in rows.collect()} == {(1, "em_dash"): (200, 4), (1, "bold"): (200, 2)}
    assert {r["doc_id"]: r["words"] for r in D.counts(docs, "doc_id").collect()} == {1: 200, 2: 0, 3: 1_500_000, 4: 0}
    assert D.counts(docs.where("false"), "doc_id").count() == 0


def test_copies_are_as_the_columns_have_them(spark):
    import pyarrow as pa

    from inkmill.functions import copies
    from inkmill.functions import text as T

    texts = ["", "a-b 'c' d-'-e -- _f", "na\u00efve\u00a0\u4e2d\u6587\u2003\u0661 \u2014x\x0b\x1fy", "---\nhead\n---\nbody `code` x\n> quoted\n```\nfence\n```\nend", "> a\n\u00a0> b\nc", "-", "'a", "b'"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", T.prose_scan(F.col("text")).alias("p"))
    want = [tuple(r) for r in docs.select("p", T.folded(F.col("p")), T.word_count(F.col("p"))).orderBy("id").collect()]
    prose = copies.prose_scan(pa.array(texts))
    own, at = copies.folded(prose)
    assert list(zip(prose.to_pylist(), copies.as_texts(own, at).to_pylist(), copies.word_counts(own, at).tolist(), strict=True)) == want
