import difflib
import math
import random
import time

import numpy as np
import pandas as pd
import pytest

from inkmill.functions.similarity import matching, similarity, token_similarity
from inkmill.operators import dataset, grading, pairwise, reports, taste
from inkmill.sources import fixtures, readers
from tests.test_judged import gradient_fit


def test_numbers_are_formatted_as_by_c(spark):
    values = [0.125, 0.145, 0.135, 1.005, -0.0004, 0.0, 2.5, 1234.5]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    found = df.select("v", reports.fixed(df["v"], 2).alias("two"), reports.fixed(df["v"], 3, True).alias("signed")).collect()
    assert [(r["two"], r["signed"]) for r in found] == [(f"{v:.2f}", f"{v:+.3f}") for v in values]


def test_halves_are_formatted_as_by_c(spark):
    values = [0.0005, -0.0005, 0.0015, 0.005, 0.0625, 0.5, 0.375, -2.5e-4, -0.0, 8.5e-3, None] + [k / 2000 for k in range(-999, 999, 2)] + [k / 200 for k in range(1, 999, 2)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    found = df.select("v", reports.fixed(df["v"], 2).alias("two"), reports.fixed(df["v"], 3, True).alias("signed")).collect()
    assert [(r["two"], r["signed"]) for r in found] == [(None, None) if v is None else (f"{v:.2f}", f"{v:+.3f}") for v in values]


def test_style_report(spark):
    rows = spark.createDataFrame([(1, 120, 9), (2, 50, 4)], "doc_id long, words long, sentences long")
    notes = spark.createDataFrame([(1, "repeated_opening_rate", 0.5, "more open the same way", "0.5 vs floor"), (1, "mtld", 40.0, "narrow", "40 vs 60")], "doc_id long, metric string, value double, note string, detail string")
    openings = spark.createDataFrame([(1, "it is", 3, 1), (1, "it's a", 2, 2)], "doc_id long, opening string, n long, place long")
    found = reports.style_report(rows, notes, False, openings).orderBy("doc_id", "place").collect()
    assert [r["line"] for r in found if r["doc_id"] == 1] == [
        "120 words, 9 sentences, vs absolute floors (no baseline)", "  narrow", "     mtld = 40 vs 60", "  more open the same way", "     repeated_opening_rate = 0.5 vs floor",
        "     most repeated: 'it is' x3, \"it's a\" x2", reports.SHORT_NOTE,
    ]
    assert [r["line"] for r in found if r["doc_id"] == 2] == ["50 words, 4 sentences, vs absolute floors (no baseline)", reports.NOTHING]


def test_fidelity_report_with_dimensions(spark):
    rows = spark.createDataFrame([("ours", 10, 0.4, 0.125, 0.2, "indistinguishable")], "label string, n long, mean_p double, stdev double, fidelity_error double, direction string")
    cells = spark.createDataFrame([("ours", "stance", 1.0), ("ours", "rhythm", 0.5)], "label string, dimension string, normalized double")
    assert [r["line"] for r in reports.fidelity_report(rows, "label", cells).orderBy("place").collect()] == [
        "  ours             p=0.40 (sd 0.12, n=10)  fidelity_error=0.20", " " * 19 + "indistinguishable", " " * 19 + "voice dimensions (1.00 = matched): rhythm=0.50  stance=1.00",
    ]


def plain_blocks(a, b):
    """Words in matching blocks: the longest common run, the earliest in a and then in b, and the same to both its sides."""
    best = (0, 0, 0)
    for i in range(len(a)):
        for j in range(len(b)):
            k = 0
            while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                k += 1
            if k > best[0]:
                best = (k, i, j)
    k, i, j = best
    return 0 if k == 0 else k + plain_blocks(a[:i], b[:j]) + plain_blocks(a[i + k :], b[j + k :])


def test_token_similarity_against_a_plain_reading(spark):
    rng = random.Random(5)
    texts = [([rng.choice("abcde") for _ in range(rng.randrange(30))], [rng.choice("abcdef") for _ in range(rng.randrange(30))]) for _ in range(40)]
    df = spark.createDataFrame([(k, " ".join(a), " ".join(b)) for k, (a, b) in enumerate(texts)] + [(40, None, None)], "k int, a string, b string")
    found = {r["k"]: r["s"] for r in df.select("k", token_similarity(df["a"], df["b"]).alias("s")).collect()}
    for k, (a, b) in enumerate(texts):
        assert found[k] == pytest.approx(2 * plain_blocks(a, b) / (len(a) + len(b)) if a or b else 1.0)
    assert found[40] == 1.0


def test_matching_blocks_equal_the_standard_ones():
    rng = random.Random(7)
    want = lambda a, b: sum(x.size for x in difflib.SequenceMatcher(None, a, b).get_matching_blocks())
    for _ in range(1500):
        letters = "abcdefgh"[: rng.randint(1, 8)]
        a, b = ([rng.choice(letters) for _ in range(rng.randint(0, 25))] for _ in "ab")
        assert matching(a, b) == want(a, b)
    for k in range(120):  # popular tokens in lists of 200 and more
        words = [f"w{j}" for j in range(rng.choice([3, 20, 100, 400]))]
        draw = lambda n: rng.choices(words, [1 / (j + 1) for j in range(len(words))], k=n)  # noqa: B023, E731
        a = draw(rng.randint(150, 700))
        b = list(a) if k % 2 else draw(rng.randint(150, 700))
        for _ in range(rng.randint(0, 60)):
            at = rng.randrange(len(b))
            b[at : at + rng.randint(0, 3)] = draw(rng.randint(1, 3))
        assert matching(a, b) == want(a, b)
    assert similarity(None, " ") == 1.0 and similarity("a", None) == 0.0


def test_matching_is_not_quadratic():
    rng = random.Random(8)
    lists = [[f"w{rng.randrange(3000)}" for _ in range(20_000)] for _ in "ab"]
    took = []
    for n in (2000, 20_000):
        began = time.process_time()
        matching(lists[0][:n], lists[1][:n])
        took.append(time.process_time() - began)
    assert took[1] < 50 * took[0]


def made(n=160):
    rng = np.random.default_rng(3)
    x = rng.random((n, 2)).round(4)
    y = (x @ [1.5, -1] + rng.normal(0, 0.3, n) > 0.2).astype(int)
    return x, y, [None if t else f"gen{k % 2}" for k, t in enumerate(y)]


def plain_auc(pos, neg):
    return (np.sum(pos[:, None] > neg) + 0.5 * np.sum(pos[:, None] == neg)) / (len(pos) * len(neg))


def plain_scores(x, seen, y, at):
    w, b = gradient_fit(x[seen], y[seen])
    return 1 / (1 + np.exp(-(b + x[at] @ w)))


@pytest.fixture(scope="module")
def answered(spark):
    x, y, g = made()
    return spark.createDataFrame([(k, int(t), gen, *map(float, v)) for k, (t, gen, v) in enumerate(zip(y, g, x, strict=True))], "id long, label int, generator string, a double, b double")


def test_cross_validation_against_a_plain_one(spark, answered):
    x, y, _ = made()
    folds = np.array([r["f"] for r in answered.select("id", taste.fold().alias("f")).orderBy("id").collect()])
    p = np.zeros(len(y))
    for k in range(taste.FOLDS):
        p[folds == k] = plain_scores(x, folds != k, y, folds == k)
    aucs = [plain_auc(p[(folds == k) & (y == 1)], p[(folds == k) & (y == 0)]) for k in range(taste.FOLDS)]
    row = taste.cross_validated(answered, ("a", "b")).first()
    assert row["n"] == len(y) and row["accuracy"] == pytest.approx(np.mean((p > 0.5) == y), abs=0.008)
    assert row["mean_auc"] == pytest.approx(np.mean(aucs), abs=0.005) and row["sd_auc"] == pytest.approx(np.std(aucs), abs=0.005)
    assert row["pooled_auc"] == pytest.approx(plain_auc(p[y == 1], p[y == 0]), abs=0.003)


def test_leave_one_generator_out_against_a_plain_one(spark, answered):
    x, y, g = made()
    g = np.array([v or "" for v in g])
    rows = taste.leave_one_generator_out(answered, ("a", "b")).collect()
    assert [r["generator"] for r in rows] == ["gen0", "gen1"]
    for r in rows:
        held = g == r["generator"]
        p = plain_scores(x, ~held, y, np.ones(len(y), bool))
        seen = ~held
        gain = [np.mean(p[seen & (y == 1)] >= t / taste.GRID) + np.mean(p[seen & (y == 0)] < t / taste.GRID) for t in range(1, int(taste.GRID))]
        cut = (int(np.argmax(np.round(gain, 9))) + 1) / taste.GRID
        assert r["n"] == held.sum() and r["threshold"] == pytest.approx(cut, abs=0.006)
        assert r["rejected"] == pytest.approx(np.mean(p[held] < cut), abs=0.03) and r["mean_score"] == pytest.approx(p[held].mean(), abs=0.003)
        assert r["exemplar_mean"] == pytest.approx(p[y == 1].mean(), abs=0.003) and r["auc_vs_exemplars"] == pytest.approx(plain_auc(p[y == 1], p[held]), abs=0.003)


def test_candidates_are_ranked(spark):
    s = {"x": 2.0, "y": 4.0, "z": 1.0}
    rows = [("g", i, j, s[i] / (s[i] + s[j])) for i in s for j in s if i < j]
    found = pairwise.ranked(spark.createDataFrame(rows, "g string, low string, high string, p double"), "g").orderBy("place").collect()
    assert [r["item"] for r in found] == ["y", "x", "z"] and found[0]["strength"] - found[2]["strength"] == pytest.approx(math.log(4), abs=2e-3)
    assert [r["line"] for r in reports.ranking_report(spark.createDataFrame([("g", "a", 0.5, 1), ("g", "b", -0.25, 2)], "g string, item string, strength double, place long"), "g").orderBy("place").collect()] == [
        "  a                  +0.500", "  b                  -0.250",
    ]


def test_strengths_of_a_large_set(spark):
    """A hundred thousand items, ten comparisons each, in one group."""
    n = 100_000
    rng = np.random.default_rng(2)
    goodness = rng.normal(0, 1, n)
    low, high = rng.integers(0, n, 5 * n), rng.integers(0, n, 5 * n)
    low, high = (x[low != high] for x in (low, high))
    pairs = pd.DataFrame({"low": low, "high": high, "p": 1 / (1 + np.exp(goodness[high] - goodness[low]))})
    began = time.process_time()
    found = pairwise._strengths(pairs)
    assert time.process_time() - began < 120 and len(found) == len(np.unique(np.concatenate([low, high])))
    assert np.corrcoef(found["strength"], goodness[found["item"]])[0, 1] > 0.99


def test_numbering_over_partitions(spark):
    rows = spark.createDataFrame([(int(k), int(k) % 7) for k in np.random.default_rng(3).permutation(5000)], "id long, x long").repartition(9)
    assert [r["id"] for r in dataset.numbered(rows, ["id"]).orderBy("pos").collect()] == list(range(5000))
    ties = dataset.numbered(rows, ["x", "id"], "k")
    assert sorted(r["k"] for r in ties.collect()) == list(range(5000)) and ties.where("k = 0").first()["id"] == 0
    assert dataset.numbered(rows.where("false"), ["id"]).count() == 0
    plan = dataset.numbered(rows, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" not in plan


def test_too_few_pages_are_refused(spark):
    rows = spark.createDataFrame([(k, "ok" if k < 3 else "too short") for k in range(9)], "page_id long, status string")
    with pytest.raises(ValueError, match="only 3"):
        dataset.usable_pages(rows)
    assert dataset.usable_pages(rows, 3).count() == 3


def test_fixtures_and_candidates(spark, tmp_path):
    docs = spark.createDataFrame([(k, "ada" if k % 3 else "bob", f"\n# Point {k}\n\nWhat was done.") for k in range(30)] + [(50, None, None)], "doc_id long, author string, text string")
    history = [r.asDict() for r in fixtures.commits(docs).where("author = 'ada'").orderBy("place").collect()]
    assert [r["subject"] for r in history] == [f"point {k}" for k in range(30) if k % 3][-8:] and [r["place"] for r in history] == list(range(8))
    assert {r["author"] for r in fixtures.files(docs).collect()} == {"ada", "bob", None} and fixtures.files(docs.where("false")).count() == 0
    fixtures.write(docs, "ada", str(tmp_path))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["draft.md", "history.md", "notes.md", "repo.txt"]
    found = {r["label"]: r["text"] for r in readers.read_candidates(spark, [f"one={tmp_path}/draft.md", f"two={tmp_path}/notes.md"]).collect()}
    assert found["one"].startswith("point 29\n\n") and found["two"].endswith(fixtures.PLAIN)
    assert readers.read_candidates(spark, []).count() == 0
    graded = spark.createDataFrame([(1, 1, found["one"]), (2, 1, found["two"])], "run_id long, eval_id int, text string")
    passed = {(r["run_id"], r["assertion"]): r["passed"] for r in grading.cleaned_draft(graded).collect()}
    assert passed[1, "items_retained"] and passed[2, "items_retained"] and not passed[1, "bullets_removed"] and passed[2, "bullets_removed"] and not passed[1, "vocabulary_removed"]


def test_once_over_with_known_similarity(spark):
    rows = spark.createDataFrame([(1, 3, "You could do this. Your text reads like you.", "else", 0.1), (2, 3, "You could do this. Your text reads like you.", "else", 0.45)], "run_id long, eval_id int, text string, original string, s double")
    found = {(r["run_id"], r["assertion"]): r["passed"] for r in grading.once_over(rows, rows["s"]).collect()}
    assert (1, "review_few_points") in found and (2, "review_few_points") not in found and found[2, "revision_keeps_wording"] is False
