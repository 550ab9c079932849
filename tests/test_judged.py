import math
import random

import numpy as np
import pytest

from inkmill.operators import fidelity, grading, pairwise, taste


def scores(spark, rows):
    return spark.createDataFrame(rows, "g string, p double, label int")


def test_auc_against_pairs(spark):
    rng = random.Random(4)
    rows = [("g", round(rng.random(), 1), int(rng.random() < 0.4)) for _ in range(60)]
    pos, neg = [p for _, p, y in rows if y], [p for _, p, y in rows if not y]
    want = round(sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg)), 3)
    assert taste.auc(scores(spark, rows), "g").first()["auc"] == pytest.approx(want, abs=1e-3)
    assert taste.auc(scores(spark, [("g", 0.4, 1)]), "g").first()["auc"] is None


def test_youden_takes_the_smallest(spark):
    rows = [("g", 0.2, 0), ("g", 0.3, 0), ("g", 0.7, 1), ("g", 0.9, 1)]
    assert taste.youden(scores(spark, rows), "g").first()["threshold"] == 0.305
    assert taste.youden(scores(spark, [("g", 0.2, 1)]), "g").first()["threshold"] == 0.5


def gradient_fit(x, y):
    n = len(y)
    c = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum())))
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(20000):
        e = (1 / (1 + np.exp(-(b + x @ w))) - y) * c / c.sum()
        w, b = w - 0.25 * (x.T @ e + 0.02 * w), b - 0.25 * e.sum()
    return w, b


def test_fit_has_the_same_optimum(spark):
    rng = np.random.default_rng(1)
    x = rng.random((120, 3))
    y = (x @ [2, -1, 0.5] + rng.normal(0, 0.4, 120) > 0.8).astype(int)
    rows = spark.createDataFrame([(int(t), *map(float, v)) for t, v in zip(y, x, strict=True)], "label int, a double, b double, c double")
    weights, bias = taste.fit(rows, ("a", "b", "c"))
    w, b = gradient_fit(x, y)
    assert np.allclose([v for _, v in weights], w, atol=2e-3) and bias == pytest.approx(b, abs=2e-3)


def test_missing_answers_count_half(spark):
    row = spark.createDataFrame([(1, None, 1.0)], "id int, a double, b double")
    assert row.select(taste.probability((("a", 2.0), ("b", -1.0)), 0.0).alias("p")).first()["p"] == 0.5


def test_published_verdicts(spark):
    #: The published calibration of five formulations.
    rows = [("plain", 1.0, 1.0, 0.14), ("reader", 1.0, 1.0, 0.152), ("craft", 1.0, 1.0, 0.164), ("editor", 1.0, 1.0, 0.136), ("specific", 1.0, 1.0, 0.429), ("none", 1.0, None, 0.1)]
    df = spark.createDataFrame(rows, "f string, a double, r double, b double")
    found = {r["f"]: r["v"] for r in df.select("f", pairwise.verdict(df["a"], df["r"], df["b"]).alias("v")).collect()}
    assert found == {"plain": "VALID", "reader": "VALID", "craft": "VALID", "editor": "VALID", "specific": "weak", "none": "no data"}


def test_bradley_terry_recovers_strengths(spark):
    s = {0: 3.0, 1: 1.5, 2: 0.5}
    rows = [("g", i, j, s[i] / (s[i] + s[j])) for i in s for j in s if i < j]
    found = {r["item"]: r["strength"] for r in pairwise.bradley_terry(spark.createDataFrame(rows, "g string, low int, high int, p double"), "g").collect()}
    assert found[0] - found[2] == pytest.approx(math.log(6), abs=2e-3)


def test_spearman_ties(spark):
    rows = [("g", 1, 1.0), ("g", 2, 1.0), ("g", 3, 2.0), ("flat", 1, 1.0), ("flat", 2, 1.0), ("flat", 3, 1.0), ("two", 1, 1.0), ("two", 2, 2.0)]
    found = {r["g"]: r["rho"] for r in pairwise.spearman(spark.createDataFrame(rows, "g string, x int, y double"), "x", "y", "g").collect()}
    assert found == {"g": 0.866, "flat": None, "two": None}


def test_fidelity_sides(spark):
    rows = [("near", 0.55), ("near", 0.5), ("over", 0.1), ("over", 0.2), ("under", 0.9), ("under", None)]
    found = {r["l"]: (r["fidelity_error"], r["direction"]) for r in fidelity.fidelity(spark.createDataFrame(rows, "l string, p_real double"), "l").collect()}
    assert found == {"near": (0.05, "indistinguishable"), "over": (0.7, "OVERSHOOT"), "under": (0.1, "indistinguishable")}


def test_once_over_modes(spark):
    original = "the first plain sentence here. the second plain sentence — there. " * 3
    rows = spark.createDataFrame([(1, 3, original + "One more.", original), (2, 3, "You could do this. Your text reads like you.\n## One\n> quoted — so", original)], "run_id long, eval_id int, text string, original string")
    found = {(r["run_id"], r["assertion"]): r["passed"] for r in grading.once_over(rows).collect()}
    assert found[1, "revision_keeps_wording"] is True and (1, "review_few_points") not in found
    assert found[2, "review_few_points"] is True and found[2, "review_keeps_habits"] is True and found[2, "mode_suits"] is None


def test_rollup_and_contract(spark):
    runs = spark.createDataFrame([(1, 0), (2, 0)], "run_id long, eval_id int")
    graded = spark.createDataFrame([(1, True), (1, False), (1, None)], "run_id long, passed boolean")
    one, two = grading.rollup(runs, graded).orderBy("run_id").collect()
    assert (one["passed"], one["failed"], one["total"], one["pass_rate"], one["manual_pending"], one["status"]) == (1, 1, 2, 0.5, 1, "graded")
    assert two["status"] == "MISSING" and two["pass_rate"] is None


def test_patterns_are_matched_in_batches(spark):
    """Counts are those of Python's patterns, also after a match, and no check is a Java expression of its own."""
    import re

    from pyspark.sql import functions as F

    from inkmill.functions import matching as M
    from inkmill.operators import grading

    texts = ["", "## a ## b\n##\n## c\n\n##\t1. x\n 2) y", "You're, your; youth you'll x you", "**a** **b**c**d** \x01 **e\n**", "ab. cd! Ef\n gh? I\nj.\tk", ".", "\n", "a", "! b", "it is.", " c"]
    docs = spark.createDataFrame([*enumerate(texts), (len(texts), None)], "id int, text string")
    text = F.col("text")
    columns = [grading.times(text, p) for p in (*grading.POINTS, grading.YOU, grading.BOLD)]
    rows = docs.select(*columns, grading.lowercase_ratio(text), grading.found(text, grading.REVIEW), M.blank_words(text), M.word_count(text)).orderBy("id")
    assert "regexp" not in rows._jdf.queryExecution().executedPlan().toString().lower()
    got = [tuple(r) for r in rows.collect()]
    assert got.pop() == (None, None, None, None, None, 0.0, 0, None, None)
    for text, row in zip(texts, got, strict=True):
        starts = re.findall(r"(?m)(?:^|(?<=[.!?]\s))([A-Za-z])", text)
        words = re.findall(r"\w(?:[\w'-]*\w)?", text)
        want = [len(re.findall(p, text)) for p in (*grading.POINTS, grading.YOU, grading.BOLD)]
        want += [sum(map(str.islower, starts)) / max(len(starts), 1), sum(re.search(p, text) is not None for p in grading.REVIEW), len(text.split()), len(words)]
        assert row == tuple(want), text
