import math
import random

import pyarrow as pa
import pytest

from inkmill.operators import dataset, style
from inkmill.functions.metrics import lexical_diversity, rounded


def diversity(*lists):
    return lexical_diversity(pa.array(lists, pa.list_(pa.string()))).tolist()


def measured(spark, *texts, **more):
    rows = spark.createDataFrame([(k, "ada", t) for k, t in enumerate(texts)], "doc_id long, author string, text string")
    return style.measured(rows, "doc_id", "author", **more)


def test_edges(spark):
    none, three, four, unique, few = measured(
        spark, "", "A b. C d. E f.", "A b c. A b d. A b e. A b c d e f g.", " ".join(f"w{k}" for k in range(100)), " ".join(f"w{k}" for k in range(99))
    ).orderBy("doc_id").collect()
    assert (none["words"], none["sent_len_mean"], none["sent_len_cv"], none["longest_flat_run"]) == (0, None, None, 0)
    assert (three["repeated_opening_rate"], three["longest_flat_run"]) == (None, 0)
    assert (four["repeated_opening_rate"], four["longest_flat_run"]) == (0.75, 3)
    assert unique["mtld"] == pytest.approx(100 / 1e-9) and few["mtld"] is None


def test_mtld_of_filler():
    assert diversity(["a"] * 100)[0] == pytest.approx(2.0)
    rng = random.Random(3)
    assert diversity([f"w{rng.randrange(40)}" for _ in range(2000)])[0] == pytest.approx(30, abs=12)


def test_rounding_is_that_of_sql(spark):
    values = [0.575, -0.575, 1.025, 0.145, 4.029 / 474] + [k / 474 for k in range(474)] + [k / 80 for k in range(-160, 160)]
    found = spark.createDataFrame([(v,) for v in values], "v double").select("v", rounded("v", 2).alias("two"), rounded("v", 3).alias("three")).collect()
    half_up = lambda v, n: math.copysign(math.floor(abs(v) * 10**n + 0.5), v) / 10**n
    assert [(r["two"], r["three"]) for r in found] == [(half_up(v, 2), half_up(v, 3)) for v in values]
    assert [half_up(v, 2) for v in values[:4]] == [0.57, -0.57, 1.02, 0.14]


def test_worst_openings(spark):
    rows = spark.createDataFrame([(1, "It is a. It is b. We go c. We go d. On top e. On top f. No x g. No x h.")], "doc_id long, text string")
    assert [(r["opening"], r["n"], r["place"]) for r in style.worst_openings(rows).orderBy("place").collect()] == [("we go", 2, 1), ("on top", 2, 2), ("no x", 2, 3)]


LONG = "One two three four five six. " * 8 + "Seven eight nine ten eleven twelve thirteen fourteen. " * 3


def test_range_single_and_floor(spark):
    samples = measured(spark, LONG, LONG + "And a very much longer closing sentence with a good many more words in it than those before.", with_mtld=False)
    columns = tuple(m for m in style.METRICS if m != "mtld")
    own = style.profile(samples, columns)
    assert {r["n_samples"] for r in own.collect()} == {2}
    draft = measured(spark, "Tiny one. " * 30, with_mtld=False)
    notes = {r["metric"]: r for r in style.compare(draft, own, columns).collect()}
    assert notes["sent_len_mean"]["note"].endswith("falls below anything this author does")
    single = {r["metric"]: r for r in style.compare(draft, own.where("true").withColumn("n_samples", own["n_samples"] * 0 + 1), columns).collect()}
    assert "one sample only" in single["sent_len_mean"]["detail"]
    floors = {r["metric"]: r for r in style.compare(draft, None, columns).collect()}
    assert "sent_len_mean" not in floors and "floor 6.000" in floors["longest_flat_run"]["detail"]


def test_zero_mean_falls_to_floor(spark):
    own = spark.createDataFrame([("ada", "repeated_opening_rate", 0.0, 0.0, 0.0, 3, 3)], "author string, metric string, mean double, lo double, hi double, n_values long, n_samples long")
    draft = measured(spark, "We go up. We go in. We go on. We go by.", with_mtld=False)
    notes = style.compare(draft, own, ("words", "repeated_opening_rate")).collect()
    assert [(n["metric"], n["detail"]) for n in notes] == [("repeated_opening_rate", "0.750 vs floor 0.250")]


def against_sql(spark, folder, name, rows):
    """The rows of a query on documents (doc_id, text, source), once they are those of its SQL."""
    import duckdb

    from inkmill.plans.registry import ORACLES, QUERIES

    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{folder}/documents.parquet")
    found = sorted(tuple(r) for r in QUERIES[name](spark, str(folder)).select("doc_id", "metric", "value", "note", "detail").collect())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{folder}/documents.parquet/*.parquet'")
    assert found == sorted(con.sql(f"SELECT doc_id, metric, value, note, detail FROM ({ORACLES[name]})").fetchall())
    return found


NARROW = " ".join(f"w{k % 12}" for k in range(120))
WIDE = " ".join(f"w{k % 90}" for k in range(120))


def test_range_holds_vocabulary_too(spark, tmp_path):
    found = against_sql(spark, tmp_path, "style_compare_range", [(1, NARROW, None), (2, WIDE, None), (3, NARROW, "ada"), (4, WIDE, "ada"), (5, None, "ada"), (6, "", "bob")])
    assert [(r[0], r[3], r[4].split(" vs ")[1]) for r in found if r[1] == "mtld"] == [(1, "narrower vocabulary range than this author's", "floor 60.000")]


def test_single_holds_drafts_against_one_sample(spark, tmp_path):
    found = against_sql(spark, tmp_path, "style_compare_single", [(1, "Too short.", "ada"), (2, NARROW, "ada"), (3, WIDE, "ada"), (4, LONG, "ada"), (4, LONG + LONG, "bob"), (4, LONG, "bob"), (5, NARROW, None)])
    assert [(r[0], r[1], r[4]) for r in found if r[1] in ("mtld", "sent_len_mean")] == [
        (1, "sent_len_mean", "2.000 vs 120.000 (0.02x) - one sample only, weak signal"), (3, "mtld", "134.400 vs 17.100 (7.86x) - one sample only, weak signal"),
        (4, "sent_len_mean", "6.500 vs 120.000 (0.05x) - one sample only, weak signal"), (5, "mtld", "17.100 vs floor 60.000"),
    ]


def test_mixed(spark):
    own = spark.createDataFrame([("a", "sent_len_mean", 1.0, 10.0, 26.0), ("b", "sent_len_mean", 1.0, 10.0, 25.0), ("c", "sent_len_mean", 1.0, 0.0, 9.0)], "author string, metric string, mean double, lo double, hi double")
    assert {r["author"]: r["mixed"] for r in style.mixed_registers(own).collect()} == {"a": True, "b": False, "c": False}




def test_spread(spark):
    rows = [("x", float(v)) for v in (2, 4, 4, 3, 5, 2, 3, 4, 3, 5)] + [("few", 1.0), ("few", 2.0), ("few", 3.0)]
    found = {r["metric"]: r for r in dataset.spread(spark.createDataFrame(rows, "metric string, value double")).collect()}
    assert tuple(found["x"])[1:] == (10, 2.0, 2.0, 3.5, 5.0, 5.0)
    assert found["few"]["n"] == 3 and found["few"]["median"] is None


def test_excerpt_first_wins(spark):
    para = lambda n: " ".join(["word"] * n)
    text = "\n".join([para(30), para(110), para(110), para(110), para(110), "short line"])
    found = dataset.excerpts(spark.createDataFrame([(1, text), (2, para(30))], "page_id long, text string")).collect()
    assert [(r["page_id"], r["start"], r["words"]) for r in found] == [(1, 1, 220)]


def test_assignment_and_resume(spark):
    models = spark.createDataFrame([(0, "a"), (1, "b")], "pos long, generator string")
    exemplars = spark.createDataFrame([(0, "x"), (1, "y"), (2, "z")], "pos long, id string")
    wanted = dataset.assignments(models, exemplars, 2)
    assert sorted((r["generator"], r["i"], r["mirrors"], r["brief"]) for r in wanted.collect()) == [("a", 0, "x", 0), ("a", 1, "y", 1), ("b", 0, "z", 0), ("b", 1, "x", 1)]
    done = spark.createDataFrame([("b", "z")], "generator string, mirrors string")
    assert dataset.pending(wanted, done, ["generator", "mirrors"]).count() == 3


def test_rarity(spark):
    docs = spark.createDataFrame([(1, "The the rare 3x"), (2, "unknown")], "doc_id long, text string")
    table = spark.createDataFrame([("the", 7.0), ("rare", 3.0), ("zero", 0.0)], "word string, zipf double")
    assert [(r["doc_id"], r["zipf_mean"]) for r in style.rarity(docs, table).collect()] == [(1, 5.67)]


def test_diversity_against_a_walk_along_the_text():
    import random

    from inkmill.functions.metrics import MTLD_THRESHOLD

    rng = random.Random(4)
    for _ in range(60):
        words = [f"w{int(rng.paretovariate(0.6)) % rng.randint(5, 900)}" for _ in range(rng.randint(100, 700))]
        total = 0.0
        for way in (words, words[::-1]):
            begin, whole = 0, 0
            for end in range(1, len(way) + 1):
                if len(set(way[begin:end])) <= MTLD_THRESHOLD * (end - begin):
                    whole, begin = whole + 1, end
            rest = way[begin:]
            total += len(way) / max(1e-9, whole + ((1 - len(set(rest)) / len(rest)) / (1 - MTLD_THRESHOLD) if rest else 0))
        assert diversity(["x"], words, None, words[:3])[1] == pytest.approx(total / 2)
    assert all(map(math.isnan, diversity(["a"] * 99, None))) and diversity() == []


def test_words_of_a_segment_are_counted_once(spark):
    rows = spark.createDataFrame([(1, "ada", "One two. One two three.")], "doc_id long, author string, text string").repartition(2)
    plan = style.measured(rows, "doc_id", "author", with_mtld=False)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") <= 3
