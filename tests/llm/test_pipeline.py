"""The pipeline's stages, each against a plain version on what it was given."""

import os

import pytest

import corpus_pipeline
from inkmill.llm import registry, toxicity
from tests.llm import brute

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = stage(spark, docs, DATA)
        after = {r["doc_id"] for r in docs.collect()}
        if name == "toxicity":
            labels = spark.read.parquet(f"{DATA}/labels.parquet")
            given = spark.read.parquet(f"{DATA}/documents.parquet")
            scores = {r["doc_id"]: r["score"] for r in toxicity.score(given, toxicity.learned(given, labels)).collect()}
            assert after == {i for i in before if scores[i] < toxicity.THRESHOLD}
        elif name == "exact_dedup":
            first = {}
            for i in sorted(before):
                first.setdefault(__import__("re").sub(r"[\x20\x09-\x0D]+", " ", before[i] or ""), i)
            assert after == set(first.values())
        elif name == "ngram_join":
            assert after == {i for i, c in brute.jaccard_components(sorted(before.items())).items() if i == c}
        elif name == "decontamination":
            sets = [s for s in map(brute.shingles, items) if s]
            held = {i for i, t in before.items() if any(100 * len(s & brute.shingles(t)) >= 75 * len(s) for s in sets)}
            assert after == set(before) - held
        else:
            assert after == set(before)
        if k < 4:
            assert docs.columns == columns


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, item_id string, score string, sequence_id string"


def _table(spark, rows):
    """documents with columns whose names the stages use themselves."""
    return spark.createDataFrame([(i, t, None, "s", None, "k", "i", "c", "q") for i, t in rows], SCHEMA)


def test_run_over_odd_rows(spark, tmp_path):
    """Nulls in every column, empty, blank and very long texts, repeated rows and ids, clashing columns: every stage keeps what its docstring says."""
    words = [f"w{k * k % 997}x{k}" for k in range(4000)]
    item = " ".join(words[:20])
    rows = [(1, None), (2, ""), (2, ""), (3, " \n"), (4, " ".join(words)), (4, " ".join(words)), (5, " ".join([*words[:-1], "end"])), (6, item + " more of it"), (7, "a b c d e f"), (7, "g h i j k l"), (None, "m n o p q")]
    _table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(None, item), (1, None), (2, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, None, None), (2, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    left = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # equal to 2: 1 comes first and holds null, which counts as empty; " \n" is one space and stays; 4 and 5 are near, and hold the item
    assert sorted({(r["doc_id"] or 0) for r in left}) == [0, 1, 3, 7] and sum(r["start"] == 0 for r in left) == 5
    _table(spark, []).write.parquet(str(tmp_path / "none/documents.parquet"))
    for name in ("benchmark", "labels"):
        spark.read.parquet(str(tmp_path / f"{name}.parquet")).where("false").write.parquet(str(tmp_path / f"none/{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_run_is_its_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
    key = lambda rows: sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert key(docs.collect()) == key(corpus_pipeline.run(spark, DATA).collect())


def test_registry():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))
    assert set(registry.ORACLES) <= set(registry.QUERIES)
