import json

import pytest

from pyspark.sql import functions as F

from inkmill.sources import cache, readers, sinks


def test_texts_with_bad_bytes(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one\ntwo \xff end")
    row = readers.read_texts(spark, str(tmp_path / "a.txt")).first()
    assert row["text"] == "one\ntwo � end" and row["path"].endswith("a.txt")
    assert readers.from_text(spark, "x").first()["text"] == "x"


def test_manifest_shapes(spark, tmp_path):
    source = {"author": "ada", "genre": "essay", "url": "https://a"}
    for name, blob in (("bare", [source, source]), ("wrapped", {"sources": [source]})):
        (tmp_path / name).write_text(json.dumps(blob))
        assert readers.read_manifest(spark, str(tmp_path / name)).select("url").first()["url"] == "https://a"
    (tmp_path / "bad").write_text(json.dumps([source, {"author": "b"}]))
    with pytest.raises(ValueError, match="no url"):
        readers.read_manifest(spark, str(tmp_path / "bad"))


def test_model_with_and_without_axes(spark, tmp_path):
    one = {"keys": ["a"], "weights": [0.5], "bias": 1.0}
    (tmp_path / "m").write_text(json.dumps({"axes": {"x": one}}))
    (tmp_path / "n").write_text(json.dumps(one))
    assert readers.read_model(spark, str(tmp_path / "m")) == {"x": ((("a", 0.5),), 1.0)}
    assert readers.read_model(spark, str(tmp_path / "n")) == {"score": ((("a", 0.5),), 1.0)}


def test_split_rows_are_worked_out_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)
    mark = F.udf(lambda status: (seen.add(1), status)[1], "string")
    rows = spark.createDataFrame([(1, "ok"), (2, "thin"), (3, None)], "id long, status string").select("id", mark("status").alias("status"))
    sinks.write_split(rows, "ok", str(tmp_path / "ok"), str(tmp_path / "failed"))
    assert seen.value == 3


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "ok"), (2, "thin"), (3, None)], "id long, status string")
    sinks.write_split(rows, "ok", str(tmp_path / "ok"), str(tmp_path / "failed"))
    assert spark.read.parquet(str(tmp_path / "ok")).count() == 1 and spark.read.parquet(str(tmp_path / "failed")).count() == 2
    sinks.write_json(rows, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 3
    found = spark.createDataFrame([(1, 1, 12, "em dash density", "20.0/1k vs floor 14.0/1k")], "doc_id long, place long, count long, label string, why string")
    assert sinks.report(found).first()["line"] == "  [ 12x] em dash density                    20.0/1k vs floor 14.0/1k"


def resumable(spark, tmp_path):
    return sinks.Resumable(spark, str(tmp_path / "table"), "id long, text string", ["id"])


def test_a_broken_run_leaves_nothing(spark, tmp_path, monkeypatch):
    rows = spark.range(200).repartition(8).select("id", F.concat(F.lit("t"), "id").alias("text"))
    sink = resumable(spark, tmp_path)
    assert sink.read().count() == 0 and sink.pending(rows).count() == 200
    sink.append(rows.where("id % 3 = 0"))
    with pytest.raises(Exception, match="broken"):  # some tasks have written their files by then
        sink.append(rows.withColumn("text", F.when(F.col("id") == 199, F.raise_error(F.lit("broken"))).otherwise(F.col("text"))))
    with monkeypatch.context() as m:
        m.setattr(sinks.Resumable, "commit", lambda *a: (_ for _ in ()).throw(OSError("gone before the commit")))
        with pytest.raises(OSError, match="gone"):
            sink.append(rows)
    assert sink.read().count() == 67 and sink.pending(rows).count() == 133
    resumable(spark, tmp_path).append(rows)
    assert sorted(r["id"] for r in sink.read().collect()) == list(range(200)) and len(sink.runs()) == 2
    sink.append(rows)
    assert sink.read().count() == 200


def test_two_runs_at_a_time(spark, tmp_path, monkeypatch):
    rows, sink, other = spark.range(10).select("id", F.lit("x").alias("text")), resumable(spark, tmp_path), resumable(spark, tmp_path)
    commit, first = sinks.Resumable.commit, []

    def late(self, run, after):
        if self is sink and not first:
            first.append(run)
            other.append(rows.where("id < 6"))
        return commit(self, run, after)

    monkeypatch.setattr(sinks.Resumable, "commit", late)
    sink.append(rows)
    assert sorted(r["id"] for r in sink.read().collect()) == list(range(10)) and len(sink.runs()) == 2


def test_null_and_repeated_keys_are_added_once(spark, tmp_path):
    rows, sink = spark.createDataFrame([(None, "a"), (None, "b"), (1, "c"), (1, "d")], "id long, text string"), resumable(spark, tmp_path)
    for _ in range(2):
        sink.append(rows)
        assert sorted(str(r["id"]) for r in sink.read().collect()) == ["1", "None"]


def test_cache_of_pages(spark, tmp_path):
    path = str(tmp_path / "cache")
    urls = spark.createDataFrame([(1, "https://a"), (2, "https://b"), (2, "https://b"), (3, None), (4, "https://c")], "k long, url string")
    assert {r["status"] for r in cache.fetch(urls, path).collect()} == {"failed: not in the cache", "failed: no url"}
    cache.store(spark.createDataFrame([("https://b", "two"), ("https://b", "too"), (None, "x")], "url string, text string"), path)
    cache.store(spark.createDataFrame([("https://b", "another"), ("https://c", "three")], "url string, text string"), path)
    found = sorted((r["k"], r["text"], r["status"]) for r in cache.fetch(urls, path).collect())
    assert found == [(1, None, "failed: not in the cache"), (2, "too", "cached"), (2, "too", "cached"), (3, None, "failed: no url"), (4, "three", "cached")]
    assert all(len(r["cache_key"]) == 16 for r in cache.fetch(urls.where("url is not null"), path).collect())
