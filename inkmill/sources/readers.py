"""Reading texts, JSON with a declared schema, and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SOURCE = "author string, genre string, url string, why string, category string, pole string, id string"
FEATURES = "id string, label int, category string, generator string, features map<string,double>"
LADDER = "source_id string, usable boolean, rungs array<struct<level:int,text:string>>"
MODEL = "axes map<string,struct<keys:array<string>,weights:array<double>,bias:double>>, keys array<string>, weights array<double>, bias double"


def read_texts(spark: SparkSession, *paths: str) -> DataFrame:
    """path and text of whole files; bytes that aren't UTF-8 become replacement characters."""
    rows = spark.read.format("binaryFile").load(list(paths))
    return rows.select("path", F.make_valid_utf8(F.expr("cast(content as string)")).alias("text"))


def read_candidates(spark: SparkSession, specs: list[str]) -> DataFrame:
    """label and text of candidates given as LABEL=PATH; of equal labels the last one counts."""
    named = dict(spec.partition("=")[::2] for spec in specs)
    out = None
    for label, path in named.items():  # a handful that the caller lists
        rows = read_texts(spark, path).select(F.lit(label).alias("label"), "text")
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else spark.createDataFrame([], "label string, text string")


def from_text(spark: SparkSession, text: str, doc_id: int = 0) -> DataFrame:
    """One document that the caller already holds, as from standard input."""
    return spark.createDataFrame([(doc_id, text)], "doc_id long, text string")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document or list, with nothing inferred; fields that are missing are null."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Sources from a bare list or an object with "sources"; refused if one has no url."""
    wrapped = read_json(spark, path, f"sources array<struct<{SOURCE.replace(' string', ':string')}>>, {SOURCE}")
    inner = wrapped.where("sources is not null").select(F.inline("sources"))
    rows = inner.unionByName(wrapped.where("sources is null").drop("sources"))
    if not rows.where("url is null").isEmpty():
        raise ValueError(f"{path}: a source has no url")
    return rows


def read_model(spark: SparkSession, path: str) -> dict:
    """The axes of a model, also of one that has a single unnamed axis: {axis: (((key, weight), ...), bias)}."""
    row = read_json(spark, path, MODEL).first()
    axes = row["axes"] or {"score": row}
    return {a: (tuple(zip(m["keys"], m["weights"], strict=True)), m["bias"]) for a, m in axes.items()}
