"""Corpora and labelled datasets: ids, excerpts, spreads, assignment, resuming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkmill.functions import matching as M
from inkmill.functions import text as T
from inkmill.functions.metrics import rounded
from inkmill.sources.scratch import written

# Fixed values.
CORPUS_WORDS, DATASET_WORDS, GENERATED_WORDS = 300, 400, 100
TARGET_WORDS, PARAGRAPH_WORDS, PARAGRAPHS, LEAST_PARAGRAPHS, STARTS, LEAST_SHARE = 220, 20, 6, 3, 25, 0.6
LEAST_VALUES = 4


def pole_label(pole: Column) -> Column:
    return F.when(F.startswith(pole, F.lit("exemplar")), F.lit(1)).otherwise(F.lit(0))


def fetched(pages: DataFrame, least: int = CORPUS_WORDS) -> DataFrame:
    """Pages as texts with their ids and a status: ok, or too short with the number of words. No row is dropped."""
    rows = pages.select("page_id", "url", F.explode(F.array(T.html_text(F.col("html")))).alias("text")).withColumn("words", T.blank_words(F.col("text")))
    status = F.when(F.col("words") >= least, F.lit("ok")).otherwise(F.concat(F.lit("too short after extraction ("), F.col("words").cast("string"), F.lit(" words)")))
    return rows.select("page_id", "url", T.content_id(F.col("url"), 16).alias("cache_key"), T.content_id(F.col("url")).alias("id"), "text", "words", status.alias("status"))


def usable_pages(rows: DataFrame, least: int = LEAST_VALUES) -> DataFrame:
    """The pages of fetched(…) that are ok; refused where there are too few of them to derive ranges from."""
    ok = rows.where("status = 'ok'")
    n = ok.limit(least).count()
    if n < least:
        raise ValueError(f"only {n} sources usable: not enough to derive ranges")
    return ok


def failure_counts(rows: DataFrame) -> DataFrame:
    """Rows by the first word of their status."""
    return rows.groupBy(F.split_part("status", F.lit(" "), F.lit(1)).alias("word")).agg(F.count("*").alias("n"))


def excerpts(rows: DataFrame, target: int = TARGET_WORDS) -> DataFrame:
    """One excerpt a page near the target length: id, start, words and text. rows: (page_id, text).

    Lines of more than PARAGRAPH_WORDS words are paragraphs, numbered from 0. From each start but the first
    paragraph, up to PARAGRAPHS of them are added until the target is reached; the sum nearest to it wins,
    the earliest on ties. Pages with fewer than three paragraphs have no excerpt.
    """
    split = rows.select("page_id", F.explode(F.array(_long_lines(F.col("text")))).alias("paras"))
    usable = split.where(F.size("paras") >= LEAST_PARAGRAPHS).withColumn("n", _blank_lengths(F.col("paras")))

    def candidate(i: Column) -> Column:
        own = F.slice(F.col("n"), i + 1, F.lit(PARAGRAPHS))
        start = F.struct(F.lit(0).cast("long").alias("words"), F.lit(0).alias("k"))
        reached = F.aggregate(own, start, lambda s, x: F.when(s["words"] >= target, s).otherwise(F.struct((s["words"] + x).alias("words"), (s["k"] + 1).alias("k"))))
        return F.struct(F.abs(reached["words"] - target).alias("dist"), i.alias("start"), reached["words"].alias("words"), reached["k"].alias("k"))

    last = F.greatest(F.least(F.size("paras") - 1, F.lit(STARTS)) - 1, F.lit(1))
    starts = F.sequence(F.lit(1), last)
    best = F.array_min(F.filter(F.transform(starts, candidate), lambda c: c["words"] >= LEAST_SHARE * target))
    picked = usable.select("page_id", "paras", F.explode(F.array(best)).alias("b")).where("b is not null")
    return picked.select(
        "page_id", F.col("b.start").cast("long").alias("start"), F.col("b.words").alias("words"), F.array_join(F.slice("paras", F.col("b.start") + 1, F.col("b.k")), "\n\n").alias("text")
    )


def _long_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: T.blank_words(x) > PARAGRAPH_WORDS)
    return F.transform(lines, T.stripped)


def _blank_lengths(paras: Column) -> Column:
    return F.transform(paras, T.blank_words)


def _counted(values: DataFrame, by: str, value: str) -> DataFrame:
    """Each distinct value of a group once, with its number n, how many rows lie below it, and the group's rows all.

    The windows run over distinct values, which rounding keeps few, and not over rows.
    """
    each = values.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("n"))
    below = Window.partitionBy(by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return each.withColumns({"below": F.coalesce(F.sum("n").over(below), F.lit(0)), "all": F.sum("n").over(Window.partitionBy(by))})


def _at(place: Column, value: str) -> Column:
    """The value at a place, counted from 0, of a group of _counted(…)."""
    return F.max(F.when((F.col("below") <= place) & (place < F.col("below") + F.col("n")), F.col(value)))


def spread(values: DataFrame) -> DataFrame:
    """metric, n, min, p10, median, p90 and max of (metric, value); null under four values.

    p10 and p90 are values at whole places, the median is interpolated.
    """
    rows, n = _counted(values, "metric", "value"), F.col("all")
    middle = (_at(F.floor((n - 1) / 2), "value") + _at(F.floor(n / 2), "value")) / 2
    enough = F.first("all") >= LEAST_VALUES
    return rows.groupBy("metric").agg(
        F.sum("n").alias("n"),
        *(F.when(enough, rounded(c, 3)).alias(name) for name, c in (
            ("min", F.min("value")), ("p10", _at(F.floor(n * 0.1), "value")), ("median", middle), ("p90", _at(F.least(n - 1, F.floor(n * 0.9)), "value")), ("max", F.max("value")),
        )),
    )


def upper_median(rows: DataFrame, by: str, value: str) -> DataFrame:
    """The value at place n // 2 of each group."""
    return _counted(rows, by, value).groupBy(by).agg(F.first("all").alias("n"), _at(F.floor(F.col("all") / 2), value).alias("upper_median"))


def numbered(rows: DataFrame, by: list[str], name: str = "pos") -> DataFrame:
    """rows with their place by these columns, counted from 0; equal rows in some order.

    Rows are dealt out by range and sorted where they are, and each has its number there and the partition's; what the
    partitions before hold is added. No task sees all rows, and the driver a count a partition.
    """
    ranged = rows.repartitionByRange(*map(F.col, by)).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    ranged = written(ranged, "ranged")
    sizes = ranged.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count("*").alias("n")).collect()
    before, so_far = [], 0
    for part, n in sorted((r["_part"], r["n"]) for r in sizes):
        before.append((part, so_far))
        so_far += n
    starts = rows.sparkSession.createDataFrame(before, "_part long, _before long")
    placed = ranged.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(starts), "_part")  # a row a partition
    return placed.withColumn(name, F.col("_before") + F.col("_at") - F.shiftleft("_part", 33)).drop("_part", "_at", "_before")


def assignments(models: DataFrame, exemplars: DataFrame, per_model: int) -> DataFrame:
    """Which exemplar and brief each model is given: round robin. models: (pos, generator), exemplars: (pos, id)."""
    n = exemplars.agg(F.count("*").alias("n"))
    slots = models.crossJoin(models.sparkSession.range(per_model).select(F.col("id").alias("i"))).crossJoin(F.broadcast(n))  # a model's few slots, and one count
    wanted = slots.where("n > 0").select("generator", "i", F.pmod(F.col("pos") * per_model + F.col("i"), F.col("n")).alias("pos"), F.pmod("i", F.lit(2)).alias("brief"))
    return wanted.join(exemplars.select("pos", F.col("id").alias("mirrors")), "pos").select("generator", "i", "mirrors", "brief")


def pending(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What is still to be done, and may be appended to the sink."""
    return wanted.join(done, keys, "left_anti")


def generated(rows: DataFrame) -> DataFrame:
    """Cleaned texts with their words, and whether they are long enough. rows: (…, text)."""
    return rows.withColumn("text", T.without_preamble(F.col("text"))).withColumn("words", M.blank_words("text")).withColumn("used", F.col("words") >= GENERATED_WORDS)
