"""Rhythm and range of documents, profiles of them, and comparison with a profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkmill.functions import metrics as M
from inkmill.functions import text as T
from inkmill.functions.metrics import rounded

# Fixed values.
SAMPLE_WORDS = 40
#: Metrics held against an author from both sides: band of ratios for one sample, and how it is named.
MATCH = (
    ("sent_len_mean", 0.60, 1.70, "sentence length"), ("sent_len_cv", 0.55, 1.90, "how much sentence length varies"),
    ("para_len_cv", 0.55, 1.90, "how much paragraph length varies"), ("mtld", 0.70, 1.45, "vocabulary range"),
    ("stress_clash_rate", 0.80, 1.25, "how often stressed syllables collide"), ("stress_lapse_rate", 0.75, 1.35, "how often the beat drops out (3+ unstressed in a row)"),
    ("ends_on_stress", 0.75, 1.35, "how often sentences land on a stressed syllable"), ("final_phrase_weight", 0.80, 1.25, "how much weight the last phrase of a sentence carries"),
)
#: Metrics held against a limit from one side: factor of the author's mean, and what is said.
CHECKS = (
    ("sent_len_cv", "low", 0.60, "sentence lengths vary less than this author's"), ("para_len_cv", "low", 0.55, "paragraph lengths are more uniform than usual for them"),
    ("mtld", "low", 0.70, "narrower vocabulary range than this author's"), ("repeated_opening_rate", "high", 1.80, "more sentences open the same way than usual"),
    ("longest_flat_run", "high", 1.60, "a longer run of same-length sentences than usual"),
)
FLOORS = {"sent_len_cv": 0.45, "para_len_cv": 0.30, "mtld": 60.0, "repeated_opening_rate": 0.25, "longest_flat_run": 6.0}
BELOW, ABOVE, MIXED, SHORT = 0.85, 1.15, 2.5, 200
METRICS = ("words", "sentences", "paragraphs", "sent_len_mean", "sent_len_cv", "para_len_cv", "mtld", "repeated_opening_rate", "longest_flat_run")


def segments(docs: DataFrame, *keep: str) -> DataFrame:
    """The kept columns with prose, sentences and the numbers of words of sentences and paragraphs; each worked out once a row."""
    prepared = docs.select(*keep, F.explode(F.array(T.prose_style(F.col("text")))).alias("prose"))
    prepared = prepared.select(*keep, "prose", F.explode(F.array(T.blocks(F.col("prose")))).alias("b"))
    return prepared.select(*keep, "prose", F.explode(F.array(F.struct(T.counted_sentences(F.col("b")).alias("s"), T.counted_paragraphs(F.col("b")).alias("p")))).alias("x")).select(
        *keep, "prose", F.col("x.s.text").alias("sents"), F.col("x.s.n").alias("slen"), F.col("x.p").alias("plen")
    )


def openings(sents: Column) -> Column:
    first = lambda s: F.array_join(F.filter(F.array(*(F.regexp_extract(s, T.FIRST_TWO, k + 1) for k in range(M.OPENING_WORDS))), lambda w: w != ""), " ")
    return F.transform(sents, lambda s: first(F.lower(s)))


def repeated_opening_rate(sents: Column) -> Column:
    """The share of sentences whose first two words an earlier one has too; null under four sentences."""
    keys = openings(sents)
    return F.when(F.size(sents) >= 4, rounded(F.try_divide(F.size(keys) - F.size(F.array_distinct(keys)), F.size(keys)), 3))


def measured(docs: DataFrame, *keep: str, with_mtld: bool = True) -> DataFrame:
    """The kept columns and all metrics, a row a document. Null means that it can't be measured."""
    rows, slen, plen = segments(docs, *keep), F.col("slen"), F.col("plen")
    out = rows.select(
        *keep, T.word_count(F.col("prose")).alias("words"), F.size(slen).cast("long").alias("sentences"), F.size(plen).cast("long").alias("paragraphs"),
        M.mean_length(slen).alias("sent_len_mean"), M.variation(slen).alias("sent_len_cv"), M.variation(plen).alias("para_len_cv"),
        *([rounded(M.mtld(F.transform(T.tokens(F.col("prose")), F.lower)), 1).alias("mtld")] if with_mtld else []),
        repeated_opening_rate(F.col("sents")).alias("repeated_opening_rate"), M.longest_flat_run(slen).alias("longest_flat_run"),
    )
    return out


def worst_openings(docs: DataFrame, top: int = 3) -> DataFrame:
    """The openings that a document repeats most: by count, then by words, both falling."""
    keys = segments(docs, "doc_id").where(F.size("sents") >= 4).select("doc_id", F.explode(openings(F.col("sents"))).alias("opening"))
    counted = keys.groupBy("doc_id", "opening").agg(F.count("*").alias("n")).where("n > 1")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), F.desc("opening")))
    return counted.withColumn("place", place.cast("long")).where(F.col("place") <= top)


def long_form(rows: DataFrame, *keep: str, columns: tuple[str, ...] = METRICS) -> DataFrame:
    """A row a document and metric; null values are left out."""
    pairs = F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns))
    return rows.select(*keep, F.explode(pairs).alias("m")).select(*keep, "m.metric", "m.value").where("value is not null")


def exact_mean(value: Column) -> Column:
    """The mean of values with three places at most, whatever order they come in."""
    return F.sum(value.cast("decimal(22,3)")).cast("double") / F.count(value)


def profile(rows: DataFrame, columns: tuple[str, ...] = METRICS) -> DataFrame:
    """author, metric, mean, lo, hi, n_values and n_samples of the usable rows of measured(…, author)."""
    usable = rows.where(F.col("words") >= SAMPLE_WORDS)
    n = usable.groupBy("author").agg(F.count("*").alias("n_samples"))
    spread = long_form(usable, "author", columns=columns).groupBy("author", "metric").agg(
        rounded(exact_mean(F.col("value")), 3).alias("mean"), rounded(F.min("value"), 3).alias("lo"), rounded(F.max("value"), 3).alias("hi"), F.count("*").alias("n_values")
    )
    return spread.join(n, "author")


def first_samples(rows: DataFrame) -> DataFrame:
    """One usable row an author, that of the smallest doc_id, so that a profile of them is one of single samples. rows: measured(…, doc_id, author)."""
    row = F.struct("doc_id", *(c for c in rows.columns if c not in ("doc_id", "author")))
    return rows.where(F.col("words") >= SAMPLE_WORDS).groupBy("author").agg(F.min(row).alias("row")).select("author", "row.*")


def mixed_registers(own: DataFrame) -> DataFrame:
    """Authors whose samples' sentence lengths lie so far apart that they are of several registers."""
    return own.where("metric = 'sent_len_mean'").select("author", "lo", "hi", ((F.col("lo") > 0) & (F.try_divide("hi", "lo") > MIXED)).alias("mixed"))


def _match(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *row) for k, row in enumerate(MATCH)], "pos int, metric string, low double, high double, label string")


def _checks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *row, FLOORS[row[0]]) for k, row in enumerate(CHECKS)], "pos int, metric string, side string, factor double, why string, floor double")


def compare(rows: DataFrame, own: DataFrame | None = None, columns: tuple[str, ...] = METRICS) -> DataFrame:
    """What departs: doc_id, metric, value, note and detail. rows: measured(…, doc_id, author); own: a profile.

    With a profile of two samples or more, a value outside the range they were seen in, with some
    room; with one, outside a band of ratios. Metrics that aren't matched so, and all of them
    without a profile, are held against the author's mean or, where that is missing or 0, a floor.
    Both tables of thresholds are broadcast: they have a row a metric.
    """
    spark = rows.sparkSession
    values = long_form(rows, "doc_id", "author", columns=columns)
    if own is None:
        values = values.withColumns({c: F.lit(None).cast("double") for c in ("mean", "lo", "hi")} | {"n_samples": F.lit(None).cast("long"), "known": F.lit(False)})
    else:
        authors = own.select("author").distinct().withColumn("known", F.lit(True))
        values = values.join(own.select("author", "metric", "mean", "lo", "hi", "n_samples"), ["author", "metric"], "left").join(authors, "author", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    v, mean, ratio = F.col("value"), F.col("mean"), F.try_divide("value", "mean")
    matched = values.where("mean is not null and mean <> 0").join(F.broadcast(_match(spark)), "metric")
    ranged = F.col("n_samples") >= 2
    note = (
        F.when(ranged & (v < F.col("lo") * BELOW), F.concat("label", F.lit(" falls below anything this author does")))
        .when(ranged & (v > F.col("hi") * ABOVE), F.concat("label", F.lit(" exceeds anything this author does")))
        .when(~ranged & (ratio < F.col("low")), F.concat("label", F.lit(" is well below the single sample available")))
        .when(~ranged & (ratio > F.col("high")), F.concat("label", F.lit(" is well above the single sample available")))
    )
    text = lambda c: F.format_string("%.3f", c)
    detail = F.when(ranged, F.concat(text(v), F.lit(" vs their observed "), text(F.col("lo")), F.lit("-"), text(F.col("hi")))).otherwise(
        F.concat(text(v), F.lit(" vs "), text(mean), F.lit(" ("), F.format_string("%.2f", rounded(ratio, 2)), F.lit("x) - one sample only, weak signal"))
    )
    two = matched.select("doc_id", "metric", "value", note.alias("note"), detail.alias("detail")).where("note is not null")
    in_match = F.col("metric").isin([m[0] for m in MATCH])
    limit = F.coalesce(F.nullif(mean, F.lit(0.0)) * F.col("factor"), F.col("floor"))
    one = values.where(~(F.col("known") & in_match)).join(F.broadcast(_checks(spark)), "metric").where(
        F.when(F.col("side") == "low", v < limit).otherwise(v > limit)
    )
    against = F.when(F.nullif(mean, F.lit(0.0)).isNotNull(), F.concat(F.lit("their "), text(mean))).otherwise(F.concat(F.lit("floor "), text(F.col("floor"))))
    return two.unionByName(one.select("doc_id", "metric", "value", F.col("why").alias("note"), F.concat(text(v), F.lit(" vs "), against).alias("detail")))


def caveats(rows: DataFrame, notes: DataFrame) -> DataFrame:
    """Documents whose vocabulary note gives a direction only, as they are short."""
    return notes.where("metric = 'mtld'").join(rows.select("doc_id", "words"), "doc_id").select("doc_id", "words", (F.col("words") < SHORT).alias("directional"))


def word_counts(docs: DataFrame) -> DataFrame:
    """doc_id, word and n of the alphabetic words of each document."""
    each = docs.select("doc_id", F.explode(F.transform(T.tokens(T.prose_style(F.col("text"))), F.lower)).alias("word")).where(F.regexp_like("word", F.lit(r"^\p{L}+$")))
    return each.groupBy("doc_id", "word").agg(F.count("*").alias("n"))


def rarity(counted: DataFrame, frequencies: DataFrame) -> DataFrame:
    """zipf_mean of documents whose words a frequency table knows: the mean of its positive values over alphabetic words.

    counted: word_counts(…), or documents. frequencies: (word, zipf). No such table comes with the engine; without one
    the metric is missing. Words are joined after counting them a document, so that a frequent word is one row there.
    """
    known = (word_counts(counted) if "text" in counted.columns else counted).join(frequencies.where("zipf > 0"), "word")
    return known.groupBy("doc_id").agg(rounded(F.sum(F.col("zipf").cast("decimal(10,4)") * F.col("n")).cast("double") / F.sum("n"), 2).alias("zipf_mean"))
