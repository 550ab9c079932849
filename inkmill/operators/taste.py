"""A quality model over judged dimensions: scores, fit, thresholds, validation, comparison of rewrites.

The judge's answers are an input table, a column a dimension; a missing answer counts 0.5.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkmill.functions.metrics import rounded
from inkmill.operators import logistic
from inkmill.operators.logistic import CLAMP, MISSING
from inkmill.sources.scratch import written

# Dimensions with the sign that is expected of them, by battery.
DIMENSIONS = (
    ("specific_detail", 1, 1), ("single_author", 1, 1), ("claims_carry_reasons", 1, 1), ("stock_vocabulary", -1, 1), ("unearned_promise", -1, 1),
    ("formulaic_shape", -1, 1), ("audience_flattery", -1, 1),
    ("unpredictable_move", 1, 2), ("personal_risk", 1, 2), ("noticed_not_looked_up", 1, 2), ("sensory_scene", 1, 2), ("unusual_syntax", 1, 2),
    ("cares_about_subject", 1, 2), ("resists_summary", 1, 2), ("says_the_unobvious", 1, 2), ("safe_middle", -1, 2), ("interchangeable_author", -1, 2),
    ("detail_load_bearing", 1, 3), ("details_accumulate", 1, 3), ("commits_to_reading", 1, 3), ("visible_omission", 1, 3), ("order_is_chosen", 1, 3),
    ("details_decorative", -1, 3), ("summary_of_something", -1, 3),
)
#: The published weights and biases of the two axes.
AXES = {
    "presence": ((
        ("unpredictable_move", 0.43891384550076123), ("personal_risk", 0.4703692294384772), ("noticed_not_looked_up", 0.9256123473508538), ("sensory_scene", 1.126357211033621),
        ("unusual_syntax", 0.9430516476054462), ("cares_about_subject", 0.5460729745765897), ("resists_summary", 0.32998483493439146), ("says_the_unobvious", 0.17500065605270324),
        ("safe_middle", -0.35793958029915257), ("interchangeable_author", -0.9577329518194827),
    ), -2.307897470482472),
    "execution": ((
        ("specific_detail", 0.696802775895987), ("single_author", 1.5512873002097305), ("claims_carry_reasons", -0.32568792753100123), ("stock_vocabulary", -0.7902848253594215),
        ("unearned_promise", 0.07242637638724413), ("formulaic_shape", -0.8948288170535394), ("audience_flattery", -0.38897811107722485),
    ), -0.9598846694951748),
}
KEYS = tuple(k for k, _, _ in DIMENSIONS)
FOLDS, SEED, GRID = 5, 11, 200
AXIS_DROP, DIMENSION_DROP, TOP = 0.02, 0.15, 5


def dimensions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DIMENSIONS, "key string, sign int, battery int")


def probability(weights: tuple, bias: float) -> Column:
    """The logistic of bias and weighted answers, added in order, with the logit held within 30."""
    z = F.lit(bias)
    for key, w in weights:
        z = z + F.lit(w) * F.coalesce(F.col(key), F.lit(MISSING))
    return 1 / (1 + F.exp(-F.greatest(F.lit(-CLAMP), F.least(F.lit(CLAMP), z))))


def axis_scores(rows: DataFrame, *keep: str, axes: dict | None = None) -> DataFrame:
    """A row a document and axis."""
    pairs = F.array(*(F.struct(F.lit(a).alias("axis"), rounded(probability(w, b), 6).alias("p")) for a, (w, b) in (axes or AXES).items()))
    return rows.select(*keep, F.explode(pairs).alias("s")).select(*keep, "s.axis", "s.p")


def class_weights(rows: DataFrame) -> DataFrame:
    """Weights that make both labels count alike."""
    by = rows.groupBy("label").agg(F.count("*").alias("n"))
    total = by.agg(F.sum("n").alias("all"))
    return by.crossJoin(F.broadcast(total)).select("label", "n", (F.col("all") / (2 * F.col("n"))).alias("weight"))  # two rows and one


def auc(scores: DataFrame, *by: str) -> DataFrame:
    """The chance that a row of label 1 scores over one of label 0, ties half; null with one label only. scores: (*by, p, label).

    Counts go by distinct score; the running total has two levels, cells of the score and what lies within a cell.
    """
    pos, neg = F.sum((F.col("label") == 1).cast("long")).alias("pos"), F.sum((F.col("label") == 0).cast("long")).alias("neg")
    each = scores.groupBy(*by, "p").agg(pos, neg).withColumn("cell", F.floor(F.col("p") * 4096))
    within = Window.partitionBy(*by, "cell").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    cells = each.groupBy(*by, "cell").agg(F.sum("neg").alias("cell_neg"))
    before = Window.partitionBy(*by).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*by, "cell", F.coalesce(F.sum("cell_neg").over(before), F.lit(0)).alias("below"))
    placed = each.withColumn("in_cell", F.coalesce(F.sum("neg").over(within), F.lit(0))).join(cells, [*by, "cell"])
    wins = F.sum(F.col("pos") * (2 * (F.col("below") + F.col("in_cell")) + F.col("neg")))
    sums = placed.groupBy(*by).agg(wins.alias("w"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg")).withColumn("d", 2 * F.col("n_pos") * F.col("n_neg"))
    # rounded in whole numbers, half up
    return sums.select(*by, F.when(F.col("d") > 0, F.expr("(w * 2000 + d) div (2 * d)").cast("double") / 1000).alias("auc"), "n_pos", "n_neg")


def youden(scores: DataFrame, *by: str) -> DataFrame:
    """The threshold of the grid with the largest sum of both rates, the smallest on ties; 0.5 with one label only.

    Scores are counted by the grid cell they reach, at most 200 a group, before the thresholds meet them.
    """
    k = F.floor(F.col("p") * GRID)
    k = F.when((k + 1) / GRID <= F.col("p"), k + 1).when(k / GRID > F.col("p"), k - 1).otherwise(k)
    cells = scores.groupBy(*by, k.alias("cell")).agg(F.sum((F.col("label") == 1).cast("long")).alias("pos"), F.sum((F.col("label") == 0).cast("long")).alias("neg"))
    grid = scores.sparkSession.range(1, GRID).select(F.col("id").alias("i"))
    at = cells.crossJoin(F.broadcast(grid)).groupBy(*by, "i").agg(  # 199 thresholds, at most 201 cells a group
        F.sum(F.when(F.col("cell") >= F.col("i"), F.col("pos")).otherwise(0)).alias("tp"), F.sum("pos").alias("pos"),
        F.sum(F.when(F.col("cell") < F.col("i"), F.col("neg")).otherwise(0)).alias("tn"), F.sum("neg").alias("neg"),
    )
    j = F.try_divide("tp", "pos") + F.try_divide("tn", "neg") - 1
    best = at.withColumn("j", j).groupBy(*by).agg(F.max_by("i", F.struct("j", -F.col("i"))).alias("i"), F.max("j").alias("j"))
    return best.select(*by, F.when(F.col("j").isNull(), F.lit(0.5)).otherwise(F.col("i") / GRID).alias("threshold"), rounded("j", 6).alias("j"))


def fit(rows: DataFrame, keys: tuple[str, ...] = KEYS) -> tuple[tuple, float]:
    """Weights by key and bias of the class-balanced ridge fit. rows: (label, *keys); refused without rows of both labels."""
    found = logistic.fits(rows, keys).first()
    if found is None:
        raise ValueError("a fit needs rows of both labels")
    *weights, bias = found["coefficients"]
    return tuple(zip(keys, weights, strict=True)), bias


def fold(seed: int = SEED, folds: int = FOLDS) -> Column:
    """A fold by a hash of the id and the seed."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws("/", F.col("id").cast("string"), F.lit(str(seed)))), 1, 6), 16, 10).cast("long"), F.lit(folds))


def cross_validated(rows: DataFrame, keys: tuple[str, ...] = KEYS, folds: int = FOLDS) -> DataFrame:
    """One row: n, mean and spread of the folds' accuracy at 0.5 and of their AUC, and the AUC over all held-out scores. rows: (id, label, *keys).

    The folds are fitted together. Rows of a fold without a fit, as when the others have one label only, aren't scored.
    """
    rows = rows.withColumn("fold", fold(folds=folds))
    models = F.broadcast(logistic.fits(rows, keys, "fold").withColumnRenamed("held", "fold"))  # a row a fold
    held = written(rows.join(models, "fold").select("fold", "label", rounded(logistic.chance(F.col("coefficients"), keys), 6).alias("p")), "held-out")
    hit = F.avg(((F.col("p") > 0.5).cast("int") == F.col("label")).cast("double"))
    hits = held.groupBy("fold").agg(hit.alias("hit"), F.count("*").alias("n")).agg(
        F.sum("n").alias("n"), rounded(F.avg("hit"), 3).alias("accuracy"), rounded(F.stddev_pop("hit"), 3).alias("sd_accuracy")
    )
    by_fold = auc(held, "fold").agg(rounded(F.avg("auc"), 3).alias("mean_auc"), rounded(F.stddev_pop("auc"), 3).alias("sd_auc"))
    pooled = auc(held.withColumn("every", F.lit(1)), "every").select(F.col("auc").alias("pooled_auc"))
    return hits.crossJoin(by_fold).crossJoin(pooled)  # one row each


def leave_one_generator_out(rows: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """For each generator, how a model that never saw it does on it. rows: (id, label, generator, *keys).

    The threshold is that of the training scores. The exemplars that the generator is compared with were trained
    on, so the AUC is kind to it. All generators go through the same few steps, as groups.
    """
    models = F.broadcast(logistic.fits(rows, keys, "generator"))  # logistic.MOST_FITS rows at most
    met = rows.join(models, F.lit(True)).where((F.col("label") == 1) | F.col("generator").isNotNull())  # every row is scored by every model
    p = rounded(logistic.chance(F.col("coefficients"), keys), 6)
    scored = written(met.select("held", "label", F.col("generator").eqNullSafe(F.col("held")).alias("unseen"), p.alias("p")), "generator-scores")
    cut = youden(scored.where("not unseen"), "held").select("held", "threshold")
    mean = lambda name: rounded(F.sum(F.col("p").cast("decimal(22,6)")).cast("double") / F.count("*"), 3).alias(name)
    unseen = scored.where("unseen").join(F.broadcast(cut), "held").groupBy("held").agg(
        F.count("*").alias("n"), rounded(F.avg((F.col("p") < F.col("threshold")).cast("double")), 3).alias("rejected"), rounded(F.first("threshold"), 3).alias("threshold"), mean("mean_score")
    )
    exemplars = scored.where("label = 1")
    both = exemplars.select("held", "p", "label").unionByName(scored.where("unseen").select("held", "p", F.lit(0).alias("label")))
    out = unseen.join(exemplars.groupBy("held").agg(mean("exemplar_mean")), "held").join(auc(both, "held").select("held", F.col("auc").alias("auc_vs_exemplars")), "held")
    return out.withColumnRenamed("held", "generator")


def generalize_summary(aucs: DataFrame) -> DataFrame:
    """The AUC at place n // 2 and the worst, over one row a generator."""
    s = F.sort_array(F.collect_list("auc"))
    return aucs.agg(F.count("*").alias("n"), s.alias("s")).select("n", F.get("s", F.floor(F.col("n") / 2).cast("int")).alias("median_auc"), F.array_min("s").alias("worst_auc"))


def weight_report(spark: SparkSession, axes: dict | None = None) -> DataFrame:
    """Weights by size, and whether they contradict the expected sign."""
    rows = [(a, k, float(w)) for a, (weights, _) in (axes or AXES).items() for k, w in weights]
    table = spark.createDataFrame(rows, "axis string, key string, weight double").join(dimensions(spark), "key")
    place = F.row_number().over(Window.partitionBy("axis").orderBy(F.desc(F.abs("weight")), "key"))
    return table.select("axis", "key", "weight", "sign", ((F.col("weight") != 0) & (F.signum("weight") != F.col("sign"))).alias("disagrees"), place.cast("long").alias("place"))


def compare_axes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Each axis before and after a rewrite, and whether it lost."""
    a, b = axis_scores(before, "id"), axis_scores(after, "id")
    both = a.withColumnRenamed("p", "before").join(b.withColumnRenamed("p", "after"), ["id", "axis"])
    return both.select("id", "axis", "before", "after", rounded(F.col("after") - F.col("before"), 6).alias("delta"), (F.col("after") < F.col("before") - AXIS_DROP).alias("worse"))


def lost(before: DataFrame, after: DataFrame, top: int = TOP) -> DataFrame:
    """The wanted dimensions that a rewrite lost most of."""
    wanted = [k for k, sign, _ in DIMENSIONS if sign > 0]
    long = lambda rows, name: rows.select("id", F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.coalesce(k, F.lit(MISSING)).alias(name)) for k in wanted))).alias("d")).select("id", "d.*")
    drop = long(before, "before").join(long(after, "after"), ["id", "key"]).withColumn("drop", rounded(F.col("before") - F.col("after"), 6)).where(F.col("drop") > DIMENSION_DROP)
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("drop"), F.desc("key")))
    return drop.withColumn("place", place.cast("long")).where(F.col("place") <= top)
