"""Voice fidelity from forced-choice trials, and the grading of outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmill.functions.metrics import rounded

# Answers possible on each voice dimension.
LEVELS = {"register": 3, "rhythm": 3, "stance": 3, "concreteness": 3}


def real_is_a(*parts: Column) -> Column:
    """A coin for which slot the real passage takes, from a hash of the trial."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws("/", *parts)), 1, 6), 16, 10).cast("long"), F.lit(2)) == 0


def rotated(held: DataFrame, trials: DataFrame) -> DataFrame:
    """Each trial with the held-out passage whose turn it is. held: (pos, held_id), trials: (…, i)."""
    n = held.agg(F.count("*").alias("n"))
    return trials.crossJoin(F.broadcast(n)).where("n > 0").withColumn("pos", F.pmod("i", F.col("n"))).join(held, "pos").drop("pos", "n")  # n is one row


def fidelity(trials: DataFrame, *by: str) -> DataFrame:
    """How far from chance the judge tells the real passage, and to which side. trials: (*by, p_real), missing answers 0."""
    p = F.coalesce(F.col("p_real"), F.lit(0.0)).cast("decimal(22,4)")
    n, s, q = F.count("*"), F.sum(p), F.sum((p * p).cast("decimal(30,8)"))
    rows = trials.groupBy(*by).agg(n.alias("n"), (s.cast("double") / n).alias("m"), F.sqrt(F.greatest(F.lit(0.0), q.cast("double") / n - (s.cast("double") / n) * (s.cast("double") / n))).alias("sd"))
    err = rounded(F.abs(F.col("m") - 0.5) * 2, 3)
    side = F.when(err < 0.25, F.lit("indistinguishable")).when(F.col("m") < 0.5, F.lit("OVERSHOOT")).otherwise(F.lit("UNDERSHOOT"))
    return rows.select(*by, "n", rounded("m", 3).alias("mean_p"), rounded("sd", 3).alias("stdev"), err.alias("fidelity_error"), side.alias("direction"))


def control(trials: DataFrame, *by: str) -> DataFrame:
    """Whether real against real reads near chance; groups with fewer than two held-out passages have no control."""
    rows = trials.groupBy(*by).agg(F.countDistinct("held_id").alias("held"), rounded(F.sum(F.col("p_real").cast("decimal(22,4)")).cast("double") / F.count("*"), 3).alias("mean_p"))
    return rows.where("held >= 2").select(*by, "held", "mean_p", F.col("mean_p").between(0.3, 0.7).alias("ok"))


def normalised(scores: DataFrame) -> DataFrame:
    """Scores as shares of the top level. scores: (…, dimension, score)."""
    top = F.element_at(F.create_map(*(x for k, n in LEVELS.items() for x in (F.lit(k), F.lit(n - 1)))), F.col("dimension"))
    return scores.withColumn("normalized", rounded(F.try_divide(F.coalesce("score", F.lit(0)), top), 3))
