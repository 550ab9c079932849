"""Class-balanced ridge logistic fits, many at a time, by Newton steps over sums that Spark adds up.

A fit is trained on all rows but those of one group, which is held out: a fold, a generator, or
nothing. All fits go together: a step is one pass over the rows, in which each task adds up the
slope of the loss and the cross products of the answers for every fit, and one small equation a
fit over the tasks' sums. So neither the plan nor the number of passes grows with the fits.
What a training set holds of each label is the count of all rows less that of the group. The
driver holds the coefficients of MOST_FITS fits at most, and no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmill.sources.scratch import written

#: Weight of the ridge, bound of the logit, and what a missing answer counts.
L2, CLAMP, MISSING = 0.02, 30.0, 0.5
#: Steps at most, the largest change of a coefficient from which on another is made, and by which none is changed more in one.
STEPS, STILL, STRIDE = 60, 1e-10, 4.0
#: Fits at a time, and rows times fits that a task works on at once.
MOST_FITS, CELLS = 10_000, 1 << 20


def chance(coefficients: Column, keys: tuple[str, ...]) -> Column:
    """The probability of label 1 under coefficients (one a key, and the bias last)."""
    z = F.get(coefficients, F.lit(len(keys)))
    for k, key in enumerate(keys):
        z = z + F.get(coefficients, F.lit(k)) * F.coalesce(F.col(key), F.lit(MISSING))
    return 1 / (1 + F.exp(-F.greatest(F.lit(-CLAMP), F.least(F.lit(CLAMP), z))))


def _sums(x: np.ndarray, y: np.ndarray, held: np.ndarray, coefficients: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A row a fit: the slope, and the cross products above the diagonal. held: which fit leaves each row out, or -1; weights: of label 0 and 1 in each fit."""
    p = 1 / (1 + np.exp(-np.clip(x @ coefficients.T, -CLAMP, CLAMP)))
    c = weights[:, y.astype(int)].T.copy()
    out = np.flatnonzero(held >= 0)
    c[out, held[out]] = 0
    slope, curve, upper = (c * (p - y[:, None])).T @ x, c * p * (1 - p), np.triu_indices(x.shape[1])
    return np.hstack([slope, np.stack([(x.T @ (x * curve[:, [k]]))[upper] for k in range(len(coefficients))])])


def _stepped(old: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """One Newton step over the sums of a fit, whose weights add up to 1."""
    d, ridge = len(old), np.append(np.full(len(old) - 1, L2), 0.0)
    curve = np.zeros((d, d))
    curve[np.triu_indices(d)] = sums[d:]
    curve += np.triu(curve, 1).T + np.diag(ridge)
    move = np.linalg.lstsq(curve, sums[:d] + ridge * old, rcond=None)[0]
    return old - move * min(1.0, STRIDE / max(np.abs(move).max(), 1e-300))


def fits(rows: DataFrame, keys: tuple[str, ...], group: str | None = None) -> DataFrame:
    """(held, coefficients) of the fit without each group, or of one fit on all rows, whose held is null. rows: (label, *keys, group).

    Rows without a group are in every training set, rows without a label in none. A training set with one label only has no fit.
    """
    spark, d = rows.sparkSession, len(keys) + 1
    kind = dict(rows.dtypes)[group] if group else "string"
    of = F.col(group).cast("string") if group else F.lit(None).cast("string")
    rows = written(rows.where("label is not null").select(of.alias("own"), F.col("label").cast("double").alias("y"), *(F.coalesce(F.col(k).cast("double"), F.lit(MISSING)).alias(f"x{j}") for j, k in enumerate(keys))), "fit-rows")
    size = lambda y: F.sum((F.col("y") == y).cast("long"))
    sizes = rows.groupBy("own").agg(size(0).alias("n0"), size(1).alias("n1"))
    every = sizes.agg(F.coalesce(F.sum("n0"), F.lit(0)), F.coalesce(F.sum("n1"), F.lit(0))).first()
    left = [(r["own"], every[0] - r["n0"], every[1] - r["n1"]) for r in sizes.where("own is not null").limit(MOST_FITS + 1).collect()] if group else [(None, *every)]
    if len(left) > MOST_FITS:
        raise ValueError(f"more than {MOST_FITS} groups: fit them in parts")
    left = sorted(x for x in left if x[1] and x[2])
    names, weights = [x[0] for x in left], np.array([[0.5 / n0, 0.5 / n1] for _, n0, n1 in left]).reshape(-1, 2)
    found = np.zeros((len(names), d))
    place = {name: k for k, name in enumerate(names) if name is not None}

    def step(old: np.ndarray) -> np.ndarray:
        sent = spark.sparkContext.broadcast((place, weights, old))

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            place, weights, old = sent.value
            total = np.zeros((len(old), d + d * (d + 1) // 2))
            for batch in batches:
                for low in range(0, batch.num_rows, max(1, CELLS // max(1, len(old)))):
                    part = batch.slice(low, max(1, CELLS // max(1, len(old))))
                    x = np.column_stack([*(part.column(k).to_numpy() for k in range(2, d + 1)), np.ones(part.num_rows)])
                    total += _sums(x, part.column(1).to_numpy(), np.array([place.get(v, -1) for v in part.column(0).to_pylist()]), old, weights)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(old)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["fit", "sums"])

        def solved(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"fit": [key[0]], "coefficients": [_stepped(sent.value[2][key[0]], np.sum(np.stack(rows["sums"].to_list()), axis=0))]})

        made = rows.mapInArrow(partial, "fit int, sums array<double>").groupBy("fit").applyInPandas(solved, "fit int, coefficients array<double>")
        return np.array([r["coefficients"] for r in sorted(made.collect())]).reshape(old.shape)  # a row a fit

    for _ in range(STEPS if names else 0):
        found, last = step(found), found
        if np.abs(found - last).max() < STILL:
            break
    made = spark.createDataFrame([(name, row.tolist()) for name, row in zip(names, found, strict=True)], "held string, coefficients array<double>")
    return made.select(F.col("held").cast(kind).alias("held"), "coefficients")
