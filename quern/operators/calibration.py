"""Calibration of confidences: tie-safe bins of equal mass, reliability curves, expected calibration error."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.plans.shared import ship_package


def _sure(values: pd.Series) -> pd.Series:
    found, where = np.unique(np.abs(values.to_numpy(np.float64)), return_inverse=True)
    return pd.Series(np.array([1 / (1 + math.exp(-v)) for v in found.tolist()], np.float64)[where])


def confidence(z: Column) -> Column:
    """The logistic of |z| by the C library's exponential, as SQL engines take it.

    The JVM's differs in the last bit, which is enough to tie or part confidences of nearly equal z.
    """
    return F.when(z.isNotNull(), F.pandas_udf(_sure, "double")(z))


def fold(pairs: DataFrame, view: str = "sym") -> DataFrame:
    """pairs -> item_id, conf, correct: one row an item (sym) or one an order (raw)."""
    ship_package(pairs.sparkSession)
    sure = lambda c: confidence(F.col(c))
    if view == "sym":
        return pairs.select("item_id", sure("s").alias("conf"), F.col("sym").alias("correct"))
    if view != "raw":
        raise ValueError(f"unknown view {view!r}")
    both = F.array(F.struct(sure("z_cf").alias("conf"), F.col("raw_cf").alias("correct")), F.struct(sure("z_rf").alias("conf"), F.col("raw_rf").alias("correct")))
    return pairs.select("item_id", F.explode(both).alias("r")).select("item_id", "r.*")


def equal_mass_bins(rows: DataFrame, n_bins: int = 10) -> DataFrame:
    """rows(conf, correct) with ``bin``.

    Bin i would end after round-half-even(i n / k) of the sorted rows; an end inside a run of equal confidences moves to its
    end.  In closed form: count the distinct confidences with their running totals (a sum by value, so no order over all rows), and
    let a value's bin be the number of ends that lie before its run.
    """
    values = rows.groupBy("conf").agg(F.count("*").alias("_c"))
    # one row for each distinct confidence
    upto = Window.orderBy("conf").rowsBetween(Window.unboundedPreceding, 0)
    values = values.withColumn("_upto", F.sum("_c").over(upto)).withColumn("_n", F.sum("_c").over(Window.partitionBy(F.lit(0))))
    k = F.least(F.lit(n_bins), F.col("_n"))
    ends = F.transform(F.sequence(F.lit(1), k), lambda i: F.when(i == k, F.col("_n")).otherwise(F.bround(i * F.col("_n") / k, 0).cast("long")))
    before = F.size(F.filter(ends, lambda e: e <= F.col("_upto") - F.col("_c")))
    binned = values.withColumn("_ends", before)
    # several ends inside one run leave no bin between them
    binned = binned.withColumn("bin", (F.dense_rank().over(Window.orderBy("_ends")) - 1).cast("int"))
    return rows.join(binned.select("conf", "bin"), "conf")


def reliability_curve(rows: DataFrame, n_bins: int = 10) -> DataFrame:
    """bin, n, conf, acc."""
    return equal_mass_bins(rows, n_bins).groupBy("bin").agg(F.count("*").alias("n"), F.avg("conf").alias("conf"), F.avg("correct").alias("acc"))


def ece(rows: DataFrame, n_bins: int = 10) -> DataFrame:
    """One row: the mean gap between accuracy and confidence, by bin mass."""
    curve = reliability_curve(rows, n_bins)
    return curve.agg(F.sum("n").alias("n_points"), (F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf"))) / F.sum("n")).alias("ece"))
