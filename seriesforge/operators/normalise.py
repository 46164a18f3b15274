"""Per-series z-normalisation and per-feature standardisation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesforge.functions.series import let, series_mean, series_std, znorm

#: Fixed value: added to a feature's deviation before dividing by it.
FEATURE_EPSILON = 1e-8


def series_stats(df: DataFrame) -> DataFrame:
    """Adds ``mean`` and ``std`` (population) of ``x``."""
    both = let(series_mean(F.col("x")), lambda m: F.struct(m.alias("mean"), series_std(F.col("x"), m).alias("std")))
    return df.withColumn("both", both).select(*df.columns, "both.mean", "both.std")


def znormalise(df: DataFrame) -> DataFrame:
    """``x`` with zero mean and unit deviation; constant series become zeros."""
    return df.withColumn("x", znorm(F.col("x")))


def fit_feature_scaler(long: DataFrame, fit_rows: int | None = 2048) -> DataFrame:
    """``kernel_id, ppv_mean, ppv_std, mx_mean, mx_std`` from the first ``fit_rows`` series."""
    src = long if fit_rows is None else long.where(F.col("series_id") < fit_rows)
    return src.groupBy("kernel_id").agg(
        F.avg("ppv").alias("ppv_mean"), F.stddev_pop("ppv").alias("ppv_std"), F.avg("mx").alias("mx_mean"), F.stddev_pop("mx").alias("mx_std")
    )


def standardise(long: DataFrame, scaler: DataFrame) -> DataFrame:
    """Features less their mean over ``std + 1e-8``. The scaler has K rows, K being a parameter."""
    z = lambda f: ((F.col(f) - F.col(f"{f}_mean")) / (F.col(f"{f}_std") + FEATURE_EPSILON)).alias(f)
    carried = [c for c in long.columns if c not in ("ppv", "mx")]
    return long.join(F.broadcast(scaler), "kernel_id").select(*carried, z("ppv"), z("mx"))
