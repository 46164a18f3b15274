"""Prediction, accuracy and the SQL forms of the training-control steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesforge.functions.kernels import KernelBank
from seriesforge.operators.transform import CHUNK_ROWS, features, matrix


def predict(df: DataFrame, bank: KernelBank, model) -> DataFrame:
    """``series_id, label, prediction``: transform and linear model in one narrow Arrow pass."""
    src = df.select("series_id", "label", F.col("x").cast("array<double>").alias("x"))
    length = bank.input_length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK_ROWS):
                b = whole.slice(at, CHUNK_ROWS)
                got = model.predict(features(matrix(b.column("x"), length), bank)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column("series_id"), b.column("label"), pa.array(got)], names=["series_id", "label", "prediction"])

    return src.mapInArrow(run, "series_id bigint, label int, prediction int")


def accuracy(predictions: DataFrame) -> DataFrame:
    return predictions.agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"))


def linear_scores(long: DataFrame, coef: DataFrame) -> DataFrame:
    """``series_id, class, score`` from long features and ``class, kernel_id, w_ppv, w_mx, intercept`` (K x classes rows)."""
    part = F.col("ppv") * F.col("w_ppv") + F.col("mx") * F.col("w_mx")
    return (
        long.join(F.broadcast(coef), "kernel_id").groupBy("series_id", "class").agg((F.sum(part) + F.first("intercept")).alias("score"))
    )


def argmax_class(scores: DataFrame) -> DataFrame:
    """Best class of each series; the lowest on ties."""
    return scores.groupBy("series_id").agg(F.min_by("class", F.struct(-F.col("score"), F.col("class"))).alias("prediction"))


def softmax_loss(scores: DataFrame, labels: DataFrame) -> DataFrame:
    """Mean cross-entropy by log-sum-exp."""
    per = scores.groupBy("series_id").agg(
        F.max("score").alias("top"), F.map_from_entries(F.collect_list(F.struct("class", "score"))).alias("by_class"), F.collect_list("score").alias("all")
    )
    lse = F.log(F.aggregate("all", F.lit(0.0), lambda a, s: a + F.exp(s - F.col("top")))) + F.col("top")
    return per.join(labels, "series_id").agg(F.avg(lse - F.element_at("by_class", F.col("label"))).alias("loss"))


def select_rate(trace: DataFrame) -> DataFrame:
    """Learning rate of the lowest loss; the first tried on ties."""
    return trace.agg(F.min_by("lr", F.struct("loss", "step")).alias("lr"), F.min("loss").alias("loss"))


def stop_trace(trace: DataFrame, patience: int) -> DataFrame:
    """The stop rule over an ordered loss sequence of one run: step, best, stalls, stopped."""
    init = F.struct(
        F.lit(float("inf")).alias("best"), F.lit(0).alias("stalls"), F.lit(False).alias("stopped"),
        F.array().cast("array<struct<step:int,val_loss:double,best:double,stalls:int,stopped:boolean>>").alias("out"),
    )

    def step(a: Column, r: Column) -> Column:
        worse = r["val_loss"] >= a["best"]
        stalls = F.when(worse, a["stalls"] + 1).when(a["stopped"], a["stalls"]).otherwise(F.lit(0))
        stopped = a["stopped"] | (worse & (stalls >= patience))
        best = F.when(worse, a["best"]).otherwise(r["val_loss"])
        row = F.struct(r["step"].alias("step"), r["val_loss"].alias("val_loss"), best.alias("best"), stalls.alias("stalls"), stopped.alias("stopped"))
        return F.struct(best.alias("best"), stalls.alias("stalls"), stopped.alias("stopped"), F.concat(a["out"], F.array(row)).alias("out"))

    rows = trace.agg(F.array_sort(F.collect_list(F.struct("step", "val_loss"))).alias("r"))
    return rows.select(F.inline(F.aggregate("r", init, step, lambda a: a["out"])))


def assign_tranches(df: DataFrame, tranche_size: int, id_col: str = "series_id") -> DataFrame:
    return df.withColumn("tranche", F.floor(F.col(id_col) / tranche_size).cast("bigint"))


def assign_minibatches(df: DataFrame, batch: int, epoch: int = 0, id_col: str = "series_id") -> DataFrame:
    """Shuffle each tranche by a linear congruential key of the id and deal it into minibatches."""
    key = F.pmod((F.col(id_col) + F.lit(epoch * 7919)) * F.lit(1103515245) + F.lit(12345), F.lit(2147483648))
    rn = F.row_number().over(Window.partitionBy("tranche").orderBy(key, id_col))
    return df.withColumn("minibatch", F.floor((rn - 1) / batch).cast("bigint"))
