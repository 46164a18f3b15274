"""Result tables of the experiments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RUNS_SCHEMA = "dataset string, run int, accuracy double, t_tr_transform double, t_te_transform double, t_fit double, t_score double"
ARCHIVE_SCHEMA = "dataset string, accuracy_mean double, accuracy_standard_deviation double, time_training_seconds double, time_test_seconds double"
SCALING_SCHEMA = "num_training_examples bigint, accuracy double, time_training_seconds double"


def results_frame(spark: SparkSession, rows: list, schema: str | T.StructType) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def summarise_runs(runs: DataFrame) -> DataFrame:
    """Mean and population deviation of accuracy, mean training and test seconds by dataset."""
    return runs.groupBy("dataset").agg(
        F.avg("accuracy").alias("accuracy_mean"),
        F.stddev_pop("accuracy").alias("accuracy_standard_deviation"),
        (F.avg("t_tr_transform") + F.avg("t_fit")).alias("time_training_seconds"),
        (F.avg("t_te_transform") + F.avg("t_score")).alias("time_test_seconds"),
    )


def union_by_k(tables: dict[int, DataFrame]) -> DataFrame:
    """One table of all per-k scaling results with a leading column ``k``."""
    return reduce(DataFrame.unionByName, (t.select(F.lit(k).alias("k"), "*") for k, t in sorted(tables.items())))


def write_results(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """A small result table as the one file ``path`` (CSV with a header, or parquet), on any file system of Spark."""
    spark, folder = df.sparkSession, f"{path}.parts"
    df.coalesce(1).write.mode("overwrite").option("header", True).format(fmt).save(folder)
    parts, target = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (folder, path))
    fs = parts.getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(s.getPath() for s in fs.listStatus(parts) if s.getPath().getName().startswith("part-"))
    fs.delete(target, True)
    if not fs.rename(part, target):
        raise OSError(f"cannot write {path}")
    fs.delete(parts, True)
