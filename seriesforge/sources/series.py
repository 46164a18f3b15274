"""Series ingestion: text, CSV, parquet tables, event streams of users.

Every reader returns ``series_id bigint, label int, x array<double>`` (event
series have no label). File readers number rows in file order through the
partition and byte order in which Spark reads a file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seriesforge.functions.series import as_doubles, is_clean


class SeriesError(ValueError):
    """A dataset that breaks the fixed-length, no-missing-values contract."""


def dataset_paths(root: str, name: str) -> tuple[str, str]:
    """Train and test file of a named dataset."""
    return f"{root}/{name}/{name}_TRAIN.txt", f"{root}/{name}/{name}_TEST.txt"


def read_dataset_list(spark: SparkSession, path: str) -> list[str]:
    """Dataset names, one a line, blank lines dropped; always a list."""
    return [v for r in spark.read.text(path, wholetext=True).collect() for v in map(str.strip, r[0].splitlines()) if v]


def _numbered(lines: DataFrame) -> DataFrame:
    """Dense 0-based ``row_id`` in file order without a one-task sort.

    ``monotonically_increasing_id`` is ordered by partition and line; one count
    a partition turns it into a dense number.
    """
    base = lines.where(F.trim("value") != "").select("value", F.monotonically_increasing_id().alias("mono"))
    base = base.withColumn("part", F.shiftright("mono", 33).cast("int"))
    counts = base.groupBy("part").count().orderBy("part").collect()
    offset, pairs = 0, []
    for r in counts:
        pairs += [F.lit(r["part"]), F.lit(offset)]
        offset += r["count"]
    start = F.element_at(F.create_map(*pairs), F.col("part")) if pairs else F.lit(0)
    return base.select((start + F.col("mono").bitwiseAND((1 << 33) - 1)).cast("bigint").alias("series_id"), "value")


def _split(lines: DataFrame, pattern: str) -> DataFrame:
    v = F.transform(F.split(F.trim("value"), pattern), lambda t: t.cast("double"))
    return lines.select("series_id", v.alias("v")).select(
        "series_id", F.get("v", F.lit(0)).cast("int").alias("label"), F.slice("v", 2, F.greatest(F.size("v") - 1, F.lit(0))).alias("x")
    )


def read_series_text(spark: SparkSession, path: str) -> DataFrame:
    """Whitespace-delimited numbers without header: label, then samples."""
    return _split(_numbered(spark.read.text(path)), r"\s+")


def read_series_csv(spark: SparkSession, path: str, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Headerless CSV rows ``offset <= row_id < offset + limit``."""
    df = _split(_numbered(spark.read.text(path)), r"\s*,\s*").where(F.col("series_id") >= offset)
    return df if limit is None else df.where(F.col("series_id") < offset + limit)


def series_from_arrays(df: DataFrame, id_col: str, array_col: str, label_col: str | None = None) -> DataFrame:
    """A table that already holds arrays, such as vectors, as labelled series."""
    label = F.col(label_col).cast("int") if label_col else F.lit(None).cast("int")
    return df.select(F.col(id_col).cast("bigint").alias("series_id"), label.alias("label"), as_doubles(F.col(array_col)).alias("x"))


def series_from_events(events: DataFrame, length: int = 48) -> DataFrame:
    """The first ``length`` values of every user by (ts, event_id); shorter users are dropped.

    The rank filter is applied before the shuffle as well (Spark's window group
    limit), so that a user with billions of events sends ``length`` rows a task.
    """
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    top = events.select("user_id", "ts", "event_id", "value", F.row_number().over(order).alias("rn")).where(F.col("rn") <= length)
    packed = top.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("rn", "value"))).alias("r"))
    return packed.where(F.size("r") == length).select(
        F.col("user_id").alias("series_id"), F.lit(None).cast("int").alias("label"), F.transform("r", lambda s: s["value"]).alias("x")
    )


def assert_series(df: DataFrame) -> int:
    """Length of all series; raises on null, NaN, infinite or ragged input (0 for no rows)."""
    r = df.agg(
        F.count_if(~is_clean(F.col("x"))).alias("bad"), F.min(F.size("x")).alias("lo"), F.max(F.size("x")).alias("hi")
    ).first()
    if r["bad"]:
        raise SeriesError(f"{r['bad']} series hold null, NaN or infinite samples; repair them first")
    if r["lo"] != r["hi"]:
        raise SeriesError(f"series have {r['lo']} to {r['hi']} samples; pad them to one length first")
    return r["hi"] or 0


def repair_series(df: DataFrame, length: int) -> DataFrame:
    """Optional pre-step: carry the last good sample over gaps, then cut or zero-pad to ``length``."""
    ok = lambda v: v.isNotNull() & ~F.isnan(v)
    init = F.struct(F.array().cast("array<double>").alias("a"), F.lit(0.0).alias("last"))

    def step(acc, v):
        last = F.when(ok(v), v).otherwise(acc["last"])
        return F.struct(F.concat(acc["a"], F.array(last)).alias("a"), last.alias("last"))

    filled = F.aggregate("x", init, step, lambda acc: acc["a"])
    return df.withColumn("x", F.slice(F.concat(filled, F.array_repeat(F.lit(0.0), length)), 1, length))


def split_holdout(df: DataFrame, rows: int = 2048) -> tuple[DataFrame, DataFrame]:
    """Validation (the first ``rows`` ids) and training (all later ids)."""
    return df.where(F.col("series_id") < rows), df.where(F.col("series_id") >= rows)
