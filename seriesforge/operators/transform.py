"""Series x kernel transform.

Two equivalent plans: an Arrow batch transform (the engine; no shuffle, memory
bounded by one batch times one kernel) and a plain SQL form that explodes
positions and aggregates them in whole-stage codegen. Both add the taps in the
same order, so their results are equal bit for bit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesforge.functions.kernels import KERNEL_LENGTHS, Kernel, KernelBank

#: Rows of a batch that are convolved at once; bounds memory for wide output.
CHUNK_ROWS = 512


def _respond(xt: np.ndarray, k: Kernel, acc: np.ndarray, tmp: np.ndarray) -> np.ndarray:
    """Responses (output_length, n) of series stored as columns, written to ``acc``.

    Samples are rows of ``xt``, so the samples of a tap are one contiguous block;
    taps are added in ascending order and only where they are inside the series.
    """
    n = len(xt)
    out = k.output_length(n)
    if out < 1:
        raise ValueError("the kernel does not fit the series")
    acc = acc[:out]
    acc.fill(k.bias)
    for j, w in enumerate(k.weights):
        shift = j * k.dilation - k.padding
        lo, hi = max(0, -shift), min(out, n - shift)
        if lo < hi:
            part = np.multiply(xt[lo + shift : hi + shift], w, out=tmp[: hi - lo])
            np.add(acc[lo:hi], part, out=acc[lo:hi])
    return acc


def response(x: np.ndarray, k: Kernel) -> np.ndarray:
    """Responses of all rows of ``x`` (n, L) at all positions (n, output_length)."""
    xt = np.ascontiguousarray(x.T)
    return _respond(xt, k, np.empty(xt.shape), np.empty(xt.shape)).T


def features(x: np.ndarray, bank: KernelBank) -> np.ndarray:
    """(n, 2K): proportion of positive responses and maximum of kernel j at 2j and 2j + 1."""
    if x.shape[1] != bank.input_length:
        raise ValueError(f"the bank was drawn for {bank.input_length} samples, the series have {x.shape[1]}")
    xt = np.ascontiguousarray(x.T)
    acc, tmp = np.empty(xt.shape), np.empty(xt.shape)
    out = np.empty((2 * len(bank), len(x)))
    for j, k in enumerate(bank.kernels):
        r = _respond(xt, k, acc, tmp)
        np.divide(np.add.reduce((r > 0).view(np.uint8), axis=0, dtype=np.uint32), len(r), out=out[2 * j])
        r.max(axis=0, out=out[2 * j + 1])
    return np.ascontiguousarray(out.T)


def matrix(column: pa.Array, length: int) -> np.ndarray:
    """A batch of fixed-length list values as (n, length) doubles."""
    offsets = np.asarray(column.offsets)
    if column.null_count or np.any(np.diff(offsets) != length):
        raise ValueError(f"a series is null or does not have {length} samples")
    values = column.values.slice(offsets[0], offsets[-1] - offsets[0])
    if values.null_count:
        raise ValueError("a series holds a null sample")
    return values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, length)


def _prepared(df: DataFrame) -> DataFrame:
    keep = ["series_id", *(["label"] if "label" in df.columns else [])]
    return df.select(*keep, F.col("x").cast("array<double>").alias("x"))


def transform_wide(df: DataFrame, bank: KernelBank) -> DataFrame:
    """``series_id[, label], features array<double>`` of size 2K."""
    src = _prepared(df)
    schema = src.select(*[c for c in src.columns if c != "x"]).schema.add("features", T.ArrayType(T.DoubleType()))
    length = bank.input_length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK_ROWS):
                b = whole.slice(at, CHUNK_ROWS)
                f = features(matrix(b.column("x"), length), bank)
                offsets = np.arange(0, f.size + 1, f.shape[1], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(f.ravel()))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in schema.names[:-1]), lists], names=schema.names)

    return src.mapInArrow(run, schema)


def transform_long(df: DataFrame, bank: KernelBank) -> DataFrame:
    """``series_id[, label], kernel_id, ppv, mx``: one row for each series and kernel."""
    src = _prepared(df)
    carried = [c for c in src.columns if c != "x"]
    schema = src.select(*carried).schema.add("kernel_id", T.IntegerType()).add("ppv", T.DoubleType()).add("mx", T.DoubleType())
    length, k = bank.input_length, len(bank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = np.arange(k, dtype=np.int32)
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK_ROWS):
                b = whole.slice(at, CHUNK_ROWS)
                f = features(matrix(b.column("x"), length), bank)
                take = pa.array(np.repeat(np.arange(b.num_rows), k))
                cols = [b.column(c).take(take) for c in carried]
                cols += [pa.array(np.tile(ids, b.num_rows)), pa.array(f[:, 0::2].ravel()), pa.array(f[:, 1::2].ravel())]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return src.mapInArrow(run, schema)


def transform(df: DataFrame, bank: KernelBank, layout: str = "long") -> DataFrame:
    return {"long": transform_long, "wide": transform_wide}[layout](df, bank)


def output_length(size: Column) -> Column:
    return size + 2 * F.col("padding") - (F.col("length") - 1) * F.col("dilation")


def positions(df: DataFrame, bank_df: DataFrame) -> DataFrame:
    """Series x kernel x start position (``pos`` counts from ``-padding``).

    The bank has K rows, K being a parameter, so that the broadcast is bounded.
    Pairs whose position range is empty produce no rows.
    """
    pairs = df.crossJoin(F.broadcast(bank_df))
    n = output_length(F.size("x"))
    starts = F.sequence(-F.col("padding"), n - F.col("padding") - 1)
    return pairs.where(n > 0).withColumn("pos", F.explode(starts))


def tap(j: int) -> Column:
    """Product of tap ``j``; 0 outside the series or beyond the kernel."""
    at = F.col("pos") + j * F.col("dilation")
    inside = (F.lit(j) < F.col("length")) & (at >= 0) & (at < F.size("x"))
    return F.when(inside, F.get("weights", F.lit(j)) * F.get("x", at)).otherwise(F.lit(0.0))


def responses(df: DataFrame, bank_df: DataFrame) -> DataFrame:
    """``series_id, kernel_id, pos, resp``: bias plus taps in ascending order."""
    total = F.col("bias")
    for j in range(max(KERNEL_LENGTHS)):
        total = total + tap(j)
    return positions(df, bank_df).select("series_id", "kernel_id", "pos", total.alias("resp"))


def transform_sql(df: DataFrame, bank_df: DataFrame) -> DataFrame:
    """The long transform as one exploded, partially aggregated DataFrame plan."""
    return responses(df, bank_df).groupBy("series_id", "kernel_id").agg(
        (F.count_if(F.col("resp") > 0) / F.count(F.lit(1))).alias("ppv"), F.max("resp").alias("mx")
    )


def assemble_wide(long: DataFrame) -> DataFrame:
    """Long features to one array a series, kernel order, PPV before MAX; needs all kernels of a series."""
    rows = F.array_sort(F.collect_list(F.struct("kernel_id", "ppv", "mx")))
    return long.groupBy("series_id").agg(F.flatten(F.transform(rows, lambda r: F.array(r["ppv"], r["mx"]))).alias("features"))
