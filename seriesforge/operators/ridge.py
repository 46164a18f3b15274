"""Ridge classifier with closed-form leave-one-out choice of the penalty.

Targets are +-1 one-vs-rest, columns are centred and divided by their L2 norm,
one penalty serves all classes. Three routes give the same model:

* features of at most ``MAX_GATHERED`` bytes in all: the transform is distributed, the
  features meet in the driver and are solved there;
* rows <= features: the series (n x L, checked against ``max_block_bytes``)
  travel to tasks that each own a block of kernels; every task makes its feature
  block and adds its share of the n x n Gram matrix;
* rows > features: tasks own rows and add shares of the p x p moment matrix.

Shares are summed in groups of tasks before the driver adds the last few.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesforge.functions.kernels import KernelBank
from seriesforge.operators.transform import features, transform_wide

#: The penalties tried by default.
ALPHAS = tuple(10.0**e for e in np.linspace(-3, 3, 10))

#: Bytes of shares that the driver takes at once; more are summed on executors first.
MAX_COLLECTED = 1 << 29
#: Bytes of features that the driver gathers; beyond, the Gram or moment matrix is added up on executors.
MAX_GATHERED = 1 << 28


@dataclass
class RidgeModel:
    classes: np.ndarray
    coef: np.ndarray  # (classes or 1, features)
    intercept: np.ndarray
    alpha: float
    loo_mse: dict[float, float]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return x @ self.coef.T + self.intercept

    def predict(self, x: np.ndarray) -> np.ndarray:
        s = self.scores(x)
        at = (s[:, 0] > 0).astype(int) if len(self.coef) == 1 else s.argmax(axis=1)
        return self.classes[at]


def targets(labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted classes and +-1 targets; two classes share one column."""
    classes = np.unique(labels)
    if len(classes) < 2:
        raise ValueError("a classifier needs at least two classes")
    y = np.where(labels[:, None] == classes[None, :], 1.0, -1.0)
    return classes, y[:, 1:] if len(classes) == 2 else y


def spectrum(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (none negative) and eigenvectors; one decomposition serves all penalties and the solution."""
    values, q = np.linalg.eigh(gram)
    return np.maximum(values, 0.0), q


def loo_errors(values: np.ndarray, q: np.ndarray, y: np.ndarray, alphas: tuple[float, ...]) -> dict[float, float]:
    """Mean squared leave-one-out residual by penalty from the spectrum of the n x n Gram matrix of centred columns."""
    yc = y - y.mean(axis=0)
    qy, q2 = q.T @ yc, q**2
    out = {}
    for a in alphas:
        shrink = values / (values + a)
        leverage = q2 @ shrink + 1.0 / len(y)
        rest = yc - q @ (shrink[:, None] * qy)
        out[a] = float(np.mean((rest / np.maximum(1.0 - leverage, 1e-12)[:, None]) ** 2))
    return out


def _scaled(block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mean = block.mean(axis=0)
    z = block - mean
    norm = np.sqrt((z * z).sum(axis=0))
    norm = np.where(norm > 1e-12, norm, 1.0)
    return z / norm, mean, norm


def _summed(parts: DataFrame, shape: tuple[int, int], groups: int) -> np.ndarray:
    """Sum of byte-packed matrices ``m``: within ``groups`` groups on executors, then on the driver."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(shape)
        for b in pdf["m"]:
            total += np.frombuffer(b).reshape(shape)
        return pd.DataFrame({"m": [total.tobytes()]})

    total = np.zeros(shape)
    if parts.rdd.getNumPartitions() * total.nbytes > MAX_COLLECTED:
        parts = parts.groupBy(F.pmod("part", F.lit(groups))).applyInPandas(add, "m binary")
        blobs = (r["m"] for r in parts.toLocalIterator())
    else:  # a part for each task, computed side by side and small enough together
        blobs = parts.select("m").toPandas()["m"]
    for m in blobs:
        total += np.frombuffer(m).reshape(shape)
    return total


def fit_ridge(
    df: DataFrame, bank: KernelBank, alphas: tuple[float, ...] = ALPHAS, block: int = 64, max_block_bytes: int = 1 << 28
) -> RidgeModel:
    """Fit on ``series_id, label, x``; picks the route by the number of rows."""
    n = df.count()
    if n * 16 * len(bank) <= MAX_GATHERED:
        return _fit_gathered(df, bank, alphas)
    wide = n > 2 * len(bank)
    if not wide and n * bank.input_length * 8 > max_block_bytes:
        raise ValueError("too few kernels for the row route and too many rows for the kernel route")
    return (_fit_rows if wide else _fit_kernels)(df, bank, alphas, block)


def _fit_gathered(df: DataFrame, bank: KernelBank, alphas: tuple[float, ...]) -> RidgeModel:
    table = transform_wide(df.select("series_id", "label", "x"), bank).select("series_id", "label", "features").toArrow().combine_chunks()
    order = np.argsort(table.column("series_id").to_numpy(), kind="stable")
    x = table.column("features").combine_chunks().flatten().to_numpy().reshape(len(order), -1)[order]
    classes, y = targets(table.column("label").to_numpy()[order])
    z, mean, norm = _scaled(x)
    yc = y - y.mean(axis=0)
    if len(z) <= z.shape[1]:
        values, q = spectrum(z @ z.T)
        errors = loo_errors(values, q, y, alphas)
        alpha = min(alphas, key=lambda a: errors[a])
        w = z.T @ (q @ ((q.T @ yc) / (values + alpha)[:, None]))
    else:
        values, v = spectrum(z.T @ z)
        u, errors = z @ v, {}
        uy = u.T @ yc
        for a in alphas:
            rest = yc - u @ (uy / (values + a)[:, None])
            leverage = (u * u) @ (1.0 / (values + a)) + 1.0 / len(z)
            errors[a] = float(np.mean((rest / np.maximum(1.0 - leverage, 1e-12)[:, None]) ** 2))
        alpha = min(alphas, key=lambda a: errors[a])
        w = v @ (uy / (values + alpha)[:, None])
    w = w / norm[:, None]
    return RidgeModel(classes, w.T, y.mean(axis=0) - mean @ w, alpha, errors)


def _fit_kernels(df: DataFrame, bank: KernelBank, alphas: tuple[float, ...], block: int) -> RidgeModel:
    spark = df.sparkSession
    rows = df.select("series_id", "label", "x").orderBy("series_id").toPandas()  # size checked by fit_ridge
    x = np.vstack(rows["x"].to_numpy()).astype(float)
    classes, y = targets(rows["label"].to_numpy())
    n, p = len(x), 2 * len(bank)
    held = spark.sparkContext.broadcast(x)
    tasks = max(1, min(-(-len(bank) // block), spark.sparkContext.defaultParallelism))
    blocks = spark.range(0, len(bank), block, numPartitions=tasks).select(F.col("id").alias("part"))

    def part_bank(at: int) -> KernelBank:
        return KernelBank(bank.input_length, bank.kernels[at : at + block])

    def share(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, part = np.zeros((n, n)), 0
        for pdf in batches:
            for part in pdf["part"].tolist():
                z, _, _ = _scaled(features(held.value, part_bank(part)))
                total += z @ z.T
        yield pd.DataFrame({"part": [part // block], "m": [total.tobytes()]})

    gram = _summed(blocks.mapInPandas(share, "part long, m binary"), (n, n), groups=8)
    values, q = spectrum(gram)
    errors = loo_errors(values, q, y, alphas)
    alpha = min(alphas, key=lambda a: errors[a])
    dual = q @ ((q.T @ (y - y.mean(axis=0))) / (values + alpha)[:, None])

    def weights(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in pdf["part"].tolist():
                z, mean, norm = _scaled(features(held.value, part_bank(at)))
                w = (z.T @ dual) / norm[:, None]
                yield pd.DataFrame({"part": [at], "m": [w.tobytes()], "shift": [(mean @ w).tobytes()]})

    coef, shift = np.zeros((p, y.shape[1])), np.zeros(y.shape[1])
    for r in blocks.mapInPandas(weights, "part long, m binary, shift binary").collect():  # features x classes numbers in all
        w = np.frombuffer(r["m"]).reshape(-1, y.shape[1])
        coef[2 * r["part"] : 2 * r["part"] + len(w)] = w
        shift += np.frombuffer(r["shift"])
    held.unpersist()
    return RidgeModel(classes, coef.T, y.mean(axis=0) - shift, alpha, errors)


def _fit_rows(df: DataFrame, bank: KernelBank, alphas: tuple[float, ...], block: int) -> RidgeModel:
    labels = sorted(r["label"] for r in df.select("label").distinct().collect())  # one row a class
    classes, p = np.array(labels), 2 * len(bank)
    q = 1 if len(classes) == 2 else len(classes)
    wide = transform_wide(df.select("series_id", "label", "x"), bank).persist()
    shape = (p + q + 1, p + q + 1)

    def encode(pdf: pd.DataFrame) -> np.ndarray:
        y = np.where(pdf["label"].to_numpy()[:, None] == classes[None, :], 1.0, -1.0)
        return np.hstack([np.vstack(pdf["features"].to_numpy()), y[:, 1:] if q == 1 else y, np.ones((len(pdf), 1))])

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, part = np.zeros(shape), 0
        for pdf in batches:
            if len(pdf):
                a = encode(pdf)
                total, part = total + a.T @ a, int(pdf["series_id"].iloc[0])
        yield pd.DataFrame({"part": [part], "m": [total.tobytes()]})

    try:
        m = _summed(wide.mapInPandas(moments, "part long, m binary"), shape, groups=8)
        n = m[-1, -1]
        mean, ymean = m[-1, :p] / n, m[-1, p : p + q] / n
        cov = m[:p, :p] - n * np.outer(mean, mean)
        norm = np.sqrt(np.maximum(np.diag(cov), 0.0))
        norm = np.where(norm > 1e-12, norm, 1.0)
        values, v = np.linalg.eigh(cov / np.outer(norm, norm))
        values = np.maximum(values, 0.0)
        vxy = v.T @ ((m[:p, p : p + q] - n * np.outer(mean, ymean)) / norm[:, None])

        def residuals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if not len(pdf):
                    continue
                a = encode(pdf)
                u = ((a[:, :p] - mean) / norm) @ v
                yc, out = a[:, p : p + q] - ymean, []
                for alpha in alphas:
                    rest = yc - u @ (vxy / (values + alpha)[:, None])
                    leverage = (u**2) @ (1.0 / (values + alpha)) + 1.0 / n
                    out.append(float(((rest / np.maximum(1 - leverage, 1e-12)[:, None]) ** 2).sum()))
                yield pd.DataFrame({"i": range(len(alphas)), "sse": out})

        sse = {r["i"]: r["s"] for r in wide.mapInPandas(residuals, "i int, sse double").groupBy("i").agg(F.sum("sse").alias("s")).collect()}
    finally:
        wide.unpersist()
    errors = {a: sse[i] / (n * q) for i, a in enumerate(alphas)}
    alpha = min(alphas, key=lambda a: errors[a])
    w = (v @ (vxy / (values + alpha)[:, None])) / norm[:, None]
    return RidgeModel(classes, w.T, ymean - mean @ w, alpha, errors)
