"""Mini-batch softmax regression on transformed series.

The transform is distributed and runs once; its features are written as float32, a
folder a tranche, to the shared folder of the session. The updates are sequential by
nature, so the driver streams the tranches in order; it keeps those that fit
``cache_bytes`` and the validation rows, and reads the others again every epoch.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesforge.functions.kernels import KernelBank
from seriesforge.operators.normalise import FEATURE_EPSILON, znormalise
from seriesforge.operators.transform import transform_wide

#: Learning rates searched on the first minibatch, in this order.
LEARNING_RATES = (1e-1, 1e-2, 1e-3, 1e-4, 1e-5, 1e-6)


def cross_entropy(logits: np.ndarray, y: np.ndarray) -> float:
    """Mean negative log softmax of the true class."""
    top = logits.max(axis=1, keepdims=True)
    lse = np.log(np.exp(logits - top).sum(axis=1)) + top[:, 0]
    return float(np.mean(lse - logits[np.arange(len(y)), y]))


@dataclass
class Adam:
    """Adam (Kingma and Ba 2015) with its published default constants."""

    lr: float
    state: dict = field(default_factory=dict)
    t: int = 0

    def step(self, params: dict[str, np.ndarray], grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            m, v = self.state.get(k, (np.zeros_like(g), np.zeros_like(g)))
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            self.state[k] = m, v
            params[k] -= self.lr * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


@dataclass
class Plateau:
    """Halves the rate after more than ``patience`` checks without a relative gain of 1e-4."""

    factor: float = 0.5
    patience: int = 10
    min_lr: float = 1e-8
    best: float = np.inf
    bad: int = 0

    def step(self, loss: float, lr: float) -> float:
        if loss < self.best * (1 - 1e-4):
            self.best, self.bad = loss, 0
        else:
            self.bad += 1
        if self.bad > self.patience:
            self.bad, lr = 0, max(lr * self.factor, self.min_lr)
        return lr


@dataclass
class StopRule:
    """Stop after ``patience`` checks at or above the best loss; the stop latches."""

    patience: int = 2
    best: float = np.inf
    stalls: int = 0
    stopped: bool = False

    def check(self, loss: float) -> bool:
        if loss >= self.best:
            self.stalls += 1
            self.stopped |= self.stalls >= self.patience
        else:
            self.best = loss
            if not self.stopped:
                self.stalls = 0
        return self.stopped


@dataclass
class SoftmaxModel:
    weights: np.ndarray  # (features, classes)
    bias: np.ndarray
    mean: np.ndarray
    std: np.ndarray
    history: list[tuple[int, float]]

    @property
    def coef(self) -> np.ndarray:
        return self.weights.T

    @property
    def intercept(self) -> np.ndarray:
        return self.bias

    def predict(self, x: np.ndarray) -> np.ndarray:
        return (_standard(x.astype(np.float32), self.mean, self.std) @ self.weights + self.bias).argmax(axis=1)


def _standard(x: np.ndarray, mean: np.ndarray, std: np.ndarray) -> np.ndarray:
    """float32 features standardised in double precision and rounded once."""
    return ((x - mean) / std).astype(np.float32)


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    rows = table.column("features").combine_chunks()
    return rows.flatten().to_numpy().reshape(len(rows), -1) if len(rows) else np.empty((0, 0), np.float32), table.column("label").to_numpy()


def _gradients(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    z = x @ p["w"] + p["b"]
    e = np.exp(z - z.max(axis=1, keepdims=True))
    e /= e.sum(axis=1, keepdims=True)
    e[np.arange(len(y)), y] -= 1.0
    return {"w": x.T @ e / len(y), "b": e.mean(axis=0)}


@dataclass
class SoftmaxTrainer:
    num_classes: int
    minibatch_size: int = 256
    max_epochs: int = 100
    patience: int = 2
    tranche_size: int = 2**11
    normalise: bool = True
    check_every: int = 10
    seed: int = 0

    cache_bytes: int = 1 << 30

    def _zero(self, width: int) -> dict[str, np.ndarray]:
        return {"w": np.zeros((width, self.num_classes), np.float32), "b": np.zeros(self.num_classes, np.float32)}

    def search_rate(self, batch: tuple, tranche: tuple) -> float:
        """One update of a zero model on the minibatch by rate; the lowest loss on the tranche, first on ties."""
        best, choice = np.inf, LEARNING_RATES[0]
        for lr in LEARNING_RATES:
            p = self._zero(batch[0].shape[1])
            Adam(lr).step(p, _gradients(p, *batch))
            if (loss := cross_entropy(tranche[0] @ p["w"] + p["b"], tranche[1])) < best:
                best, choice = loss, lr
        return choice

    def minibatches(self, tranches: int, load: Callable[[int], tuple]) -> Iterator[tuple[int, tuple, np.ndarray]]:
        """(epoch, rows of a tranche, picks) in order; an undersized minibatch counts only where it is a tranche's one."""
        rng, size = np.random.default_rng(self.seed), self.minibatch_size
        for epoch in range(self.max_epochs):
            for t in range(tranches):
                rows = load(t)
                order = rng.permutation(len(rows[1]))
                for k in range(len(order) // size or min(len(order), 1)):
                    yield epoch, rows, order[k * size : (k + 1) * size]

    def fit(self, train: DataFrame, valid: DataFrame, bank: KernelBank) -> SoftmaxModel:
        """Train on ``series_id, label, x`` with labels 0 .. num_classes - 1."""
        spark = train.sparkSession
        wide = lambda d: transform_wide(znormalise(d) if self.normalise else d, bank).withColumn("features", F.col("features").cast("array<float>"))
        if valid.count() * 8 * len(bank) > self.cache_bytes:
            raise ValueError("the validation rows do not fit cache_bytes; split off fewer")
        first, last = train.agg(F.min("series_id"), F.max("series_id")).first()
        tranches = (last - first) // self.tranche_size + 1
        tid = F.floor((F.col("series_id") - first) / self.tranche_size).cast("int")
        path = f"{spark.conf.get('spark.checkpoint.dir', None) or tempfile.mkdtemp(prefix='tranches-')}/{uuid.uuid4().hex}"
        feats = wide(train).withColumn("tranche", tid).select("series_id", "label", "features", "tranche")
        feats.write.partitionBy("tranche").parquet(path)
        stored = spark.read.schema(feats.schema).parquet(path)
        held: dict[int, tuple] = {}

        def load(t: int) -> tuple[np.ndarray, np.ndarray]:
            if t not in held:
                x, y = _matrix(stored.where(F.col("tranche") == t).orderBy("series_id").select("label", "features").toArrow())
                rows = (_standard(x, mean, std) if len(y) else x), y
                if (len(held) + 1) * rows[0].nbytes > self.cache_bytes:
                    return rows
                held[t] = rows
            return held[t]

        try:
            head = _matrix(stored.where("tranche = 0").orderBy("series_id").select("label", "features").toArrow())[0].astype(float)
            mean, std = head.mean(axis=0), head.std(axis=0) + FEATURE_EPSILON
            del head
            vx, vy = _matrix(wide(valid).select("label", "features").toArrow())
            vx = _standard(vx, mean, std)
            p, adam, plateau, rule = self._zero(vx.shape[1]), None, Plateau(), StopRule(self.patience)
            seen, history = 0, []
            for epoch, (x, y), pick in self.minibatches(tranches, load):
                if epoch and rule.stopped:
                    break
                batch = x[pick], y[pick]
                if adam is None:
                    adam = Adam(self.search_rate(batch, (x, y)))
                adam.step(p, _gradients(p, *batch))
                seen += 1
                if seen % self.check_every == 0:
                    loss = cross_entropy(vx @ p["w"] + p["b"], vy)
                    history.append((seen, loss))
                    adam.lr = plateau.step(loss, adam.lr)
                    rule.check(loss)
            return SoftmaxModel(p["w"], p["b"], mean, std, history)
        finally:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
