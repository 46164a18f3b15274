"""Seeded random kernel banks.

A bank is small (K rows of at most 11 weights), lives on the driver and travels
to executors in task closures or as a DataFrame of one row per kernel. The
length it was drawn for is stored with it so that it is never applied to series
of another length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: The kernel lengths that the method draws from.
KERNEL_LENGTHS = (7, 9, 11)

BANK_SCHEMA = T.StructType(
    [
        T.StructField("kernel_id", T.IntegerType(), False),
        T.StructField("length", T.IntegerType(), False),
        T.StructField("weights", T.ArrayType(T.DoubleType(), False), False),
        T.StructField("bias", T.DoubleType(), False),
        T.StructField("dilation", T.IntegerType(), False),
        T.StructField("padding", T.IntegerType(), False),
    ]
)


@dataclass(frozen=True)
class Kernel:
    """One dilated kernel; ``span`` is the distance from its first to its last tap."""

    weights: tuple[float, ...]
    bias: float
    dilation: int
    padding: int

    @property
    def length(self) -> int:
        return len(self.weights)

    @property
    def span(self) -> int:
        return (self.length - 1) * self.dilation

    def output_length(self, n: int) -> int:
        return n + 2 * self.padding - self.span


@dataclass(frozen=True)
class KernelBank:
    """Kernels drawn for series of ``input_length`` samples."""

    input_length: int
    kernels: tuple[Kernel, ...]

    def __len__(self) -> int:
        return len(self.kernels)

    def prefix(self, k: int) -> KernelBank:
        return KernelBank(self.input_length, self.kernels[:k])

    def rows(self) -> list[tuple]:
        return [(i, k.length, list(k.weights), k.bias, k.dilation, k.padding) for i, k in enumerate(self.kernels)]

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), BANK_SCHEMA)

    def sql_values(self, alias: str = "bank") -> str:
        """A ``VALUES`` relation of the bank for SQL engines, doubles written exactly."""
        d = lambda v: f"'{v!r}'::DOUBLE"
        rows = ", ".join(
            f"({i}, {k.length}, [{', '.join(map(d, k.weights))}], {d(k.bias)}, {k.dilation}, {k.padding})"
            for i, k in enumerate(self.kernels)
        )
        return f"(VALUES {rows}) AS {alias}(kernel_id, length, weights, bias, dilation, padding)"


@dataclass(frozen=True)
class Draw:
    """What chance decides of one kernel: normal numbers, two numbers in [0, 1) and a coin."""

    normals: tuple[float, ...]
    bias: float
    dilation: float
    same: bool

    def kernel(self, input_length: int) -> Kernel:
        """Centred weights; bias in (-1, 1); log-uniform dilation whose span fits the series; "same" padding on heads."""
        w, reach = np.array(self.normals), len(self.normals) - 1
        dilation = max(1, int(2.0 ** (self.dilation * np.log2((input_length - 1) / reach))))
        return Kernel(tuple((w - w.mean()).tolist()), -1.0 + 2.0 * self.bias, dilation, reach * dilation // 2 if self.same else 0)


def draw_kernels(num_kernels: int, seed: int) -> list[Draw]:
    """All lengths first (uniform over 7, 9, 11), then each kernel's own numbers."""
    rng = np.random.default_rng(seed)
    return [Draw(tuple(rng.standard_normal(n).tolist()), rng.random(), rng.random(), bool(rng.integers(2))) for n in rng.choice(KERNEL_LENGTHS, num_kernels).tolist()]


def make_kernels(input_length: int, num_kernels: int, seed: int) -> KernelBank:
    """Draw a bank; the same seed gives the same kernels.

    >>> bank = make_kernels(64, 3, seed=1)
    >>> all(abs(sum(k.weights)) < 1e-12 and k.span <= 63 for k in bank.kernels)
    True
    """
    if input_length < max(KERNEL_LENGTHS):
        raise ValueError(f"series of {input_length} samples are shorter than the longest kernel ({max(KERNEL_LENGTHS)})")
    if num_kernels < 1:
        raise ValueError("a bank needs at least one kernel")
    return KernelBank(input_length, tuple(d.kernel(input_length) for d in draw_kernels(num_kernels, seed)))
