"""The transform in SQL text: a table function of one series, for ad-hoc queries.

    register_kernel_transform(spark, bank)
    SELECT s.series_id, t.* FROM series s, LATERAL kernel_transform(s.x) t

It crosses into Python once a row; ``transform_long`` is the engine for tables.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from seriesforge.functions.kernels import KernelBank
from seriesforge.operators.transform import features


def register_kernel_transform(spark: SparkSession, bank: KernelBank, name: str = "kernel_transform") -> None:
    """Register ``name(array<double>) -> (kernel_id int, ppv double, mx double)``."""

    class KernelTransform:
        def eval(self, x: list):
            if x is None or any(v is None for v in x):
                raise ValueError("a series is null or holds a null sample")
            f = features(np.array([x], dtype=np.float64), bank)[0]
            for k in range(len(bank)):
                yield k, float(f[2 * k]), float(f[2 * k + 1])

    spark.udtf.register(name, udtf(KernelTransform, returnType="kernel_id int, ppv double, mx double"))
