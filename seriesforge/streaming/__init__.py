"""The transform on unbounded inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame

from seriesforge.functions.kernels import KernelBank
from seriesforge.operators.normalise import znormalise
from seriesforge.operators.transform import transform_long


def transform_stream(stream: DataFrame, bank: KernelBank, normalise: bool = True):
    """Features of a streaming series frame. Row-wise and stateless: no watermark, no state store."""
    return transform_long(znormalise(stream) if normalise else stream, bank)
