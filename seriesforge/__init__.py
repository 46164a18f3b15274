"""Random-convolution feature engine for time series, expressed as Spark DataFrames."""

from seriesforge.functions.kernels import Kernel, KernelBank, make_kernels
from seriesforge.operators.transform import transform, transform_long, transform_sql, transform_wide

__all__ = ["Kernel", "KernelBank", "make_kernels", "transform", "transform_long", "transform_sql", "transform_wide"]
