"""Rounding of doubles to the grids of half-precision formats, as Column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _grid(v: Column, least: int, bits: int, top: float) -> Column:
    v = v.cast("double")
    size = F.abs(v)
    unit = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(size)), F.lit(least)) - bits)
    inf = F.when(v > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(v.isNull() | F.isnan(v) | (v == 0), v).when(size >= top, inf).otherwise(F.rint(v / unit) * unit)


def f16(v: Column) -> Column:
    """Nearest half float, ties to even; overflow gives infinity."""
    return _grid(v, -14, 10, 65520.0)


def bf16(v: Column) -> Column:
    """Nearest bfloat16, ties to even."""
    return _grid(v, -126, 7, 3.3961775292304600e38)
