"""A tensor as a DataFrame of rows, and the relations its operators are made of.

``df`` has one record for each combination of leading indexes: ``row``, their row-major number, and
``values``, the last axis as an array of floats.  The shape is known on the driver, so every
operator is checked before data moves.  Operators that leave the last axis whole are projections on
``row`` and never shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import PlanError

Shape = tuple[int, ...]


@dataclass(frozen=True)
class TensorFrame:
    df: DataFrame
    shape: Shape

    @property
    def inner(self) -> int:
        return self.shape[-1]

    @property
    def leading(self) -> Shape:
        return self.shape[:-1]

    def map(self, f: Callable[[Column], Column]) -> TensorFrame:
        """Apply ``f`` to every element; results are 32-bit floats.  Columns beside ``values`` stay."""
        return TensorFrame(self.df.withColumn("values", F.transform("values", lambda x: f(x).cast("float"))), self.shape)

    def long(self) -> DataFrame:
        """(row, col, value) with the value as a double."""
        return self.df.select("row", F.posexplode("values").alias("col", "value")).select("row", F.col("col").cast("bigint"), F.col("value").cast("double"))


def axis_of(axis: int, rank: int) -> int:
    if not -rank <= axis < rank:
        raise PlanError(f"axis {axis} doesn't exist in a tensor of rank {rank}")
    return axis % rank


def strides(dims: Sequence[int]) -> list[int]:
    return [prod(dims[k + 1 :]) for k in range(len(dims))]


def indexes(number: Column, dims: Sequence[int]) -> list[Column]:
    """The indexes that a row-major number stands for."""
    return [F.floor(number / F.lit(s)).cast("bigint") % d for s, d in zip(strides(dims), dims, strict=True)]


def number(parts: Sequence[Column], dims: Sequence[int]) -> Column:
    total = F.lit(0).cast("bigint")
    for p, s in zip(parts, strides(dims), strict=True):
        total = total + p * s
    return total.cast("bigint")


def regroup(cells: DataFrame, shape: Shape) -> TensorFrame:
    """Rows from (lin, value): one shuffle, with sorted arrays of a row's width."""
    width = shape[-1]
    row = F.floor(F.col("lin") / width).cast("bigint")
    made = cells.groupBy(row.alias("row")).agg(F.sort_array(F.collect_list(F.struct((F.col("lin") % width).alias("c"), F.col("value").alias("v")))).alias("cells"))
    return TensorFrame(made.select("row", F.transform("cells", lambda x: x["v"]).alias("values")), shape)


def cells(t: TensorFrame) -> DataFrame:
    """(lin, value): every element with its row-major number."""
    return t.df.select("row", F.posexplode("values").alias("c", "value")).select((F.col("row") * t.inner + F.col("c")).cast("bigint").alias("lin"), "value")


def moved(t: TensorFrame, axis: int, size: int, to: Callable[[Column], Column], source: Callable[[Column], Column], keep: Callable[[Column], Column] | None = None) -> TensorFrame:
    """Rearrange one axis: ``to`` maps an old index to its new one, ``source`` the other way; ``keep`` selects old ones."""
    shape = (*t.shape[:axis], size, *t.shape[axis + 1 :])
    if axis == len(t.shape) - 1:
        gather = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda j: F.get("values", source(j).cast("int"))) if size else F.slice("values", 1, 0)
        return TensorFrame(t.df.select("row", gather.alias("values")), shape)
    parts = indexes(F.col("row"), t.leading)
    df = t.df if keep is None else t.df.where(keep(parts[axis]))
    parts[axis] = to(parts[axis])
    return TensorFrame(df.select(number(parts, shape[:-1]).alias("row"), "values"), shape)
