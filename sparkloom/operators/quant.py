"""Group-affine quantization: each group of a row's values gets a scale and a bias.

scale = (max - min) / (2^bits - 1), bias = min, code = rint((x - bias) / scale), 0 if the scale is 0;
values are rounded to half floats first, scales and biases after.  Groups never cross rows, so any
partitioning of rows gives the same codes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import PlanError
from ..functions.halffloat import f16
from .tensorframe import TensorFrame

BITS = (2, 3, 4, 6, 8)
GROUPS = (32, 64, 128)


def check(shape, bits: int, group: int) -> None:
    if bits not in BITS or group not in GROUPS:
        raise PlanError(f"bits must be one of {BITS} and the group one of {GROUPS}")
    if len(shape) < 2 or shape[-1] % group:
        raise PlanError(f"{tuple(shape)} can't be quantized in groups of {group}")


def groups_of(values: Column, width: int, group: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(width // group - 1)), lambda k: F.slice(values, k * group + 1, F.lit(group)))


def quantize(t: TensorFrame, bits: int, group: int, half: bool = True) -> DataFrame:
    """(row, grp, scale, bias, codes) without a shuffle. ``half``: inputs, scales and biases on the half-float grid."""
    check(t.shape, bits, group)
    top, grid = float(2**bits - 1), f16 if half else (lambda v: v.cast("double"))
    values = F.transform("values", lambda x: grid(x))
    parts = t.df.select("row", F.posexplode(groups_of(values, t.inner, group)).alias("grp", "v"))
    ranged = parts.select("row", "grp", "v", F.array_min("v").alias("lo"), F.array_max("v").alias("hi")).select("row", "grp", "v", "lo", ((F.col("hi") - F.col("lo")) / top).alias("step"))
    code = lambda x: F.when(F.col("step") == 0, F.lit(0)).otherwise(F.least(F.greatest(F.rint((x - F.col("lo")) / F.when(F.col("step") == 0, F.lit(1.0)).otherwise(F.col("step"))), F.lit(0.0)), F.lit(top)).cast("int"))
    return ranged.select("row", "grp", grid(F.col("step")).alias("scale"), grid(F.col("lo")).alias("bias"), F.transform("v", code).alias("codes"))


def quantize_rows(t: TensorFrame, bits: int, group: int, half: bool = True) -> DataFrame:
    """(row, scales, biases, codes): whole rows with the codes of all their groups, as one projection."""
    check(t.shape, bits, group)
    top, grid = float(2**bits - 1), f16 if half else (lambda v: v.cast("double"))

    def of_group(v):
        lo = F.array_min(v)
        return F.struct(v.alias("v"), lo.alias("lo"), ((F.array_max(v) - lo) / top).alias("step"))

    def codes_of(g):
        step = F.when(g["step"] == 0, F.lit(1.0)).otherwise(g["step"])
        return F.transform(g["v"], lambda x: F.when(g["step"] == 0, F.lit(0)).otherwise(F.least(F.greatest(F.rint((x - g["lo"]) / step), F.lit(0.0)), F.lit(top)).cast("int")))

    ranged = t.df.select("row", F.transform(groups_of(F.transform("values", lambda x: grid(x)), t.inner, group), of_group).alias("g"))
    return ranged.select("row", F.transform("g", lambda g: grid(g["step"])).alias("scales"), F.transform("g", lambda g: grid(g["lo"])).alias("biases"), F.flatten(F.transform("g", codes_of)).alias("codes"))


def dequantize(q: DataFrame) -> DataFrame:
    """(row, grp, values)."""
    return q.select("row", "grp", F.transform("codes", lambda c: (c * F.col("scale") + F.col("bias")).cast("float")).alias("values"))


def dequantize_rows(q: DataFrame, group: int) -> DataFrame:
    """(row, values) of whole rows from ``quantize_rows``, as one projection: codes times scale plus bias, as doubles."""
    parts = F.zip_with("scales", "biases", lambda s, b: F.struct(s.cast("double").alias("s"), b.cast("double").alias("b")))
    of_group = lambda g, k: F.transform(F.slice("codes", k * group + 1, F.lit(group)), lambda c: c * g["s"] + g["b"])
    return q.select("row", F.flatten(F.transform(parts, of_group)).alias("values"))


def as_tensor(groups: DataFrame, shape) -> TensorFrame:
    """Groups of a row joined again, in order."""
    joined = groups.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("grp", "values"))).alias("g"))
    return TensorFrame(joined.select("row", F.flatten(F.transform("g", lambda g: g["values"])).alias("values")), tuple(shape))


def pack(q: DataFrame, bits: int, group: int) -> DataFrame:
    """(row, grp, words): codes in 32-bit words, lowest bits first; a code may cross two words.

    Each word is an expression over the codes that overlap it, and no others.
    """

    def word(w):
        out = F.lit(0).cast("bigint")
        for i in range(32 * w // bits, min(group, -(-(32 * w + 32) // bits))):
            at, code = i * bits - 32 * w, F.get("codes", F.lit(i)).cast("bigint")
            out = out.bitwiseOR(F.shiftleft(code, at) if at >= 0 else F.shiftright(code, -at))
        return out.bitwiseAND(F.lit(2**32 - 1))

    return q.select("row", "grp", F.array(*[word(w) for w in range(group * bits // 32)]).alias("words"))


def unpack(packed: DataFrame, bits: int, group: int) -> DataFrame:
    """(row, grp, codes) from ``pack``."""

    def code(i):
        w, at = divmod(i * bits, 32)
        out = F.shiftright(F.get("words", F.lit(w)), at)
        if at + bits > 32:
            out = out.bitwiseOR(F.shiftleft(F.get("words", F.lit(w + 1)), 32 - at))
        return out.bitwiseAND(F.lit(2**bits - 1)).cast("int")

    return packed.select("row", "grp", F.array(*[code(i) for i in range(group)]).alias("codes"))


def half_only(t: TensorFrame) -> TensorFrame:
    """What an output that isn't quantized looks like: half floats."""
    return t.map(f16)


def settings(bits: int, group: int, rule_bits: Column, rule_group: Column) -> tuple[Column, Column]:
    """A rule's own bits and group stand before those of the conversion."""
    return F.coalesce(rule_bits, F.lit(bits)), F.coalesce(rule_group, F.lit(group))
