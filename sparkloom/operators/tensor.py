"""The tensor operators as DataFrame plans."""

from __future__ import annotations

from math import prod

import numpy as np
from pyspark.sql import functions as F

from ..errors import PlanError
from ..functions.halffloat import f16
from .registry import tensor_op
from .tensorframe import TensorFrame, axis_of, cells, indexes, moved, number, regroup


def _one(shapes):
    if len(shapes) != 1:
        raise PlanError("the operator takes one input")
    return shapes[0]


def _same(shapes, args, dims):
    return _one(shapes)


@tensor_op("copy", "elementwise", _same)
def copy(inputs, args, dims):
    return inputs[0].map(lambda x: x)


def _cast_shape(shapes, args, dims):
    if args.get("dtype") not in ("float32", "float16"):
        raise PlanError(f"cast knows float32 and float16, not {args.get('dtype')}")
    return _one(shapes)


@tensor_op("cast", "elementwise", _cast_shape)
def cast(inputs, args, dims):
    return inputs[0].map(f16 if args["dtype"] == "float16" else lambda x: x)


@tensor_op("neg", "elementwise", _same)
def neg(inputs, args, dims):
    return inputs[0].map(lambda x: -x)


@tensor_op("log", "elementwise", _same)
def log(inputs, args, dims):
    """Natural logarithm; -Infinity at 0 and NaN below."""
    return inputs[0].map(lambda x: F.when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan"))).otherwise(F.ln(x.cast("double"))))


@tensor_op("exp", "elementwise", _same)
def exp(inputs, args, dims):
    return inputs[0].map(lambda x: F.exp(x.cast("double")))


def _reshape_shape(shapes, args, dims):
    old, new = _one(shapes), [int(n) for n in args["shape"]]
    if new.count(-1) > 1 or any(n < -1 for n in new):
        raise PlanError(f"at most one extent of {new} may be -1")
    if -1 in new:
        rest = prod(n for n in new if n != -1)
        if rest == 0 or prod(old) % rest:
            raise PlanError(f"{old} can't become {new}")
        new[new.index(-1)] = prod(old) // rest
    if prod(new) != prod(old):
        raise PlanError(f"{old} can't become {new}")
    return tuple(new)


@tensor_op("reshape", "shape", _reshape_shape)
def reshape(inputs, args, dims):
    t = inputs[0]
    shape = _reshape_shape([t.shape], args, dims)
    old, new = t.inner, shape[-1]
    if old == new:
        return TensorFrame(t.df, shape)
    if old % new == 0:  # rows split: no shuffle
        parts = F.transform(F.sequence(F.lit(0), F.lit(old // new - 1)), lambda k: F.struct(k.alias("k"), F.slice(F.col("values"), k * new + 1, F.lit(new)).alias("v")))
        split = t.df.select("row", F.explode(parts).alias("p"))
        return TensorFrame(split.select((F.col("row") * (old // new) + F.col("p.k")).cast("bigint").alias("row"), F.col("p.v").alias("values")), shape)
    if new % old == 0:  # whole rows join: one record a row is shuffled
        m = new // old
        joined = t.df.groupBy(F.floor(F.col("row") / m).cast("bigint").alias("to")).agg(F.sort_array(F.collect_list(F.struct("row", "values"))).alias("p"))
        return TensorFrame(joined.select(F.col("to").alias("row"), F.flatten(F.transform("p", lambda x: x["values"])).alias("values")), shape)
    return regroup(cells(t), shape)


def _unsqueeze_shape(shapes, args, dims):
    s = _one(shapes)
    k = axis_of(int(args["axis"]), len(s) + 1)
    return (*s[:k], 1, *s[k:])


@tensor_op("unsqueeze", "shape", _unsqueeze_shape)
def unsqueeze(inputs, args, dims):
    return reshape(inputs, {"shape": _unsqueeze_shape([inputs[0].shape], args, dims)}, dims)


def _squeeze_shape(shapes, args, dims):
    s = _one(shapes)
    if args.get("axis") is None:
        return tuple(n for n in s if n != 1) or (1,)
    k = axis_of(int(args["axis"]), len(s))
    if s[k] != 1:
        raise PlanError(f"axis {k} of {s} isn't of size 1")
    return (*s[:k], *s[k + 1 :])


@tensor_op("squeeze", "shape", _squeeze_shape)
def squeeze(inputs, args, dims):
    return reshape(inputs, {"shape": _squeeze_shape([inputs[0].shape], args, dims)}, dims)


def _axes(shape, axes):
    got = [axis_of(int(a), len(shape)) for a in axes]
    if sorted(got) != list(range(len(shape))):
        raise PlanError(f"{axes} doesn't permute the axes of {shape}")
    return got


def _transpose_shape(shapes, args, dims):
    s = _one(shapes)
    return tuple(s[a] for a in _axes(s, args.get("axes") or range(len(s) - 1, -1, -1)))


def _permute_shape(shapes, args, dims):
    if not args.get("axes"):
        raise PlanError("permute needs axes")
    return _transpose_shape(shapes, args, dims)


def _permuted(t: TensorFrame, axes) -> TensorFrame:
    axes = _axes(t.shape, axes)
    shape = tuple(t.shape[a] for a in axes)
    if axes[-1] == len(axes) - 1:  # only leading axes move
        parts = indexes(F.col("row"), t.leading)
        return TensorFrame(t.df.select(number([parts[a] for a in axes[:-1]], shape[:-1]).alias("row"), "values"), shape)
    parts = indexes(F.col("lin"), t.shape)
    return regroup(cells(t).select(number([parts[a] for a in axes], shape).alias("lin"), "value"), shape)


@tensor_op("transpose", "shape", _transpose_shape)
def transpose(inputs, args, dims):
    t = inputs[0]
    return _permuted(t, args.get("axes") or range(len(t.shape) - 1, -1, -1))


@tensor_op("permute", "shape", _permute_shape)
def permute(inputs, args, dims):
    return _permuted(inputs[0], args["axes"])


def _range(shape, args) -> tuple[int, range]:
    k, step = axis_of(int(args["axis"]), len(shape)), int(args.get("step", 1) or 0)
    if step == 0:
        raise PlanError("a slice can't step by 0")
    return k, range(*slice(args.get("start", 0), args.get("stop"), step).indices(shape[k]))


def _slice_shape(shapes, args, dims):
    s = _one(shapes)
    k, r = _range(s, args)
    return (*s[:k], len(r), *s[k + 1 :])


@tensor_op("slice", "shape", _slice_shape)
def slice_(inputs, args, dims):
    t = inputs[0]
    k, r = _range(t.shape, args)
    low, high = (min(r), max(r)) if len(r) else (1, 0)
    inside = lambda i: i.between(low, high) & ((i - r.start) % abs(r.step) == 0)
    return moved(t, k, len(r), lambda i: F.floor((i - r.start) / r.step).cast("bigint"), lambda j: j * r.step + r.start, inside)


def _concat_shape(shapes, args, dims):
    if len(shapes) < 2 or "axis" not in args:
        raise PlanError("concat takes two inputs or more and an axis")
    k = axis_of(int(args["axis"]), len(shapes[0]))
    rest = {(*s[:k], *s[k + 1 :]) for s in shapes}
    if len(rest) != 1 or len({len(s) for s in shapes}) != 1:
        raise PlanError(f"{shapes} don't fit together on axis {k}")
    return (*shapes[0][:k], sum(s[k] for s in shapes), *shapes[0][k + 1 :])


@tensor_op("concat", "combine", _concat_shape)
def concat(inputs, args, dims):
    shape = _concat_shape([t.shape for t in inputs], args, dims)
    k = axis_of(int(args["axis"]), len(shape))
    if k == len(shape) - 1:
        df = inputs[0].df
        for n, t in enumerate(inputs[1:]):
            df = df.join(t.df.select("row", F.col("values").alias(f"v{n}")), "row").select("row", F.concat("values", f"v{n}").alias("values"))
        return TensorFrame(df, shape)
    out, at = None, 0
    for t in inputs:
        parts = indexes(F.col("row"), t.leading)
        parts[k] = parts[k] + at
        part = t.df.select(number(parts, shape[:-1]).alias("row"), "values")
        out, at = part if out is None else out.unionByName(part), at + t.shape[k]
    return TensorFrame(out, shape)


def _blocks(shapes, args, even: int):
    s = _one(shapes)
    k, block = axis_of(int(args.get("axis", 0)), len(s)), int(args["block"])
    if block < 1 or s[k] % block or (s[k] // block) % even:
        raise PlanError(f"axis {k} of {s} doesn't divide into a multiple of {even} blocks of {block}")
    return k, block, s[k] // block


def _by_blocks(t: TensorFrame, k: int, block: int, to, source) -> TensorFrame:
    whole = lambda f: lambda i: f(F.floor(i / block).cast("bigint")) * block + i % block
    return moved(t, k, t.shape[k], whole(to), whole(source))


def _half(n):
    return (lambda b: F.when(b % 2 == 0, F.floor(b / 2)).otherwise(F.floor(b / 2) + n // 2).cast("bigint")), (lambda j: F.when(j < n // 2, 2 * j).otherwise(2 * j - n + 1).cast("bigint"))


def _block_shape(even):
    return lambda shapes, args, dims: (_blocks(shapes, args, even), shapes[0])[1]


@tensor_op("zip_blocks", "permute", _block_shape(2))
def zip_blocks(inputs, args, dims):
    """Even blocks first, then odd ones."""
    k, block, n = _blocks([inputs[0].shape], args, 2)
    to, source = _half(n)
    return _by_blocks(inputs[0], k, block, to, source)


@tensor_op("unzip_blocks", "permute", _block_shape(2))
def unzip_blocks(inputs, args, dims):
    k, block, n = _blocks([inputs[0].shape], args, 2)
    to, source = _half(n)
    return _by_blocks(inputs[0], k, block, source, to)


def _reorder_shape(shapes, args, dims):
    ratio = int(args.get("ratio", 2))
    if ratio < 1:
        raise PlanError("ratio must be positive")
    _blocks(shapes, args, ratio)
    return shapes[0]


@tensor_op("reorder_grouped_heads", "permute", _reorder_shape)
def reorder_grouped_heads(inputs, args, dims):
    ratio = int(args.get("ratio", 2))
    k, block, n = _blocks([inputs[0].shape], args, ratio)
    per = n // ratio
    return _by_blocks(inputs[0], k, block, lambda j: (j % per) * ratio + F.floor(j / per).cast("bigint"), lambda i: (i % ratio) * per + F.floor(i / ratio).cast("bigint"))


#: Names of the dimensions that give the head geometry where a step doesn't.
HEAD_DIMS = {"heads": "linear_num_value_heads", "k_heads": "linear_num_key_heads", "block": "linear_value_head_dim"}


def _heads(args, dims) -> dict:
    def value(name):
        v = args.get(name, HEAD_DIMS[name])
        if v is None and name == "k_heads":
            return value("heads")
        if isinstance(v, str):
            if v not in dims:
                raise PlanError(f"unknown dimension {v}")
            v = dims[v]
        return int(v)

    heads, k_heads = value("heads"), value("k_heads")
    if k_heads < 1 or heads % k_heads:
        raise PlanError(f"{heads} heads don't divide among {k_heads}")
    return {"axis": int(args.get("axis", 0)), "block": value("block"), "ratio": heads // k_heads, "heads": heads}


def _heads_shape(shapes, args, dims):
    s, h = _one(shapes), _heads(args, dims)
    if s[axis_of(h["axis"], len(s))] != h["heads"] * h["block"]:
        raise PlanError(f"{s} doesn't hold {h['heads']} heads of {h['block']}")
    return _reorder_shape(shapes, h, dims)


@tensor_op("qwen35_v_head_unpermute", "permute", _heads_shape)
def v_head_unpermute(inputs, args, dims):
    """Value heads back to grouped order; sizes are numbers or names of dimensions."""
    return reorder_grouped_heads(inputs, _heads(args, dims), dims)


def _binary_shape(shapes, args, dims):
    if len(shapes) == 1:
        if "value" not in args:
            raise PlanError("one input needs a value")
        return shapes[0]
    if len(shapes) != 2:
        raise PlanError("the operator takes one or two inputs")
    try:
        return np.broadcast_shapes(*shapes)
    except ValueError as e:
        raise PlanError(str(e)) from e


def _aligned(t: TensorFrame, shape, row):
    """Row of ``t`` that the row of a larger shape meets."""
    own = (1,) * (len(shape) - len(t.shape)) + t.shape
    parts = [p if n > 1 else F.lit(0).cast("bigint") for p, n in zip(indexes(row, shape[:-1]), own[:-1], strict=True)]
    return number(parts, own[:-1])


def _binary(name, f):
    @tensor_op(name, "combine", _binary_shape)
    def run(inputs, args, dims):
        op = lambda x, y: f(x.cast("float"), y.cast("float")).cast("float")
        if len(inputs) == 1:
            value = F.lit(float(args["value"]))
            return inputs[0].map(lambda x: op(x, value))
        a, b = inputs
        shape = tuple(np.broadcast_shapes(a.shape, b.shape))
        width = shape[-1]
        wide = lambda t, c: F.array_repeat(F.get(c, F.lit(0)), width) if t.inner == 1 < width else F.col(c)
        rows = a.df.select("row", F.col("values").alias("va")) if a.leading == shape[:-1] else a.df.sparkSession.range(prod(shape[:-1])).select(F.col("id").alias("row"), _aligned(a, shape, F.col("id")).alias("ra")).join(a.df.select(F.col("row").alias("ra"), F.col("values").alias("va")), "ra")
        other = b.df.select(F.col("row").alias("rb"), F.col("values").alias("vb"))
        rows = rows.withColumn("rb", _aligned(b, shape, F.col("row"))).join(F.broadcast(other) if prod(b.leading) == 1 else other, "rb")
        return TensorFrame(rows.select("row", F.zip_with(wide(a, "va"), wide(b, "vb"), op).alias("values")), shape)

    return run


def _quotient(x, y):
    inf, nan = float("inf"), F.lit(float("nan"))
    at_zero = F.when(x.isNull() | F.isnan(x) | (x == 0), nan).when(x > 0, F.lit(inf)).otherwise(F.lit(-inf))
    return F.when(y == 0, at_zero).otherwise(x.cast("double") / F.when(y == 0, F.lit(1.0)).otherwise(y.cast("double")))


add = _binary("add", lambda x, y: x + y)
sub = _binary("sub", lambda x, y: x - y)
mul = _binary("mul", lambda x, y: x * y)
div = _binary("div", _quotient)
