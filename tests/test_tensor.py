import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.errors import PlanError
from sparkloom.functions.halffloat import bf16, f16
from sparkloom.operators import quant, registry
from sparkloom.operators import tensor as _tensor  # noqa: F401
from sparkloom.operators.tensorframe import TensorFrame

R = np.random.default_rng(11)


def frame(spark, x):
    rows = x.reshape(-1, x.shape[-1])
    return TensorFrame(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "row bigint, values array<float>"), x.shape)


def back(t):
    return np.array([r["values"] for r in t.df.orderBy("row").collect()], "float32").reshape(t.shape)


def split(x, axis, block):
    return np.split(x, x.shape[axis] // block, axis)


def zipped(x, axis, block):
    b = split(x, axis, block)
    return np.concatenate(b[::2] + b[1::2], axis)


def reordered(x, axis, block, ratio):
    b = split(x, axis, block)
    k = len(b) // ratio
    return np.concatenate([b[(i % ratio) * k + i // ratio] for i in range(len(b))], axis)


X = R.normal(size=(6, 4, 8)).astype("float32")
CASES = [
    ("copy", {}, X, X), ("cast", {"dtype": "float16"}, X, X.astype("float16").astype("float32")), ("neg", {}, X, -X), ("exp", {}, X, np.exp(X.astype("float64")).astype("float32")),
    ("reshape", {"shape": [-1, 2, 4]}, X, X.reshape(-1, 2, 4)), ("reshape", {"shape": [4, 48]}, X, X.reshape(4, 48)), ("reshape", {"shape": [192]}, X, X.ravel()), ("reshape", {"shape": [8, 24]}, X, X.reshape(8, 24)), ("reshape", {"shape": [64, 3]}, X, X.reshape(64, 3)),
    ("unsqueeze", {"axis": -1}, X, X[..., None]), ("unsqueeze", {"axis": 0}, X, X[None]), ("squeeze", {}, X[:1, :, :1], X[:1, :, :1].squeeze()), ("squeeze", {"axis": 0}, X[:1], X[0]),
    ("transpose", {}, X, X.transpose()), ("transpose", {"axes": [1, 0, 2]}, X, X.transpose(1, 0, 2)), ("permute", {"axes": [2, 0, 1]}, X, X.transpose(2, 0, 1)), ("permute", {"axes": [0, -1, 1]}, X, X.transpose(0, 2, 1)),
    ("slice", {"axis": 0, "start": 1, "stop": 5, "step": 2}, X, X[1:5:2]), ("slice", {"axis": -1, "start": -3}, X, X[..., -3:]), ("slice", {"axis": 1, "step": -1, "start": 3}, X, X[:, 3::-1]), ("slice", {"axis": 2, "start": 6, "stop": 100, "step": 3}, X, X[..., 6:100:3]),
    ("zip_blocks", {"axis": 0, "block": 1}, X, zipped(X, 0, 1)), ("zip_blocks", {"axis": -1, "block": 2}, X, zipped(X, 2, 2)), ("zip_blocks", {"axis": 1, "block": 2}, X, zipped(X, 1, 2)),
    ("reorder_grouped_heads", {"axis": 0, "block": 1, "ratio": 3}, X, reordered(X, 0, 1, 3)), ("reorder_grouped_heads", {"axis": 2, "block": 2, "ratio": 2}, X, reordered(X, 2, 2, 2)), ("reorder_grouped_heads", {"axis": 0, "block": 2, "ratio": 1}, X, X),
    ("add", {"value": -1.0}, X, X - 1), ("mul", {"value": 3}, X, X * 3), ("sub", {"value": 0.5}, X, X - np.float32(0.5)), ("div", {"value": 3}, X, X / np.float32(3)),
]


@pytest.mark.parametrize(("op", "args", "x", "want"), CASES, ids=[f"{c[0]}-{i}" for i, c in enumerate(CASES)])
def test_one_input(spark, op, args, x, want):
    t = registry.apply(op, [frame(spark, np.ascontiguousarray(x))], args)
    assert t.shape == want.shape == registry.infer(op, [x.shape], args)
    assert np.allclose(back(t), want, rtol=1e-6, atol=0)


def test_log_and_division_at_the_edges(spark):
    x = np.array([[0.0, -1.0, 2.0, np.inf]], "float32")
    got = back(registry.apply("log", [frame(spark, x)]))
    assert got[0, 0] == -np.inf and np.isnan(got[0, 1]) and np.isclose(got[0, 2], np.log(2)) and got[0, 3] == np.inf
    q = back(registry.apply("div", [frame(spark, np.array([[0.0, 1.0, -1.0, 6.0]], "float32")), frame(spark, np.array([[0.0, 0.0, 0.0, 4.0]], "float32"))]))
    assert np.isnan(q[0, 0]) and q[0, 1] == np.inf and q[0, 2] == -np.inf and q[0, 3] == 1.5


@pytest.mark.parametrize("other", [X[:1], X[:, :1, :1], X[0], X[0, 0], X])
def test_broadcasting(spark, other):
    other = np.ascontiguousarray(other)
    for op, f in (("add", np.add), ("sub", np.subtract), ("mul", np.multiply), ("div", np.divide)):
        assert np.allclose(back(registry.apply(op, [frame(spark, X), frame(spark, other)])), f(X, other), rtol=1e-6)
    assert np.allclose(back(registry.apply("sub", [frame(spark, other), frame(spark, X)])), other - X, rtol=1e-6)


@pytest.mark.parametrize("axis", [0, 1, 2, -1])
def test_concat_and_inverse(spark, axis):
    y = np.ascontiguousarray(np.flip(X, axis))
    assert np.array_equal(back(registry.apply("concat", [frame(spark, X), frame(spark, y), frame(spark, X)], {"axis": axis})), np.concatenate([X, y, X], axis))
    t = registry.apply("zip_blocks", [frame(spark, X)], {"axis": axis, "block": 1})
    assert np.array_equal(back(registry.apply("unzip_blocks", [t], {"axis": axis, "block": 1})), X)


def test_heads_by_dimension_names(spark):
    x = R.normal(size=(24, 4)).astype("float32")
    dims = {"linear_num_value_heads": 6, "linear_num_key_heads": 3, "linear_value_head_dim": 4}
    assert np.array_equal(back(registry.apply("qwen35_v_head_unpermute", [frame(spark, x)], {}, dims)), reordered(x, 0, 4, 2))
    assert np.array_equal(back(registry.apply("qwen35_v_head_unpermute", [frame(spark, x[:6].copy())], {"block": 1, "k_heads": None}, dims)), x[:6])
    with pytest.raises(PlanError):
        registry.infer("qwen35_v_head_unpermute", [(25, 4)], {}, dims)


@pytest.mark.parametrize(("op", "shapes", "args"), [
    ("cast", [(2, 2)], {"dtype": "bfloat16"}), ("reshape", [(2, 3)], {"shape": [4]}), ("reshape", [(2, 3)], {"shape": [-1, -1]}), ("squeeze", [(2, 3)], {"axis": 0}), ("permute", [(2, 3)], {}), ("permute", [(2, 3)], {"axes": [0, 0]}),
    ("slice", [(2, 3)], {"axis": 0, "step": 0}), ("slice", [(2, 3)], {"axis": 2}), ("concat", [(2, 3)], {"axis": 0}), ("concat", [(2, 3), (2, 4)], {"axis": 0}), ("concat", [(2, 3), (2, 3)], {}), ("zip_blocks", [(3, 2)], {"axis": 0, "block": 1}),
    ("add", [(2, 3)], {}), ("add", [(2, 3), (2, 4)], {}), ("reorder_grouped_heads", [(6, 2)], {"axis": 0, "block": 2, "ratio": 2}), ("nothing", [(1,)], {}),
])
def test_what_cannot_work_fails_at_plan_time(op, shapes, args):
    with pytest.raises(PlanError):
        registry.infer(op, shapes, args)


def test_half_floats(spark):
    x = np.concatenate([R.normal(size=500) * 10.0 ** R.integers(-9, 6, 500), [0.0, 65504.0, 65519.9, 65520.0, -1e9, 6e-8, 2.9e-8, np.inf]])
    got = spark.createDataFrame([(float(v),) for v in x], "v double").select(f16(F.col("v")).alias("h"), bf16(F.col("v")).alias("b")).collect()
    with np.errstate(over="ignore"):
        assert [r.h for r in got] == x.astype("float16").astype("float64").tolist()
    bits = x.astype("float32").view("uint32").astype("uint64")
    near = ((bits + 0x7FFF + (bits >> 16 & 1)) >> 16 << 16).astype("uint32").view("float32")
    assert np.array_equal(np.array([r.b for r in got])[np.abs(x) < 1e5], near.astype("float64")[np.abs(x) < 1e5])


@pytest.mark.parametrize(("bits", "group"), [(2, 32), (3, 64), (4, 32), (6, 64), (8, 128)])
def test_quantization_laws(spark, bits, group):
    x = (R.normal(size=(8, 128)) * 0.05).astype("float32")
    t = frame(spark, x)
    q = quant.quantize(t, bits, group)
    step = (x.reshape(8, -1, group).max(2) - x.reshape(8, -1, group).min(2)).max() / (2**bits - 1)
    whole = back(quant.as_tensor(quant.dequantize(q), x.shape))
    assert np.abs(whole - x).max() <= step
    assert back(quant.as_tensor(quant.dequantize(quant.unpack(quant.pack(q, bits, group), bits, group).join(q.drop("codes"), ["row", "grp"])), x.shape)).tolist() == whole.tolist()
    words = {(r.row, r.grp): r.words for r in quant.pack(q, bits, group).collect()}
    for r in q.collect():
        big = sum(c << bits * i for i, c in enumerate(r.codes))
        assert words[r.row, r.grp] == [big >> 32 * k & 0xFFFFFFFF for k in range(group * bits // 32)]
    flat = quant.quantize(frame(spark, np.full((1, 128), 0.5, "float32")), bits, group).first()
    assert set(flat.codes) == {0} and flat.bias == 0.5
    for bad in ((5, 32), (4, 48)):
        with pytest.raises(PlanError):
            quant.check((2, 128), *bad)
    for shape in ((128,), (2, 100)):
        with pytest.raises(PlanError):
            quant.check(shape, bits, group)
