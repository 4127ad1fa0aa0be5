"""Tensor, quantization and comparison queries over the embeddings table."""

from __future__ import annotations

from math import gcd

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.halffloat import bf16
from ..operators import quant, registry
from ..operators import tensor as _tensor  # noqa: F401  registers the operators
from ..operators.tensorframe import TensorFrame, cells
from . import calibration, compare, verify
from .catalogue import query

CELLS = "WITH e AS (SELECT vec_id AS r, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS c, label FROM embeddings) "


def embeddings(spark: SparkSession, sf_dir: str, multiple: int = 1) -> TensorFrame:
    """The embeddings as a tensor; its height is counted by the Parquet footers and cut to whole blocks of ``multiple`` rows."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    n = df.count()
    n -= n % multiple
    keep = df if multiple == 1 else df.where(F.col("vec_id") < n)
    return TensorFrame(keep.select(F.col("vec_id").alias("row"), F.col("embedding").alias("values")), (n, 64))


def rounded(t: TensorFrame, digits: int = 6) -> DataFrame:
    long = t.long()
    return long.select("row", "col", F.round("value", digits).alias("value"))


def cells_sql(value: str, where: str = "", row: str = "r", col: str = "c", multiple: int = 1) -> str:
    """Cells of the embeddings; ``n`` is the number of rows that are whole blocks of ``multiple``."""
    if multiple > 1:
        return f"{CELLS}, m AS (SELECT (count(*) - count(*) % {multiple})::BIGINT AS n FROM embeddings) SELECT ({row})::BIGINT AS row, ({col})::BIGINT AS col, ({value})::DOUBLE AS value FROM e, m WHERE r < n"
    return f"{CELLS} SELECT ({row})::BIGINT AS row, ({col})::BIGINT AS col, ({value})::DOUBLE AS value FROM e {where}"


@query("q_tensor_copy_cast", CELLS + "SELECT r AS row, c::BIGINT AS col, v::DOUBLE AS value, CASE WHEN v = 0 THEN 0.0 ELSE round_even(v::DOUBLE / u, 0) * u END AS half FROM (SELECT *, pow(2.0, greatest(floor(log2(abs(v::DOUBLE))), -14) - 10) AS u FROM e)")
def tensor_copy_cast(spark, sf_dir):
    t = registry.apply("copy", [embeddings(spark, sf_dir)])
    half = registry.apply("cast", [t], {"dtype": "float16"})
    both = t.df.join(half.df.withColumnRenamed("values", "halves"), "row")
    return both.select("row", F.posexplode(F.arrays_zip("values", "halves")).alias("col", "x")).select("row", F.col("col").cast("bigint"), F.col("x.values").cast("double").alias("value"), F.col("x.halves").cast("double").alias("half"))


@query("q_tensor_neg_exp", CELLS + "SELECT r AS row, c::BIGINT AS col, round((-v)::DOUBLE, 6) AS neg, round(exp(v::DOUBLE)::FLOAT::DOUBLE, 5) AS exp FROM e")
def tensor_neg_exp(spark, sf_dir):
    t = embeddings(spark, sf_dir)
    both = registry.apply("neg", [t]).df.withColumnRenamed("values", "neg").join(registry.apply("exp", [t]).df.withColumnRenamed("values", "exp"), "row")
    cells = both.select("row", F.posexplode(F.arrays_zip("neg", "exp")).alias("col", "x"))
    return cells.select("row", F.col("col").cast("bigint"), F.round(F.col("x.neg").cast("double"), 6).alias("neg"), F.round(F.col("x.exp").cast("double"), 5).alias("exp"))


def logs(t: TensorFrame) -> DataFrame:
    """(row, col, x, value): every cell and its logarithm to four places, rounded as SQL does: what is below zero may become -0."""
    both = registry.apply("log", [TensorFrame(t.df.withColumn("x", F.col("values")), t.shape)]).df
    v = F.col("c.values").cast("double")
    return both.select("row", F.posexplode(F.arrays_zip("x", "values")).alias("col", "c")).select("row", F.col("col").cast("bigint"), "c.x", F.when(v < 0, -F.round(-v, 4)).otherwise(F.round(v, 4)).alias("value"))


@query("q_tensor_log_guarded", cells_sql("CASE WHEN v > 0 THEN round(ln(v::DOUBLE)::FLOAT::DOUBLE, 4) WHEN v = 0 THEN -1e308 ELSE -1e307 END"))
def tensor_log(spark, sf_dir):
    x, v = F.col("x"), F.col("value")
    return logs(embeddings(spark, sf_dir)).select("row", "col", F.when(F.isnan(x) | (x > 0), v).when(x == 0, -1e308).otherwise(-1e307).alias("value"))


@query("q_tensor_add_scalar", cells_sql("round((v + (-1.0)::FLOAT)::FLOAT::DOUBLE, 6)"))
def tensor_add_scalar(spark, sf_dir):
    return rounded(registry.apply("add", [embeddings(spark, sf_dir)], {"value": -1.0}))


PAIR = "WITH n AS (SELECT count(*) AS n FROM embeddings), a AS (SELECT vec_id AS r, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS c FROM embeddings), b AS (SELECT (vec_id + 1) % n AS r, unnest(embedding) AS y, generate_subscripts(embedding, 1) - 1 AS c FROM embeddings, n) "


@query("q_tensor_binary_pair", PAIR + "SELECT r AS row, c::BIGINT AS col, round((x - y)::FLOAT::DOUBLE, 6) AS sub, round((x * y)::FLOAT::DOUBLE, 6) AS mul, round(CASE WHEN y = 0 THEN 0 ELSE (x::DOUBLE / y::DOUBLE)::FLOAT END::DOUBLE, 1) AS div FROM a JOIN b USING (r, c)")
def tensor_binary_pair(spark, sf_dir):
    a = embeddings(spark, sf_dir)
    b = TensorFrame(a.df.select(((F.col("row") + 1) % a.shape[0]).alias("row"), "values"), a.shape)
    sub, mul, div = (registry.apply(op, [a, b]).df.withColumnRenamed("values", op) for op in ("sub", "mul", "div"))
    rows = sub.join(mul, "row").join(div, "row").select("row", F.posexplode(F.arrays_zip("sub", "mul", "div")).alias("col", "x"))
    out = rows.select("row", F.col("col").cast("bigint"), *[F.col(f"x.{c}").cast("double").alias(c) for c in ("sub", "mul", "div")])
    return out.select("row", "col", F.round("sub", 6).alias("sub"), F.round("mul", 6).alias("mul"), F.when(F.abs("div") == float("inf"), 0.0).otherwise(F.round(F.nanvl("div", F.lit(0.0)), 1)).alias("div"))


def reflowed(t: TensorFrame, width: int) -> DataFrame:
    """Cells of the tensor in rows of ``width``, the last of which may be short: blocks of rows that fill whole ones are reshaped, the few after them are placed cell by cell."""
    whole = t.shape[0] - t.shape[0] % (width // gcd(width, t.inner))
    head = TensorFrame(t.df.where(F.col("row") < whole), (whole, t.inner))
    long = registry.apply("reshape", [head], {"shape": [-1, width]}).long()
    if whole == t.shape[0]:
        return long
    lin = F.col("lin")
    rest = cells(TensorFrame(t.df.where(F.col("row") >= whole), t.shape))
    return long.unionByName(rest.select(F.floor(lin / width).cast("bigint").alias("row"), (lin % width).alias("col"), F.col("value").cast("double")))


@query("q_tensor_reshape", cells_sql("v", row="r // 2", col="(r % 2) * 64 + c"))
def tensor_reshape(spark, sf_dir):
    return reflowed(embeddings(spark, sf_dir), 128)


@query("q_tensor_reshape_uneven", cells_sql("v", row="(r * 64 + c) // 80", col="(r * 64 + c) % 80"))
def tensor_reshape_uneven(spark, sf_dir):
    return reflowed(embeddings(spark, sf_dir), 80)


@query("q_tensor_squeeze_shape", cells_sql("v"))
def tensor_squeeze(spark, sf_dir):
    t = registry.apply("unsqueeze", [embeddings(spark, sf_dir)], {"axis": 1})
    return registry.apply("squeeze", [t], {"axis": 1}).long()


@query("q_tensor_transpose", cells_sql("v", row="c", col="r"))
def tensor_transpose(spark, sf_dir):
    return registry.apply("transpose", [embeddings(spark, sf_dir)]).long()


@query("q_tensor_permute_rotary", cells_sql("v", multiple=16, row="(r // 16) * 16 + (r % 2) * 8 + (r % 16) // 2"))
def tensor_permute_rotary(spark, sf_dir):
    t = embeddings(spark, sf_dir, 16)
    n = t.shape[0]
    t = registry.apply("reshape", [t], {"shape": [n // 16, 8, 2, 64]})
    t = registry.apply("permute", [t], {"axes": [0, 2, 1, 3]})
    return registry.apply("reshape", [t], {"shape": [n, 64]}).long()


@query("q_tensor_slice_rows", cells_sql("v", where="WHERE r >= 10 AND r < 400 AND (r - 10) % 3 = 0", row="(r - 10) // 3"))
def tensor_slice_rows(spark, sf_dir):
    return registry.apply("slice", [embeddings(spark, sf_dir)], {"axis": 0, "start": 10, "stop": 400, "step": 3}).long()


@query("q_tensor_slice_cols_step", cells_sql("v", where="WHERE c >= 3 AND (c - 3) % 5 = 0", col="(c - 3) // 5"))
def tensor_slice_cols(spark, sf_dir):
    return registry.apply("slice", [embeddings(spark, sf_dir)], {"axis": -1, "start": 3, "step": 5}).long()


@query("q_tensor_concat_axis0", CELLS + ", n AS (SELECT count(*) AS n FROM embeddings) SELECT r AS row, c::BIGINT AS col, v::DOUBLE AS value FROM e UNION ALL SELECT r + n, c::BIGINT, (-v)::DOUBLE FROM e, n")
def tensor_concat_rows(spark, sf_dir):
    t = embeddings(spark, sf_dir)
    return registry.apply("concat", [t, registry.apply("neg", [t])], {"axis": 0}).long()


@query("q_tensor_concat_axis1", CELLS + "SELECT r AS row, c::BIGINT AS col, v::DOUBLE AS value FROM e UNION ALL SELECT r, 64 + c::BIGINT, (-v)::DOUBLE FROM e")
def tensor_concat_cols(spark, sf_dir):
    t = embeddings(spark, sf_dir)
    return registry.apply("concat", [t, registry.apply("neg", [t])], {"axis": 1}).long()


@query("q_tensor_zip_blocks", cells_sql("v", col="CASE WHEN (c // 4) % 2 = 0 THEN (c // 8) * 4 ELSE 32 + (c // 8) * 4 END + c % 4"))
def tensor_zip(spark, sf_dir):
    return registry.apply("zip_blocks", [embeddings(spark, sf_dir)], {"axis": 1, "block": 4}).long()


@query("q_tensor_unzip_blocks", cells_sql("v", multiple=16, row="CASE WHEN r // 2 < n // 4 THEN (r // 2) * 2 ELSE (r // 2 - n // 4) * 2 + 1 END * 2 + r % 2"))
def tensor_unzip(spark, sf_dir):
    return registry.apply("unzip_blocks", [embeddings(spark, sf_dir, 16)], {"axis": 0, "block": 2}).long()


@query("q_tensor_reorder_heads", cells_sql("v", multiple=16, row="(((r // 2) % (n // 8)) * 4 + (r // 2) // (n // 8)) * 2 + r % 2"))
def tensor_reorder(spark, sf_dir):
    return registry.apply("reorder_grouped_heads", [embeddings(spark, sf_dir, 16)], {"axis": 0, "block": 2, "ratio": 4}).long()


@query("q_tensor_v_heads", cells_sql("v", multiple=16, row="(((r // 2) % (n // 8)) * 4 + (r // 2) // (n // 8)) * 2 + r % 2"))
def tensor_v_heads(spark, sf_dir):
    t = embeddings(spark, sf_dir, 16)
    return registry.apply("qwen35_v_head_unpermute", [t], {"heads": "n_heads", "k_heads": t.shape[0] // 8, "block": 2}, {"n_heads": t.shape[0] // 2}).long()


@query("q_tensor_decay_parameter", cells_sql("CASE WHEN -v > 0 THEN round(ln((-v)::DOUBLE)::FLOAT::DOUBLE, 4) ELSE 0 END", multiple=16, row="(((r // 2) % (n // 4)) * 2 + (r // 2) // (n // 4)) * 2 + r % 2"))
def tensor_decay(spark, sf_dir):
    t = embeddings(spark, sf_dir, 16)
    for op, args in (("reorder_grouped_heads", {"axis": 0, "block": 2, "ratio": 2}), ("neg", {})):
        t = registry.apply(op, [t], args)
    x = F.col("x")
    return logs(t).select("row", "col", F.when(F.isnan(x) | (x > 0), F.col("value")).otherwise(0.0).alias("value"))


@query("q_tensor_bf16", cells_sql("CASE WHEN v = 0 THEN 0.0 ELSE round_even(v::DOUBLE / pow(2.0, floor(log2(abs(v::DOUBLE))) - 7), 0) * pow(2.0, floor(log2(abs(v::DOUBLE))) - 7) END"))
def tensor_bf16(spark, sf_dir):
    return embeddings(spark, sf_dir).long().select("row", "col", bf16(F.col("value")).alias("value"))


def quant_sql(bits: int, group: int) -> str:
    top = 2**bits - 1
    return f"""{CELLS}, g AS (SELECT r, c // {group} AS g, min(v)::DOUBLE AS lo, (max(v)::DOUBLE - min(v)::DOUBLE) / {top}.0 AS s FROM e GROUP BY ALL),
q AS (SELECT e.r, e.c, e.label, e.c // {group} AS g, v::DOUBLE AS v, lo, s, CASE WHEN s = 0 THEN 0 ELSE least(greatest(round_even((v::DOUBLE - lo) / s, 0), 0), {top}) END AS code FROM e JOIN g ON e.r = g.r AND e.c // {group} = g.g) """


def _affine(bits, group):
    sql = quant_sql(bits, group) + "SELECT r AS row, c::BIGINT AS col, code::BIGINT AS code, round(s, 6) AS scale, round(lo, 6) AS bias FROM q"

    @query(f"q_quant_affine_{bits}bit", sql)
    def run(spark, sf_dir):
        q = quant.quantize(embeddings(spark, sf_dir), bits, group, half=False)
        long = q.select("row", "grp", "scale", "bias", F.posexplode("codes").alias("i", "code"))
        return long.select("row", (F.col("grp") * group + F.col("i")).cast("bigint").alias("col"), F.col("code").cast("bigint"), F.round("scale", 6).alias("scale"), F.round("bias", 6).alias("bias"))


for _b, _g in ((2, 32), (3, 64), (4, 32), (6, 64), (8, 32)):
    _affine(_b, _g)


def labelled(spark, sf_dir, bits=4, group=32) -> tuple[DataFrame, DataFrame]:
    """(key, row, values) of the embeddings after quantization and back, and of the embeddings: a module a label."""
    t = embeddings(spark, sf_dir)
    key = F.concat(F.lit("model.layers."), "label", F.lit(".class."), "label", F.lit(".weight")).alias("key")
    reference = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(key, F.col("vec_id").alias("row"), F.col("embedding").alias("values"))
    # Values stay doubles, so that errors and equality are those of the formula.
    ours = quant.dequantize_rows(quant.quantize_rows(t, bits, group, half=False), group)
    return ours.join(reference.select("key", "row"), "row").select("key", "row", "values"), reference


@query("q_quant_dequantize", quant_sql(4, 32) + "SELECT r AS row, c::BIGINT AS col, round((code * s + lo)::FLOAT::DOUBLE, 5) AS value FROM q")
def quant_dequantize(spark, sf_dir):
    t = embeddings(spark, sf_dir)
    return rounded(quant.as_tensor(quant.dequantize(quant.quantize(t, 4, 32, half=False)), t.shape), 5)


def half_sql(x: str) -> str:
    return f"CASE WHEN {x} = 0 THEN 0.0 ELSE round_even({x} / pow(2.0, greatest(floor(log2(abs({x}))), -14) - 10), 0) * pow(2.0, greatest(floor(log2(abs({x}))), -14) - 10) END"


def half_quant_sql(bits: int, group: int) -> str:
    """Codes, scales and biases as a conversion writes them: everything on the half-float grid."""
    top = 2**bits - 1
    return f"""{CELLS}, h AS (SELECT r, c, c // {group} AS g, {half_sql("v::DOUBLE")} AS v FROM e), g AS (SELECT r, g, min(v) AS lo, (max(v) - min(v)) / {top}.0 AS s FROM h GROUP BY ALL),
q AS (SELECT r, c, g, CASE WHEN s = 0 THEN 0 ELSE least(greatest(round_even((v - lo) / s, 0), 0), {top}) END AS code, {half_sql("s")} AS s, {half_sql("lo")} AS lo FROM h JOIN g USING (r, g)) """


@query("q_quant_half_grid", half_quant_sql(4, 64) + "SELECT r AS row, c::BIGINT AS col, code::BIGINT AS code, s AS scale, lo AS bias FROM q")
def quant_half_grid(spark, sf_dir):
    """The path that a conversion takes: whole rows, half-float inputs, scales and biases."""
    q = quant.quantize_rows(embeddings(spark, sf_dir), 4, 64)
    cells = q.select("row", "scales", "biases", F.posexplode("codes").alias("col", "code"))
    at = F.floor(F.col("col") / 64).cast("int")
    return cells.select("row", F.col("col").cast("bigint"), F.col("code").cast("bigint"), F.get("scales", at).cast("double").alias("scale"), F.get("biases", at).cast("double").alias("bias"))


@query("q_quant_half_only", cells_sql(half_sql("v::DOUBLE")))
def quant_half_only(spark, sf_dir):
    return quant.half_only(embeddings(spark, sf_dir)).long()


@query("q_quant_rule_settings", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 8 ELSE 4 END::INTEGER AS bits, CASE WHEN p_size % 5 = 0 THEN 32 ELSE 64 END::INTEGER AS group_size FROM part")
def quant_settings(spark, sf_dir):
    own = lambda k, v: F.when(F.col("p_size") % k == 0, F.lit(v))
    bits, group = quant.settings(4, 64, own(3, 8), own(5, 32))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", bits.alias("bits"), group.alias("group_size"))


STATS_SQL = "count(*) AS n, round(max(abs(code * s + lo - v)), 6) AS max_abs, round(avg(abs(code * s + lo - v)), 6) AS mean_abs, round(sqrt(sum(pow(code * s + lo - v, 2)) / sum(v * v)), 6) AS rel_l2"


@query("q_quant_roundtrip_error", quant_sql(4, 32) + f"SELECT label, {STATS_SQL} FROM q GROUP BY label")
def quant_roundtrip(spark, sf_dir):
    got = compare.tensor_stats(*labelled(spark, sf_dir))
    six = lambda c: F.round(c, 6).alias(c)
    return got.select(F.regexp_extract("key", "class[.]([0-9]+)", 1).cast("bigint").alias("label"), "n", six("max_abs"), six("mean_abs"), six("rel_l2"))


@query("q_quant_pack_words", quant_sql(4, 32) + "SELECT r AS row, g::BIGINT AS grp, ((c % 32) // 8)::BIGINT AS word, sum(code::BIGINT * (1::BIGINT << (4 * (c % 8))::INTEGER))::BIGINT AS packed FROM q GROUP BY ALL")
def quant_pack(spark, sf_dir):
    p = quant.pack(quant.quantize(embeddings(spark, sf_dir), 4, 32, half=False), 4, 32)
    return p.select("row", F.col("grp").cast("bigint"), F.posexplode("words").alias("word", "packed")).withColumn("word", F.col("word").cast("bigint"))


@query("q_quant_pack_words_6bit", quant_sql(6, 64) + ", b AS (SELECT r, ((c % 64) * 6 + k) // 32 AS word, ((c % 64) * 6 + k) % 32 AS bit, (code::BIGINT >> k::INTEGER) & 1 AS one FROM q, range(6) t(k)) SELECT r AS row, 0::BIGINT AS grp, word::BIGINT AS word, sum(one * (1::BIGINT << bit::INTEGER))::BIGINT AS packed FROM b GROUP BY ALL")
def quant_pack_6(spark, sf_dir):
    p = quant.pack(quant.quantize(embeddings(spark, sf_dir), 6, 64, half=False), 6, 64)
    return p.select("row", F.col("grp").cast("bigint"), F.posexplode("words").alias("word", "packed")).withColumn("word", F.col("word").cast("bigint"))


@query("q_quant_chunk_law", quant_sql(4, 32) + "SELECT r AS row, g::BIGINT AS grp, sum(code)::BIGINT AS codes, round(any_value(s), 6) AS scale FROM q GROUP BY ALL")
def quant_chunks(spark, sf_dir):
    """Rows quantized in two parts and put together give what all of them at once do: the oracle knows no parts."""
    t = embeddings(spark, sf_dir)
    part = lambda c: quant.quantize(TensorFrame(t.df.where(c), t.shape), 4, 32, half=False)
    parts = part(F.col("row") % 2 == 0).unionByName(part(F.col("row") % 2 == 1))
    return parts.select("row", F.col("grp").cast("bigint"), F.aggregate("codes", F.lit(0), lambda a, c: a + c).cast("bigint").alias("codes"), F.round("scale", 6).alias("scale"))


@query("q_quant_pack_round_trip", quant_sql(6, 32) + "SELECT r AS row, c::BIGINT AS col, code::BIGINT AS code FROM q")
def quant_unpack(spark, sf_dir):
    q = quant.quantize(embeddings(spark, sf_dir), 6, 32, half=False)
    back = quant.unpack(quant.pack(q, 6, 32), 6, 32).select("row", "grp", F.posexplode("codes").alias("i", "code"))
    return back.select("row", (F.col("grp") * 32 + F.col("i")).cast("bigint").alias("col"), F.col("code").cast("bigint"))


@query("q_pair_stats", quant_sql(4, 32) + f"SELECT 'model.layers.' || label || '.class.' || label || '.weight' AS key, 'ok' AS status, {STATS_SQL}, round(sum((code * s + lo) * v) / sqrt(sum(pow(code * s + lo, 2)) * sum(v * v)), 6) AS cosine, 0::BIGINT AS nan_ours, 0::BIGINT AS inf_ref, bool_and(code * s + lo = v) AS bit_exact, bool_and({half_sql('(code * s + lo)')} = {half_sql('v')}) AS equal_after_f16, round(max(abs({half_sql('(code * s + lo)')} - {half_sql('v')})), 6) AS max_abs_after_f16, count(*) FILTER (v <> 0 AND {half_sql('(code * s + lo)')} = 0) AS flushed_to_zero FROM q GROUP BY label")
def pair_stats(spark, sf_dir):
    got = compare.tensor_stats(*labelled(spark, sf_dir))
    six = lambda c: F.round(c, 6).alias(c)
    return got.select("key", "status", "n", six("max_abs"), six("mean_abs"), six("rel_l2"), six("cosine"), "nan_ours", "inf_ref", "bit_exact", "equal_after_f16", six("max_abs_after_f16"), "flushed_to_zero")


#: Modules of some labels are left out on each side, and one label's rows are cut short.
STATUS_SQL = "WITH s AS (SELECT DISTINCT label, CASE WHEN label % 5 = 1 THEN 'ours only' WHEN label % 5 = 2 THEN 'reference only' WHEN label % 5 = 3 THEN 'shape_mismatch' ELSE 'ok' END AS status FROM embeddings) "


def partly(spark, sf_dir) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = t.select(F.concat(F.lit("m."), "label").alias("key"), F.col("vec_id").alias("row"), F.col("embedding").alias("values"), "label")
    ours = rows.where("label % 5 <> 2").drop("label")
    reference = rows.where("label % 5 <> 1").withColumn("values", F.when(F.col("label") % 5 == 3, F.slice("values", 1, 10)).otherwise(F.col("values"))).drop("label")
    return compare.tensor_stats(ours, reference)


@query("q_pair_status", STATUS_SQL + "SELECT 'm.' || label AS key, status, CASE WHEN status = 'ok' THEN true END AS bit_exact FROM s")
def pair_status(spark, sf_dir):
    return partly(spark, sf_dir).select("key", "status", "bit_exact")


@query("q_comparison_summary", STATUS_SQL + "SELECT count(*) AS tensors, count(*) FILTER (status = 'ok') AS matched, count(*) FILTER (status = 'shape_mismatch') AS shape_mismatches, count(*) FILTER (status = 'ok') AS bit_exact, count(*) FILTER (status = 'ok') AS equal_after_f16, 0::BIGINT AS not_finite FROM s")
def comparison_summary(spark, sf_dir):
    return compare.summarised(partly(spark, sf_dir)).select("tensors", "matched", "shape_mismatches", "bit_exact", "equal_after_f16", "not_finite")


@query("q_error_attribution", quant_sql(3, 64) + "SELECT 'layer.class.' || label AS cls, 1::BIGINT AS tensors, count(*) AS n, round(sum(pow(code * s + lo - v, 2)), 4) AS sum_sq, round(sqrt(sum(pow(code * s + lo - v, 2)) / sum(v * v)), 6) AS rel_l2 FROM q GROUP BY ALL")
def error_attribution(spark, sf_dir):
    """Ours has the prefix that the reference lacks."""
    ours, reference = labelled(spark, sf_dir, 3, 64)
    got = compare.attribution(ours.withColumn("key", F.concat(F.lit(compare.PREFIX), "key")), reference)
    return got.select("cls", "tensors", "n", F.round("sum_sq", 4).alias("sum_sq"), F.round("rel_l2", 6).alias("rel_l2"))


@query("q_numeric_difference", quant_sql(4, 32) + """, d AS (SELECT 'model.layers.' || label || '.class.' || label || '.weight' AS key, count(DISTINCT r) AS rows, max(abs(code * s + lo - v)) AS d, min(v) AS lo, max(v) AS hi FROM q GROUP BY ALL)
SELECT key, rows, 0::BIGINT AS unpaired, round(d, 6) AS max_diff, round(lo, 6) AS least, round(hi, 6) AS most, round(greatest(0.02 * 0.2, (hi - lo) / 15), 6) AS tolerance, d <= greatest(0.02 * 0.2, (hi - lo) / 15) AS within FROM d""")
def numeric_difference(spark, sf_dir):
    """The verifier's comparison of recomputed and stored values, with the tolerance of 4 bits."""
    ours, reference = labelled(spark, sf_dir)
    limit = verify.tolerance(F.lit(4), F.col("least"), F.col("most"))
    d = verify.difference(reference, ours).withColumn("limit", limit)
    six = lambda c: F.round(c, 6).alias(c)
    return d.select("key", "rows", "unpaired", six("max_diff"), six("least"), six("most"), F.round("limit", 6).alias("tolerance"), (F.col("max_diff") <= F.col("limit")).alias("within"))


@query("q_finite_check", "SELECT DISTINCT 'm.' || label AS key FROM embeddings WHERE vec_id % 7 = 0 OR vec_id % 11 = 0")
def finite_check(spark, sf_dir):
    """Every seventh row gets an infinite value and every eleventh one that is no number."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    odd = F.when(F.col("vec_id") % 7 == 0, F.lit(float("inf"))).when(F.col("vec_id") % 11 == 0, F.lit(float("nan")))
    values = F.when(odd.isNotNull(), F.concat(F.slice("embedding", 1, 63), F.array(odd.cast("float")))).otherwise(F.col("embedding"))
    return verify.not_finite(e.select(F.concat(F.lit("m."), "label").alias("key"), F.lit("F32").alias("dtype"), F.col("vec_id").alias("row"), values.alias("values")))


LOSS_SQL = """WITH n AS (SELECT count(*) AS n FROM embeddings), p AS (SELECT vec_id AS r, list_transform(embedding, lambda x: x::DOUBLE) AS a FROM embeddings),
lp AS (SELECT r, list_transform(a, lambda x: x - ln(list_sum(list_transform(a, lambda y: exp(y))))) AS l FROM p),
j AS (SELECT p.r, p.l AS lp, q.l AS lq, (p.r % 64)::INTEGER + 1 AS t FROM lp p JOIN lp q ON q.r = (p.r + 1) % (SELECT n FROM n)),
w AS (SELECT (r // 50)::BIGINT AS win, avg(-lp[t]) AS nll_ref, avg(-lq[t]) AS nll, avg(list_sum(list_transform(list_zip(lp, lq), lambda z: exp(z[1]) * (z[1] - z[2])))) AS kl FROM j GROUP BY ALL)
"""


@query("q_nll_kl", LOSS_SQL + "SELECT round(avg(nll_ref), 6) AS nll_ref, round(avg(nll), 6) AS nll, round(avg(nll - nll_ref), 6) AS delta_ce, round(avg(kl), 6) AS kl FROM w")
def nll_kl(spark, sf_dir):
    """Two rows as logits of a reference and a candidate: means over windows of the windows' means."""
    got = calibration.losses(logit_pairs(spark, sf_dir))
    return got.select(*[F.round(c, 6).alias(c) for c in ("nll_ref", "nll", "delta_ce", "kl")])


@query("q_token_losses", LOSS_SQL + "SELECT win, round(nll_ref, 6) AS nll_ref, round(nll, 6) AS nll, round(kl, 6) AS kl FROM w")
def token_losses(spark, sf_dir):
    return calibration.token_losses(logit_pairs(spark, sf_dir)).groupBy("win").agg(*[F.round(F.avg(c), 6).alias(c) for c in ("nll_ref", "nll", "kl")])


def logit_pairs(spark, sf_dir) -> DataFrame:
    t = embeddings(spark, sf_dir)
    after = t.df.select(F.pmod(F.col("row") - 1, F.lit(t.shape[0])).cast("bigint").alias("row"), F.col("values").alias("candidate"))
    return t.df.join(after, "row").select(F.floor(F.col("row") / 50).cast("bigint").alias("win"), F.col("row").alias("pos"), F.col("values").alias("reference"), "candidate", (F.col("row") % 64).alias("target"))
