"""Comparison of models: names, values, configurations and quantization settings of two sides."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.halffloat import bf16, f16

PREFIX = "language_model."


def canonical(name: Column) -> Column:
    return F.regexp_replace(name, rf"^{PREFIX.replace('.', '[.]')}", "")


def module_class(name: Column) -> Column:
    """Layer modules without their number, other names as they are, both without ``.weight``."""
    stem = F.regexp_replace(name, r"[.]weight$", "")
    rest = F.regexp_extract(stem, rf"^(?:{PREFIX.replace('.', '[.]')})?model[.]layers[.][0-9]+[.](.+)$", 1)
    return F.when(rest != "", F.concat(F.lit("layer."), rest)).otherwise(stem)


def expected_class(name: Column) -> Column:
    """Why a tensor may differ: a transformed decay, a norm or other small tensor, or not at all."""
    small = name.rlike(r"(norm[.]weight|norm[.]bias|dt_bias|conv1d[.]weight)$") & (name.contains("linear_attn") | name.contains("norm"))
    return F.when(name.contains("A_log"), "a_log_transform").when(small, "norm_or_small").otherwise("copy")


def resolved(reference: DataFrame, ours: DataFrame, name: str = "name") -> DataFrame:
    """(name, ours): each reference name with our name for it, equal or with the prefix added or removed; null if none."""
    n = F.col(name)
    other = F.when(n.startswith(PREFIX), canonical(n)).otherwise(F.concat(F.lit(PREFIX), n))
    own = ours.select(F.col(name).alias("same")).distinct()
    alt = ours.select(F.col(name).alias("alt")).distinct()
    return reference.select(name, other.alias("other")).join(own, n == F.col("same"), "left").join(alt, F.col("other") == F.col("alt"), "left").select(name, F.coalesce("same", "alt").alias("ours"))


def cells(rows: DataFrame, key: str, out: str) -> DataFrame:
    """(key, row, col, out) of (key, row, values)."""
    return rows.select(key, "row", F.posexplode("values").alias("col", out))


def prepared(pairs: DataFrame, ours: Column, reference: Column) -> DataFrame:
    """Pairs of elements as doubles ``a`` and ``b``, with both on the half-float grid and on that of bfloat16, each computed once."""
    kept = [c for c in pairs.columns if c != "p"]
    return pairs.select(*kept, ours.cast("double").alias("a"), reference.cast("double").alias("b")).select(*kept, "a", "b", f16(F.col("a")).alias("ha"), f16(F.col("b")).alias("hb"), bf16(F.col("a")).alias("ba"), bf16(F.col("b")).alias("bb"))


def stats() -> list[Column]:
    """Aggregates over ``prepared`` pairs of elements: ours ``a``, reference ``b``."""
    a, b, ha, hb, ba, bb = map(F.col, ("a", "b", "ha", "hb", "ba", "bb"))
    d, inf = F.abs(a - b), float("inf")
    finite = lambda c: F.when(F.isnan(c), F.lit(None)).otherwise(c)
    aa, bb_, ab, dd = F.sum(a * a), F.sum(b * b), F.sum(a * b), F.sum(d * d)
    nothing = F.lit(float("nan"))
    return [
        F.count("a").alias("n"), F.max(finite(d)).alias("max_abs"), F.avg(d).alias("mean_abs"),
        F.when(bb_ > 0, F.sqrt(dd / F.nullif(bb_, F.lit(0.0)))).otherwise(nothing).alias("rel_l2"),
        F.when((aa > 0) & (bb_ > 0), ab / F.nullif(F.sqrt(aa) * F.sqrt(bb_), F.lit(0.0))).otherwise(nothing).alias("cosine"),
        F.count_if(F.isnan(a)).alias("nan_ours"), F.count_if(F.isnan(b)).alias("nan_ref"), F.count_if(F.abs(a) == inf).alias("inf_ours"), F.count_if(F.abs(b) == inf).alias("inf_ref"),
        F.bool_and(a.eqNullSafe(b)).alias("bit_exact"), F.bool_and(ba.eqNullSafe(bb)).alias("equal_after_bf16"), F.bool_and(ha.eqNullSafe(hb)).alias("equal_after_f16"),
        F.max(F.abs(ha - hb)).alias("max_abs_after_f16"), F.max(F.abs(ba - bb)).alias("max_abs_after_bf16"), F.count_if((b != 0) & (ha == 0)).alias("flushed_to_zero"),
    ]


def tensor_stats(ours: DataFrame, reference: DataFrame) -> DataFrame:
    """Per key of both (key, row, values): a status and, where all rows pair up, the statistics.

    Rows are joined whole and only then taken apart, so one record a row is shuffled.
    """
    a, b = ours.select("key", "row", F.col("values").alias("x")), reference.select("key", "row", F.col("values").alias("y"))
    odd = F.col("x").isNull() | F.col("y").isNull() | (F.size("x") != F.size("y"))
    rows = a.join(b, ["key", "row"], "full_outer").select("key", F.col("x").isNull().alias("no_x"), F.col("y").isNull().alias("no_y"), odd.alias("odd"), F.explode_outer(F.when(~odd, F.arrays_zip("x", "y"))).alias("p"))
    status = F.when(F.bool_and("no_x"), "reference only").when(F.bool_and("no_y"), "ours only").when(F.bool_or("odd"), "shape_mismatch").otherwise("ok").alias("status")
    got = prepared(rows, F.col("p.x"), F.col("p.y")).groupBy("key").agg(status, *stats())
    values = [F.when(F.col("status") == "ok", F.col(c)).alias(c) for c in got.columns if c not in ("key", "status")]
    return got.select("key", "status", *values)


def summarised(compared: DataFrame) -> DataFrame:
    """One row of counts over ``tensor_stats``."""
    n = lambda c, name: F.count_if(c).alias(name)
    ok = F.col("status") == "ok"
    return compared.agg(F.count("*").alias("tensors"), n(ok, "matched"), n(F.col("status") == "shape_mismatch", "shape_mismatches"), n(F.col("bit_exact"), "bit_exact"), n(F.col("equal_after_bf16"), "equal_after_bf16"), n(F.col("equal_after_f16"), "equal_after_f16"), n(F.col("flushed_to_zero") > 0, "flushed"), n((F.col("nan_ours") > 0) | (F.col("inf_ours") > 0), "not_finite"))


def attribution(ours: DataFrame, reference: DataFrame) -> DataFrame:
    """(cls, tensors, n, sum_sq, rel_l2): squared error by module class, largest first; names are matched without prefix."""
    a = ours.select(canonical(F.col("key")).alias("key"), "row", F.col("values").alias("a"))
    b = reference.select(canonical(F.col("key")).alias("key"), "row", F.col("values").alias("b"))
    pair = a.join(b, ["key", "row"]).where(F.size("a") == F.size("b")).select("key", F.explode(F.arrays_zip("a", "b")).alias("p"))
    d, r = F.col("p.a").cast("double") - F.col("p.b"), F.col("p.b").cast("double")
    of_key = pair.groupBy("key").agg(F.count("*").alias("n"), F.sum(d * d).alias("sq"), F.sum(r * r).alias("ref"))
    return of_key.groupBy(module_class(F.col("key")).alias("cls")).agg(F.count("*").alias("tensors"), F.sum("n").alias("n"), F.sum("sq").alias("sum_sq"), F.sqrt(F.sum("sq") / F.nullif(F.sum("ref"), F.lit(0.0))).alias("rel_l2")).orderBy(F.desc("sum_sq"))


def flattened(config: Mapping[str, Any], prefix: str = "") -> list[tuple[str, str]]:
    """(dotted path, JSON of the value) of every leaf."""
    out = []
    for k, v in config.items():
        path = f"{prefix}.{k}" if prefix else str(k)
        out += flattened(v, path) if isinstance(v, Mapping) else [(path, json.dumps(v, sort_keys=True))]
    return out


def config_frame(spark: SparkSession, config: Mapping[str, Any]) -> DataFrame:
    return spark.createDataFrame(flattened(config), "path string, value string")


def config_diff(ours: DataFrame, reference: DataFrame) -> DataFrame:
    """(path, status, ours, reference) for paths (path, value) that one side lacks or that differ."""
    both = ours.withColumnRenamed("value", "ours").withColumn("x_a", F.lit(True)).join(reference.withColumnRenamed("value", "reference").withColumn("x_b", F.lit(True)), "path", "full_outer")
    status = F.when(F.col("x_b").isNull(), "only_ours").when(F.col("x_a").isNull(), "only_reference").when(~F.col("ours").eqNullSafe(F.col("reference")), "differing")
    return both.select("path", status.alias("status"), "ours", "reference").where("status is not null")


def profile(spark: SparkSession, quantization: Mapping[str, Any], keys: DataFrame) -> DataFrame:
    """(module, cls, bits, group_size, numel) of the modules that a quantization record names; keys as a folder's shards hold them."""
    default = quantization.get("group_size") or 0
    rows = [(k, int(v["bits"]), int(v.get("group_size", default))) for k, v in quantization.items() if isinstance(v, Mapping) and "bits" in v]
    frame = spark.createDataFrame(rows, "module string, bits int, group_size int")
    size = keys.where(F.col("key").endswith(".weight")).select(F.regexp_replace("key", r"[.]weight$", "").alias("module"), F.aggregate("shape", F.lit(1).cast("bigint"), lambda a, x: a * x).alias("numel"))
    return frame.join(size, "module", "left").select("module", module_class(F.col("module")).alias("cls"), "bits", "group_size", F.coalesce("numel", F.lit(1)).alias("numel"))


def class_bits(profiled: DataFrame) -> DataFrame:
    """(cls, histogram map bits -> modules, distinct_bits)."""
    return profiled.groupBy("cls", "bits").agg(F.count("*").alias("n")).groupBy("cls").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("bits", "n")))).alias("histogram"), F.array_sort(F.collect_set("bits")).alias("distinct_bits"))


def unquantized(keys: DataFrame, modules: DataFrame) -> DataFrame:
    """Keys that belong to no quantized module."""
    stem = F.regexp_replace("key", r"[.]weight$", "")
    return keys.where(~F.col("key").endswith(".scales") & ~F.col("key").endswith(".biases")).withColumn("module", stem).join(modules.select("module"), "module", "left_anti").select("key")


def structural_problems(spark: SparkSession, index: DataFrame, present: DataFrame, config: Mapping[str, Any], fields: Sequence[str] = ("model_type", "architectures")) -> DataFrame:
    """(problem): indexed files that aren't there, and fields of the configuration without a value."""
    gone = index.select("shard").distinct().join(present, "shard", "left_anti").select(F.concat(F.lit("missing file "), F.col("shard")).alias("problem"))
    bare = [(f"no {f}",) for f in fields if not config.get(f)]
    return gone.unionByName(spark.createDataFrame(bare, "problem string"))
