"""Verification of a written model: keys, structure and values, each as a query over both sides."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass
from math import prod
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import VerifyError
from ..sources import files, safetensors
from .convert import Model, quantization_record, stacks, transformed, unpacked
from .planner import Plan, companions, module_of

# The least tolerance by bit width, of which a fifth counts.
FLOORS = {2: 0.06, 3: 0.04, 4: 0.02, 6: 0.01, 8: 0.005}
SMALL = 64 << 20
PLAIN_TOLERANCE = 1e-5


def parity(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, side): keys that one side alone has, ``missing`` or ``extra``."""
    a = expected.select(*keys).distinct().withColumn("x_a", F.lit(True))
    b = found.select(*keys).distinct().withColumn("x_b", F.lit(True))
    both = a.join(b, keys, "full_outer")
    return both.where("x_a is null or x_b is null").select(*keys, F.when(F.col("x_b").isNull(), "missing").otherwise("extra").alias("side"))


def index_parity(index: DataFrame, held: DataFrame, present: DataFrame) -> DataFrame:
    """(shard, key, failure) of an index (key, shard), the keys that shards hold, and the files (shard) that are there."""
    gone = index.select("shard").distinct().join(present, "shard", "left_anti").select("shard", F.lit(None).cast("string").alias("key"), F.lit("missing shard").alias("failure"))
    loose = present.join(index.select("shard").distinct(), "shard", "left_anti").select("shard", F.lit(None).cast("string").alias("key"), F.lit("unreferenced shard").alias("failure"))
    known = index.join(present, "shard", "left_semi")
    keys = parity(known, held.join(known.select("shard").distinct(), "shard", "left_semi"), ["shard", "key"])
    return gone.unionByName(loose).unionByName(keys.select("shard", "key", F.when(F.col("side") == "missing", "indexed but not held").otherwise("held but not indexed").alias("failure")))


def sampled(jobs: DataFrame, always: bool = False) -> DataFrame:
    """Append ``numeric``: all jobs, or the first of each rule and the small ones.

    The first of each rule is one small row a rule, of which a configuration has few; job numbers are unique in a rule.
    """
    if always:
        return jobs.withColumn("numeric", F.lit(True))
    first = jobs.groupBy("rule").agg(F.min("job_idx").alias("x_first"))
    return jobs.join(F.broadcast(first), "rule").withColumn("numeric", (F.col("job_idx") == F.col("x_first")) | (F.col("n_bytes") < SMALL)).drop("x_first")


def tolerance(bits, least, most, fixed: float | None = None):
    """Of a tensor: one step of its range, but not less than a fifth of the floor for its bits."""
    if fixed is not None:
        return F.lit(float(fixed))
    floor = F.coalesce(F.element_at(F.create_map(*[x for b, t in FLOORS.items() for x in (F.lit(b), F.lit(t))]), bits), F.lit(0.1))
    return F.when(bits.isNull(), F.lit(PLAIN_TOLERANCE)).otherwise(F.greatest(floor * 0.2, (most - least) / (F.pow(F.lit(2.0), bits) - 1)))


def difference(expected: DataFrame, got: DataFrame) -> DataFrame:
    """(key, rows, unpaired, max_diff, least, most) of two (key, row, values) by an equi-join on (key, row)."""
    a = expected.select("key", "row", F.col("values").alias("a"))
    b = got.select("key", "row", F.col("values").alias("b"))
    diff = F.array_max(F.zip_with("a", "b", lambda x, y: F.when(x.isNull() | y.isNull() | F.isnan(y), F.lit(float("inf"))).otherwise(F.abs(x.cast("double") - y))))
    rows = a.join(b, ["key", "row"], "full_outer").select("key", (F.col("a").isNull() | F.col("b").isNull() | (F.size("a") != F.size("b"))).alias("odd"), diff.alias("d"), F.array_min("a").cast("double").alias("lo"), F.array_max("a").cast("double").alias("hi"))
    return rows.groupBy("key").agg(F.count("*").alias("rows"), F.count_if("odd").alias("unpaired"), F.max("d").alias("max_diff"), F.min("lo").alias("least"), F.max("hi").alias("most"))


def structure(jobs: DataFrame, held: DataFrame) -> DataFrame:
    """(dest, failure) for quantized jobs (dest, out_shape, bits, group_size) against the keys that shards hold."""
    of = lambda name, tail: held.select(F.col("key").alias(f"{name}_key"), F.col("dtype").alias(f"{name}_type"), F.col("shape").alias(f"{name}_shape"))
    stem = F.regexp_replace("dest", r"\.weight$", "")
    j = jobs.where("quantize").withColumn("stem", stem)
    j = j.join(of("w", ""), F.col("dest") == F.col("w_key")).join(of("s", ""), F.concat("stem", F.lit(".scales")) == F.col("s_key"), "left").join(of("b", ""), F.concat("stem", F.lit(".biases")) == F.col("b_key"), "left")
    lead, inner = F.slice("out_shape", F.lit(1), F.size("out_shape") - 1), F.element_at("out_shape", -1)
    grouped = F.concat(lead, F.array((inner / F.col("group_size")).cast("bigint")))
    failure = (
        F.when((F.col("w_type") != "U32") | (F.slice("w_shape", F.lit(1), F.size("w_shape") - 1) != lead), "packed type or leading axes")
        .when(F.element_at("w_shape", -1) != F.floor(inner * F.col("bits") / 32), "packed width")
        .when(F.col("s_type").isNull() | F.col("b_type").isNull() | (F.col("s_type") != "F16") | (F.col("b_type") != "F16"), "type of scales or biases")
        .when((F.col("s_shape") != grouped) | (F.col("b_shape") != grouped), "shape of scales or biases")
    )
    return j.select("dest", failure.alias("failure")).where("failure is not null")


def not_finite(rows: DataFrame) -> DataFrame:
    """Keys of (key, dtype, row, values) with a value that is infinite or no number."""
    return rows.where(F.exists("values", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))).select("key").distinct()


def recorded(folder: str) -> dict[str, Any]:
    """The quantization that a folder records; None-valued or missing settings are an error."""
    path = f"{folder.rstrip('/')}/config.json"
    if (size := files.size_of(path)) is None:
        raise VerifyError(f"{folder} has no config.json")
    config = json.loads(files.read(path, 0, size))
    q = config.get("quantization") or config.get("quantization_config")
    if q and (gone := [k for k in ("bits", "group_size", "mode") if q.get(k) is None]):
        raise VerifyError(f"{path} doesn't record {gone}")
    return dict(q or {})


def settings(plan: Plan, q: Mapping[str, Any], failures: list[str]) -> dict[str, tuple[int, int]]:
    """Bits and group of each quantized module: its own record, else the global one."""
    out = {}
    wanted = quantization_record(plan, int(q["bits"]), int(q["group_size"]))
    for j in plan.jobs:
        if not j.quantize:
            continue
        own = q.get(module := module_of(j.dest))
        if module in wanted and own != wanted[module]:
            failures.append(f"{j.dest}: the rule says {wanted[module]}, the record {own}")
        try:
            out[module] = (int(own["bits"]), int(own["group_size"])) if own is not None else (int(q["bits"]), int(q["group_size"]))
        except (KeyError, TypeError, ValueError):
            failures.append(f"{module}: a record that can't be read, {own!r}")
            out[module] = int(q["bits"]), int(q["group_size"])
    return out


@dataclass(frozen=True)
class Report:
    numeric: int
    shapes: int
    finite: int
    failures: tuple[str, ...]
    details: tuple[str, ...]

    @property
    def ok(self) -> bool:
        return not self.failures


def verify(spark: SparkSession, plan: Plan, model: Model, folder: str, bits: int | None = None, group: int | None = None, mode: str | None = None, tol: float | None = None, sample: bool = False, finite: bool = True) -> Report:
    """All checks of a written folder; only settings that contradict its record raise."""
    failures: list[str] = []
    index, held = safetensors.index_frame(spark, folder), safetensors.keys_frame(spark, folder).cache()
    present = spark.createDataFrame([(s,) for s in safetensors.shards(folder)], "shard string")
    failures += [f"{r.shard}: {r.failure} {r.key or ''}".strip() for r in index_parity(index, held, present).orderBy("shard", "key").collect()]
    q = recorded(folder)
    for name, asked in (("bits", bits), ("group_size", group), ("mode", mode)):
        if asked is not None and asked != q.get(name):
            raise VerifyError(f"{name} {asked} contradicts the recorded {q.get(name)}")
    keys = spark.createDataFrame([(k,) for k in (plan.keys() if q else [j.dest for j in plan.jobs])], "key string")
    failures += [f"{r.key}: {r.side}" for r in parity(keys, index, ["key"]).orderBy("key").collect()]
    of = settings(plan, q, failures) if q else {}
    has = {r.key for r in held.select("key").collect()}
    numeric = {r.dest for r in sampled(plan.frame(spark), not sample).where("numeric").select("dest").collect()} & has
    jobs = spark.createDataFrame([(j.dest, bool(q) and j.quantize, list(j.out_shape), *of.get(module_of(j.dest), (None, None))) for j in plan.jobs], "dest string, quantize boolean, out_shape array<bigint>, bits int, group_size int")
    failures += [f"{r.dest}: {r.failure}" for r in structure(jobs, held).orderBy("dest").collect()]

    read, expected = (lambda keys: safetensors.read(spark, folder, keys)), None
    for group_jobs in stacks(plan).values():
        wanted = [j for j in group_jobs if j.dest in numeric]
        if wanted:
            t = transformed(plan, model, wanted)
            per = prod(wanted[0].out_shape[:-1])
            key = F.element_at(F.array(*[F.lit(j.dest) for j in wanted]), (F.floor(F.col("row") / per) + 1).cast("int"))
            part = t.df.select(key.alias("key"), (F.col("row") % per).cast("bigint").alias("row"), "values")
            expected = part if expected is None else expected.unionByName(part)
    details: list[str] = []
    if expected is not None:
        packed = {module_of(j.dest): of[module_of(j.dest)] for j in plan.jobs if q and j.quantize and j.dest in numeric}
        plain = [j.dest for j in plan.jobs if j.dest in numeric and module_of(j.dest) not in packed]
        got = safetensors.as_numbers(read(plain)).select("key", "row", "values")
        if packed:
            got = got.unionByName(unpacked(read([k for m in packed for k in (f"{m}.weight", m, *companions(m))]), packed))
        judged = difference(expected, got).join(jobs.select(F.col("dest").alias("key"), "bits", "quantize"), "key", "left")
        limit = F.when(F.col("quantize"), tolerance(F.col("bits"), F.col("least"), F.col("most"), tol)).otherwise(F.lit(PLAIN_TOLERANCE if q or tol is not None else 1e-3) if tol is None else F.lit(float(tol)))
        for r in judged.withColumn("tol", limit).orderBy("key").collect():
            if r.unpaired:
                failures.append(f"{r.key}: {r.unpaired} rows differ in shape")
            elif not r.max_diff <= r.tol:
                failures.append(f"{r.key}: differs by {r.max_diff:.6g}, more than {r.tol:g}")
            else:
                details.append(f"{r.key}: within {r.tol:g} ({r.max_diff:.6g})")
    if finite:
        floats = safetensors.as_numbers(read([s.key for s in safetensors.stored(folder) if s.dtype in ("F16", "F32", "F64", "BF16")]))
        failures += [f"{r.key}: values that aren't finite" for r in not_finite(floats).orderBy("key").collect()]
    held.unpersist()
    return Report(len(numeric), len(plan.jobs), len(has) if finite else 0, tuple(failures), tuple(details))
