"""Running a plan: one Spark pipeline per rule, for all tensors that the rule takes.

Tensors of one rule and shape are stacked on a new first axis, so a model of hundreds of tensors is a
few dozen pipelines, each of which runs over all its tensors at once.  Quantization needs no shuffle;
the only exchange is the one that brings a shard's rows together to be written.
"""

from __future__ import annotations

import json
import resource
import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from math import prod
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConversionError, PlanError
from ..operators import quant, registry
from ..operators.tensorframe import TensorFrame
from ..sinks import sharded
from .planner import Job, Plan, companions, module_of
from .resolve import MISSING, Resolver, at_path
from .selection import Decision

MODE = "affine"
#: Gives (name, row, values) of the named tensors.
Model = Callable[[list[str]], DataFrame]
OUT = "key string, dtype string, row bigint, data binary"


def lifted(op: str, args: Mapping[str, Any], batch: int, shape_rank: int) -> dict[str, Any]:
    """An operator's arguments for tensors with one more axis in front."""
    out = dict(args)
    if "axis" in out and out["axis"] is not None and int(out["axis"]) >= 0:
        out["axis"] = int(out["axis"]) + 1
    elif op in ("zip_blocks", "unzip_blocks", "reorder_grouped_heads", "qwen35_v_head_unpermute") and "axis" not in out:
        out["axis"] = 1
    if op == "reshape":
        out["shape"] = [batch, *out["shape"]]
    if op in ("transpose", "permute"):
        axes = out.get("axes") or range(shape_rank - 1, -1, -1)
        out["axes"] = [0, *(int(a) % shape_rank + 1 for a in axes)]
    return out


def run_steps(job: Job, stacked: TensorFrame, dims: Mapping[str, Any]) -> TensorFrame:
    """The job's pipeline on tensors stacked along axis 0."""
    batch, known, last = stacked.shape[0], {}, None
    for s in job.slots:
        known[s.name] = stacked if s.cut is None else registry.apply("slice", [stacked], {"axis": s.cut.axis + 1, "start": s.cut.lo, "stop": s.cut.hi})
    for i, step in enumerate(job.steps):
        inputs = [known[last if n == "_" and last else n] for n in step.inputs]
        rank = len(inputs[0].shape) - 1
        if step.op == "squeeze" and step.args.get("axis") is None:
            done = registry.apply("reshape", inputs, {"shape": [batch, *(registry.infer("squeeze", [inputs[0].shape[1:]], {}))]})
        else:
            done = registry.apply(step.op, inputs, lifted(step.op, step.args, batch, rank), dims)
        last = step.output or f"#{i}"
        known[last] = done
    return known[last] if last else next(iter(known.values()))


def stacks(plan: Plan) -> dict[tuple, list[Job]]:
    """Jobs that can run as one: same rule, same source shape."""
    out: dict[tuple, list[Job]] = {}
    for j in plan.jobs:
        out.setdefault((j.rule_idx, j.source_shape), []).append(j)
    return out


def transformed(plan: Plan, model: Model, jobs: list[Job]) -> TensorFrame:
    """The pipeline's result for jobs of one stack, in their order."""
    names = [j.source for j in jobs]
    rows = prod(jobs[0].source_shape[:-1])
    place = F.element_at(F.create_map(*[x for k, n in enumerate(names) for x in (F.lit(n), F.lit(k).cast("bigint"))]), F.col("name"))
    read = model(names).select((place * rows + F.col("row")).alias("row"), "values")
    return run_steps(jobs[0], TensorFrame(read, (len(names), *jobs[0].source_shape)), plan.dims)


def checked(t: TensorFrame, what: str) -> TensorFrame:
    """The same rows; one that isn't finite stops the conversion."""
    bad = F.exists("values", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    return TensorFrame(t.df.withColumn("values", F.when(bad, F.raise_error(F.lit(f"{what}: values that aren't finite")).cast("array<float>")).otherwise(F.col("values"))), t.shape)


def _bytes(kind: str):
    def run(batches):
        for b in batches:
            lists = b.column("values")
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            flat = flat.astype({"U32": "<u4", "F16": "<f2", "F32": "<f4"}[kind])
            data = [flat[a:z].tobytes() for a, z in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([kind] * b.num_rows), b.column("row"), pa.array(data, pa.binary())], ["key", "dtype", "row", "data"])

    return run


def _written(rows: DataFrame, kind: str) -> DataFrame:
    return rows.select("key", "row", "values").mapInArrow(_bytes(kind), OUT)


def _triples(bits: int):
    """Three rows of each quantized row: packed words, scales and biases; numpy packs the bits."""

    def rows_of(column, kind):
        flat, ends = column.flatten().to_numpy(zero_copy_only=False).astype(kind), column.offsets.to_numpy() - column.offsets[0].as_py()
        return [flat[a:z] for a, z in zip(ends[:-1], ends[1:], strict=True)]

    def run(batches):
        for b in batches:
            words = [np.packbits((c[:, None] >> np.arange(bits) & 1).astype("u1"), bitorder="little").tobytes() for c in rows_of(b.column("codes"), "u1")]
            keys, n = b.column("key").to_pylist(), b.num_rows
            data = words + [x.tobytes() for name in ("scales", "biases") for x in rows_of(b.column(name), "<f2")]
            names = b.column("weight").to_pylist() + [f"{k}.{tail}" for tail in ("scales", "biases") for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(["U32"] * n + ["F16"] * 2 * n), pa.array(b.column("row").to_pylist() * 3, pa.int64()), pa.array(data, pa.binary())], ["key", "dtype", "row", "data"])

    return run


def _keys(names: list[str], per: int) -> tuple:
    """(key, row) columns for rows numbered through a stack."""
    at = (F.floor(F.col("row") / per) + 1).cast("int")
    return F.element_at(F.array(*[F.lit(n) for n in names]), at).alias("key"), (F.col("row") % per).cast("bigint").alias("row")


def outputs(plan: Plan, model: Model, decision: Decision, group: int = 64, check: bool = True) -> tuple[list[sharded.Entry], DataFrame]:
    """What the output holds, in order, and its rows (key, dtype, row, data)."""
    layout: dict[str, list[sharded.Entry]] = {}
    parts: list[DataFrame] = []
    for jobs in stacks(plan).values():
        first = jobs[0]
        t = transformed(plan, model, jobs)
        t = checked(t, first.rule.title) if check else t
        lead, inner = first.out_shape[:-1], first.out_shape[-1]
        per, dests = prod(lead), [j.dest for j in jobs]
        if first.quantize and decision.bits:
            bits, size = first.setting(decision.bits, group)
            q = quant.quantize_rows(t, bits, size)
            key, row = _keys([module_of(d) for d in dests], per)
            weights = F.element_at(F.array(*[F.lit(d) for d in dests]), (F.floor(F.col("row") / per) + 1).cast("int"))
            parts.append(q.select(key, weights.alias("weight"), row, "scales", "biases", "codes").mapInArrow(_triples(bits), OUT))
            for d in dests:
                s, b = companions(d)
                layout[d] = [sharded.Entry(d, "U32", (*lead, inner * bits // 32)), sharded.Entry(s, "F16", (*lead, inner // size)), sharded.Entry(b, "F16", (*lead, inner // size))]
        else:
            kind = "F16" if first.quantize or first.rule.dtype == "float16" else "F32"
            key, row = _keys(dests, per)
            parts.append(_written((quant.half_only(t) if kind == "F16" else t).df.select(key, row, "values"), kind))
            for d in dests:
                layout[d] = [sharded.Entry(d, kind, first.out_shape)]
    if not parts:
        raise ConversionError("the plan writes no tensor")
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return [e for j in plan.jobs for e in layout[j.dest]], rows


def quantization_record(plan: Plan, bits: int, group: int) -> dict[str, Any]:
    """Global settings, and those of each module that differs."""
    own = {module_of(j.dest): s for j in plan.jobs if j.quantize and (s := j.setting(bits, group)) != (bits, group)}
    return {"bits": bits, "group_size": group, "mode": MODE, **{k: {"bits": b, "group_size": g} for k, (b, g) in own.items()}}


def output_config(plan: Plan, resolver: Resolver, decision: Decision, group: int = 64) -> tuple[dict[str, Any], list[str]]:
    """The model's configuration, and what of the reference configuration it overrides."""
    out = plan.config.output
    if not out.model_type:
        raise ConversionError("the configuration has no output.model_type")
    resolve = lambda part, specs: {k: resolver.value(v, f"output.{part}.{k}", plan.dims) for k, v in specs.items()}
    base = {k: v for k, v in resolver.reference.items() if k not in (*out.drop_fields, "architectures", "model_type")}
    found = resolve("text_config", out.text_config)
    overridden = [f"{k}: {base[k]!r} becomes {v!r}" for k, v in found.items() if k in base and base[k] != v]
    text = base | found
    config: dict[str, Any] = {"architectures": list(out.architectures), "model_type": out.model_type, **resolve("top_level", out.top_level)}
    config |= {out.nest_config_under: text} if out.nest_config_under else text
    if decision.bits:
        config["quantization"] = quantization_record(plan, decision.bits, group)
        config["quantization_config"] = dict(config["quantization"])
    if gone := [p for p in out.required_fields if not present(config, p)]:
        raise ConversionError(f"the output's configuration lacks {gone}")
    if decision.bits:
        config["quantization_selection"] = decision.record()
    return config, overridden


def present(config: Mapping[str, Any], path: str) -> bool:
    """Whether a dotted path leads to a value; null is one."""
    return at_path(config, path) is not MISSING


@dataclass(frozen=True)
class Report:
    output_bytes: int
    tensors: int
    shards: int
    decision: Decision
    dims: Mapping[str, Any]
    overridden: tuple[str, ...]
    elapsed_s: float
    peak_rss_gib: float

    def json(self) -> str:
        return json.dumps({"output_bytes": self.output_bytes, "n_tensors": self.tensors, "n_shards": self.shards, "bits": self.decision.record(), "dims": dict(self.dims), "overridden": list(self.overridden), "elapsed_s": round(self.elapsed_s, 2), "peak_rss_gib": round(self.peak_rss_gib, 3)}, indent=2)


def convert(spark: SparkSession, plan: Plan, model: Model, target: str, decision: Decision, group: int = 64, tokenizer: str | None = None, overwrite: bool = False, check: bool = True) -> Report:
    """Write the plan's output to a folder, which appears whole or not at all."""
    most, began = plan.config.output.max_shard_bytes, time.monotonic()
    config, overridden = output_config(plan, plan.resolver, decision, group)
    entries, rows = outputs(plan, model, decision, group, check)
    for j in plan.jobs:
        if j.quantize and decision.bits and j.out_shape[-1] % j.setting(decision.bits, group)[1]:
            raise PlanError(f"{j.dest}: rows of {j.out_shape[-1]} aren't whole groups")
    if tokenizer is not None:
        sharded.check_tokenizer(tokenizer)
    with sharded.staged(target, overwrite) as folder:
        index = sharded.write(rows, entries, folder, most)
        sharded.put(folder, "config.json", json.dumps(config, indent=2).encode())
        if tokenizer is not None:
            sharded.copy_files(tokenizer, folder, plan.config.output.tokenizer_files)
            sharded.check_tokenizer(folder)
    return Report(index["metadata"]["total_size"], len(plan.jobs), len(set(index["weight_map"].values())), decision, plan.dims, tuple(overridden), time.monotonic() - began, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 2**20)


def unpacked(rows: DataFrame, settings: Mapping[str, tuple[int, int]]) -> DataFrame:
    """(key, row, values): dequantized doubles of modules, from rows (key, dtype, row, data) of a folder.

    ``settings``: bits and group by module; scales and biases are found beside each weight, in one exchange.
    """
    stem = F.regexp_replace("key", r"\.(weight|scales|biases)$", "")
    kind = F.when(F.col("key").endswith(".scales"), "s").when(F.col("key").endswith(".biases"), "b").otherwise("w")
    three = rows.withColumn("stem", stem).where(F.col("stem").isin(list(settings)))
    of = lambda k: F.max(F.when(kind == k, F.col("data"))).alias(k)
    joined = three.groupBy("stem", "row").agg(of("w"), of("s"), of("b")).where("w is not null and s is not null and b is not null")

    def run(batches):
        for b in batches:
            out = []
            for stem, w, s, z in zip(*(b.column(c).to_pylist() for c in ("stem", "w", "s", "b")), strict=True):
                bits, size = settings[stem]
                out.append(dequantized(w, s, z, bits, size))
            yield pa.RecordBatch.from_arrays([pa.array([f"{x}.weight" for x in b.column("stem").to_pylist()]), b.column("row"), pa.array(out, pa.list_(pa.float64()))], ["key", "row", "values"])

    return joined.mapInArrow(run, "key string, row bigint, values array<double>")


def dequantized(words: bytes, scales: bytes, biases: bytes, bits: int, group: int) -> np.ndarray:
    """A row's values from its packed words; settings that don't fit give NaN, which no tolerance accepts."""
    bit = np.unpackbits(np.frombuffer(words, "u1"), bitorder="little")
    s, z = np.frombuffer(scales, "<f2").astype("float64"), np.frombuffer(biases, "<f2").astype("float64")
    if len(bit) % bits or len(bit) // bits != len(s) * group:
        return np.full(len(s) * group, np.nan)
    codes = bit.reshape(-1, bits) @ (1 << np.arange(bits))
    return codes * np.repeat(s, group) + np.repeat(z, group)
