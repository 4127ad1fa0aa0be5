"""Conversion plans: rules meet the catalogue of tensors in Spark, shapes are checked on the driver.

The first rule that matches a tensor's whole name takes it.  That is one ``CASE WHEN`` chain over the
name, so no join and no shuffle, however many tensors a catalogue has.  What must hold between the two
sides (nothing unmatched, no rule unused, no two sources for a destination, every layer covered) are
anti-joins and counts.  The plan itself has a row per tensor of one model and is checked on the driver
before any tensor data is read.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from math import prod
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config, Cut, Rule, Step
from ..errors import PlanError
from ..operators import registry
from .resolve import Resolver, java_pattern, with_dims

Shape = tuple[int, ...]


def first_match(names: DataFrame, patterns: Sequence[Sequence[str]], column: str = "name", whole: bool = True) -> DataFrame:
    """Append ``rule_idx``: the first group of (Python) patterns of which one matches, null if none does."""
    chain = None
    for i, group in enumerate(patterns):
        if not group:
            continue
        hit = _any([F.col(column).rlike(java_pattern(p) if whole else java_pattern(p)[4:-2]) for p in group])
        chain = F.when(hit, i) if chain is None else chain.when(hit, i)
    return names.withColumn("rule_idx", F.lit(None).cast("int") if chain is None else chain.cast("int"))


def _any(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def all_matches(names: DataFrame, rules: DataFrame, column: str = "name") -> DataFrame:
    """Every (name, rule_idx) that fits; ``rules`` (rule_idx, pattern in Java's notation) is as small as a configuration."""
    return names.join(F.broadcast(rules.select("rule_idx", "pattern")), F.rlike(column, "pattern"))


def captured(column: Column, pattern: str) -> dict[str, Column]:
    """What the named groups of a pattern take from a name."""
    java = java_pattern(pattern)
    return {n: F.regexp_extract(column, java, i) for n, i in re.compile(pattern).groupindex.items()}


def destination(rule: Rule, pattern: str, dims: Mapping[str, Any], column: Column) -> Column:
    """The dest template filled in: groups of the match come before dimensions."""
    groups, parts = captured(column, pattern), []
    for text, name in re.findall(r"([^{}]*)(?:\{(\w+)\})?", rule.dest or ""):
        parts.append(F.lit(text))
        if name:
            if name not in groups and name not in dims:
                raise PlanError(f"rule {rule.title!r}: {{{name}}} in dest is neither a group nor a dimension")
            parts.append(groups[name] if name in groups else F.lit(str(dims[name])))
    return F.concat(*parts)


def unmatched(matched: DataFrame) -> DataFrame:
    return matched.where("rule_idx is null").select("name")


def unused(matched: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules (rule_idx, rule, is_drop, optional) that had to match and didn't."""
    return rules.where("not is_drop and not optional").join(matched.select("rule_idx").distinct(), "rule_idx", "left_anti")


def conflicts(jobs: DataFrame) -> DataFrame:
    """Destinations that more than one tensor would become."""
    return jobs.groupBy("dest").agg(F.count("*").alias("n")).where("n > 1")


def layer_templates(spark: SparkSession, layers: int, templates: DataFrame) -> DataFrame:
    """(layer, ..., key): every template of ``key`` filled in for every layer; a configuration has a few."""
    return spark.range(layers).withColumnRenamed("id", "layer").crossJoin(F.broadcast(templates)).withColumn("key", F.replace("key", F.lit("{layer}"), F.col("layer").cast("string")))


def missing_required(wanted: DataFrame, dests: DataFrame) -> DataFrame:
    """(layer, key) of ``wanted`` that no destination gives."""
    return wanted.join(dests.select(F.col("dest").alias("key")), "key", "left_anti").select("layer", "key")


def missing_alternatives(wanted: DataFrame, dests: DataFrame) -> DataFrame:
    """(layer, grp) of which no key is a destination."""
    found = wanted.join(dests.select(F.col("dest").alias("key")).distinct().withColumn("hit", F.lit(1)), "key", "left")
    return found.groupBy("layer", "grp").agg(F.max("hit").alias("hit")).where("hit is null").select("layer", "grp")


@dataclass(frozen=True)
class Slot:
    name: str
    cut: Cut | None
    shape: Shape


@dataclass(frozen=True)
class Job:
    """One output tensor."""

    dest: str
    rule_idx: int
    rule: Rule
    source: str
    qtype: str
    source_shape: Shape
    n_bytes: int
    slots: tuple[Slot, ...]
    steps: tuple[Step, ...]
    out_shape: Shape
    est_bytes: int

    @property
    def quantize(self) -> bool:
        return self.rule.quantize

    @property
    def chunkable(self) -> bool:
        return not any(s.cut for s in self.slots) and all(registry.get_op(s.op).chunk_safe for s in self.steps)

    def setting(self, bits: int, group: int) -> tuple[int, int]:
        return self.rule.bits or bits, self.rule.group_size or group

    def shares(self) -> list[float]:
        """The part of the source that each slot reads."""
        whole = prod(self.source_shape) or 1
        return [min(1.0, max(0.0, prod(s.shape) / whole)) for s in self.slots]


@dataclass(frozen=True)
class Plan:
    config: Config
    resolver: Resolver
    dims: Mapping[str, Any]
    jobs: tuple[Job, ...]
    dropped: tuple[tuple[str, str], ...]
    unmatched: tuple[str, ...]

    @property
    def est_bytes(self) -> int:
        return sum(j.est_bytes for j in self.jobs)

    def frame(self, spark: SparkSession) -> DataFrame:
        """The jobs as a table."""
        rows = [(j.dest, j.rule.title, j.source, j.qtype, j.n_bytes, j.quantize, j.rule.dtype, j.rule.bits, j.rule.group_size, list(j.out_shape), j.est_bytes, k) for k, j in enumerate(self.jobs)]
        return spark.createDataFrame(rows, "dest string, rule string, source string, qtype string, n_bytes bigint, quantize boolean, dtype string, bits int, group_size int, out_shape array<bigint>, est_bytes bigint, job_idx int")

    def keys(self) -> list[str]:
        """Every key the output must have; a quantized tensor has three."""
        return [k for j in self.jobs for k in ([j.dest, *companions(j.dest)] if j.quantize else [j.dest])]

    def summary(self) -> list[str]:
        out = [f"architecture {self.config.id}", "dims " + ", ".join(f"{k}={v}" for k, v in self.dims.items()), f"{len(self.jobs)} jobs"]
        for j in self.jobs:
            ops = " > ".join(s.op for s in j.steps) or "as it is"
            out.append(f"  {j.source} -> {j.dest} {list(j.out_shape)}: {ops}, {'quantized' if j.quantize else j.rule.dtype} ({j.rule.title})")
        out += [f"dropped: {n} ({r})" for n, r in self.dropped] + [f"unmatched: {n}" for n in self.unmatched]
        return [*out, f"about {self.est_bytes / 2**30:.2f} GiB"]


def module_of(dest: str) -> str:
    return dest.removesuffix(".weight")


def companions(dest: str) -> tuple[str, str]:
    return f"{module_of(dest)}.scales", f"{module_of(dest)}.biases"


def patterns_of(config: Config, resolver: Resolver, dims: Mapping[str, Any]) -> list[list[str]]:
    """The patterns of each rule; a block range has one for each index and none if it is empty."""
    out = []
    for rule in config.rules:
        where = f"rule {rule.title!r}"
        base = with_dims(rule.match, dims, where)
        if rule.block_range:
            lo, hi = (resolver.whole(x, f"{where}.range", dims) for x in rule.block_range)
            group = [base.replace("{i}", str(i)) for i in range(lo, hi)]
        else:
            group = [base]
        for p in group:
            try:
                re.compile(p)
            except re.error as e:
                raise PlanError(f"{where}: {e}") from e
        out.append(group)
    return out


def match_tensors(tensors: DataFrame, config: Config, patterns: list[list[str]], dims: Mapping[str, Any]) -> DataFrame:
    """The catalogue with rule_idx and dest (null for dropped and unmatched tensors)."""
    matched, dest = first_match(tensors, patterns), None
    for i, rule in enumerate(config.rules):
        if not rule.drop:
            filled = destination(rule, patterns[i][0], dims, F.col("name"))
            dest = F.when(F.col("rule_idx") == i, filled) if dest is None else dest.when(F.col("rule_idx") == i, filled)
    return matched.withColumn("dest", F.lit(None).cast("string") if dest is None else dest)


def rules_frame(spark: SparkSession, config: Config) -> DataFrame:
    rows = [(i, r.title, r.match, r.dest, r.drop, r.optional, r.quantize, r.dtype, r.bits, r.group_size) for i, r in enumerate(config.rules)]
    return spark.createDataFrame(rows, "rule_idx int, rule string, pattern string, dest string, is_drop boolean, optional boolean, quantize boolean, dtype string, bits int, group_size int")


def slot_of(name: str, cut: Cut | None, shape: Shape, resolver: Resolver, dims: Mapping[str, Any], where: str) -> Slot:
    """A slot with its bounds as numbers and the shape it reads."""
    if cut is None:
        return Slot(name, None, shape)
    if not -len(shape) <= cut.axis < len(shape):
        raise PlanError(f"{where}: no axis {cut.axis} in {shape}")
    axis = cut.axis % len(shape)
    lo = resolver.whole(cut.lo or 0, f"{where}.lo", dims)
    hi = shape[axis] if cut.hi is None else resolver.whole(cut.hi, f"{where}.hi", dims)
    if axis == 0 and not 0 <= lo < hi <= shape[0]:
        raise PlanError(f"{where}: rows {lo} to {hi} of {shape[0]}")
    return Slot(name, Cut(axis, lo, hi), (*shape[:axis], len(range(*slice(lo, hi).indices(shape[axis]))), *shape[axis + 1 :]))


def walk(steps: Sequence[Step], slots: Sequence[Slot], dims: Mapping[str, Any], where: str) -> Shape:
    """The shape that a pipeline ends with; what can't work fails here, before data is read."""
    known: dict[str, Shape] = {s.name: s.shape for s in slots}
    last = None
    for i, step in enumerate(steps):
        at = f"{where}, step {i} ({step.op})"
        try:
            shapes = [known[last if n == "_" and last else n] for n in step.inputs]
        except KeyError as e:
            raise PlanError(f"{at}: nothing is called {e}") from e
        try:
            shape = registry.infer(step.op, shapes, step.args, dims)
        except (KeyError, TypeError, ValueError) as e:
            raise PlanError(f"{at}: {e}") from e
        if not shape or min(shape) <= 0:
            raise PlanError(f"{at}: an empty result, {shape}")
        last = step.output or f"#{i}"
        known[last] = shape
    return known[last] if last else next(iter(known.values()))


def estimate(rule: Rule, n: int) -> int:
    """Bytes of an output; a coarse byte an element where the conversion decides on the bits."""
    if rule.drop:
        return 0
    if not rule.quantize:
        return n * (4 if rule.dtype == "float32" else 2)
    return n if rule.bits is None else n * rule.bits // 8 + 4 * (n // (rule.group_size or 64))


def job_of(row, config: Config, resolver: Resolver, dims: Mapping[str, Any]) -> Job:
    rule, shape = config.rules[row.rule_idx], tuple(row.hf_shape)
    where = f"rule {rule.title!r}, tensor {row.name!r}"
    if rule.expect_shape is not None:
        if len(rule.expect_shape) != len(shape):
            raise PlanError(f"{where}: rank {len(shape)} instead of {len(rule.expect_shape)}")
        want = tuple(n if spec is None else resolver.whole(spec, f"{where}.expect_shape", dims) for spec, n in zip(rule.expect_shape, shape, strict=True))
        if want != shape:
            raise PlanError(f"{where}: shape {shape} instead of {want}")
    slots = tuple(slot_of(n, c, shape, resolver, dims, f"{where}.{n}") for n, c in rule.slots.items())
    steps = tuple(Step(s.op, s.inputs, {k: resolver.value(v, f"{where}.{k}", dims) for k, v in s.args.items()}, s.output) for s in rule.steps)
    if len(slots) > 1 and not steps:
        raise PlanError(f"{where}: several slots need a step that joins them")
    out = walk(steps, slots, dims, where)
    if rule.quantize and len(out) < 2:
        raise PlanError(f"{where}: a quantized result needs two axes, not {out}")
    if rule.quantize and rule.group_size and out[-1] % rule.group_size:
        raise PlanError(f"{where}: rows of {out[-1]} aren't whole groups of {rule.group_size}")
    return Job(row.dest, row.rule_idx, rule, row.name, row.qtype, shape, row.n_bytes, slots, steps, out, estimate(rule, row.n_elements))


def plan(spark: SparkSession, config: Config, tensors: DataFrame, metadata: Mapping[str, Any], reference: Mapping[str, Any] | None = None, arch: str | None = None) -> Plan:
    """Match, check and order the conversion of one model's catalogue (name, hf_shape, qtype, n_elements, n_bytes)."""
    arch = arch or metadata.get("general.architecture")
    if config.strict and not config.accepts(arch):
        raise PlanError(f"configuration {config.id!r} isn't for {arch!r}")
    shapes = {r.name: tuple(r.hf_shape) for r in tensors.select("name", "hf_shape").collect()}
    resolver = Resolver(metadata, shapes, reference or {}, arch)
    dims = resolver.dims(config.dims)
    matched = match_tensors(tensors, config, patterns_of(config, resolver, dims), dims)
    rows = matched.collect()  # one row per tensor of one model, as its header has them
    place = {n: i for i, n in enumerate(shapes)}
    rows.sort(key=lambda r: place[r.name])
    used = {r.rule_idx for r in rows}
    if idle := [r.title for i, r in enumerate(config.rules) if not (r.drop or r.optional or i in used)]:
        raise PlanError(f"rules that had to match and didn't: {idle}")
    left = tuple(sorted(r.name for r in rows if r.rule_idx is None))
    if left and config.unmatched == "error":
        raise PlanError(f"{len(left)} tensors match no rule, such as {left[:5]}")
    kept = [r for r in rows if r.dest is not None]
    seen: dict[str, str] = {}
    for r in kept:
        if r.dest in seen:
            raise PlanError(f"{seen[r.dest]!r} and {r.name!r} would both become {r.dest!r}")
        seen[r.dest] = r.name
    jobs = tuple(job_of(r, config, resolver, dims) for r in kept)
    _cover(spark, config, dims, spark.createDataFrame([(j.dest,) for j in jobs], "dest string"))
    dropped = tuple((r.name, config.rules[r.rule_idx].title) for r in rows if r.rule_idx is not None and r.dest is None)
    return Plan(config, resolver, dims, jobs, dropped, left)


def _cover(spark: SparkSession, config: Config, dims: Mapping[str, Any], dests: DataFrame) -> None:
    if not config.required and not config.alternatives:
        return
    if "n_layers" not in dims:
        raise PlanError("coverage needs the dimension n_layers")
    layers = int(dims["n_layers"])
    if config.required:
        wanted = layer_templates(spark, layers, spark.createDataFrame([(k,) for k in config.required], "key string"))
        if gap := missing_required(wanted, dests).orderBy("layer", "key").first():
            raise PlanError(f"layer {gap.layer} has no {gap.key}")
    if config.alternatives:
        rows = [(g, k) for g, keys in enumerate(config.alternatives) for k in keys]
        wanted = layer_templates(spark, layers, spark.createDataFrame(rows, "grp int, key string"))
        if gap := missing_alternatives(wanted, dests).orderBy("layer", "grp").first():
            raise PlanError(f"layer {gap.layer} has none of {list(config.alternatives[gap.grp])}")
