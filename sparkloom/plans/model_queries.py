"""Queries over a small model file whose tensors are aggregates of the driver tables.

The model's size doesn't depend on the tables': only its values do.  The file, what is converted from it and a
few other files lie below the session's shared folder, or in a folder of this process in a local session.
"""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..errors import LoomError
from ..sinks import gguf as gguf_sink
from ..sinks import sharded
from ..sources import blocks, files, gguf, records, safetensors
from . import compare, convert, planner, selection, verify
from .catalogue import query
from .tensor_queries import half_sql

_made: dict[tuple[str, str], str] = {}


def folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that the driver and the executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = tempfile.mkdtemp(prefix="sparkloom-model-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
    path = f"{root.rstrip('/').removeprefix('file://')}/{name}-{uuid.uuid4().hex}"
    system, at = files.located(path)
    system.create_dir(at)
    return path


def once(name: str):
    """Make what a query needs once for each session and folder of tables."""

    def wrap(f):
        def get(spark, sf_dir):
            key = (spark.sparkContext.applicationId + name, sf_dir)
            if key not in _made:
                _made[key] = f(spark, sf_dir)
            return _made[key]

        return get

    return wrap


COUNTS = {
    "token_embd.weight": ("customer", "c_nationkey", "c_custkey % 64", 25, "Q8_0"),
    "output_norm.weight": ("part", "0", "p_partkey % 64", 1, "F16"),
    **{f"blk.{r}.attn_norm.weight": (f"(SELECT * FROM supplier WHERE s_nationkey % 5 = {r})", "0", "s_suppkey % 64", 1, "F32") for r in range(5)},
    **{f"blk.{r}.attn_q.weight": (f"(SELECT * FROM lineitem WHERE l_orderkey % 5 = {r})", "l_partkey % 32", "l_suppkey % 64", 32, "Q8_0") for r in range(5)},
}
RAW_SQL = " UNION ALL ".join(f"SELECT '{n}' AS name, '{kind}' AS kind, r::BIGINT AS row, c::BIGINT AS col, (coalesce(n, 0) % 50)::DOUBLE AS v FROM (SELECT r, c FROM range({rows}) a(r), range(64) b(c)) LEFT JOIN (SELECT {r} AS r, {c} AS c, count(*) AS n FROM {t} GROUP BY ALL) USING (r, c)" for n, (t, r, c, rows, kind) in COUNTS.items())
#: Values as the file holds them: blocks of 32 share a half-float scale.
STORED_SQL = f"""w AS ({RAW_SQL}), x AS (SELECT *, max(v) OVER (PARTITION BY name, row, col // 32) / 127 AS top FROM w), y AS (SELECT *, {half_sql('top')} AS s FROM x),
t AS (SELECT name, row, col, CASE WHEN kind <> 'Q8_0' THEN v WHEN s = 0 THEN 0 ELSE s * least(round_even(v / s, 0), 127) END AS value FROM y)"""
RAW_CONFIG = {
    "architecture": {"id": "toy", "gguf_arch": ["toy"], "strict_arch": True},
    "dims": {"n_layers": ["gguf:block_count", "ref:num_layers"], "hidden": "gguf:embedding_length", "n_heads": "gguf:head_count", "vocab": ["gguf:nothing", "tshape:token_embd.weight.0"], "q": {"mul": ["n_heads", 8]}, "head_dim": {"div": ["q", "n_heads"]}},
    "rules": [
        {"name": "rope", "match": r"rope_.*", "drop": True},
        {"name": "emb", "match": r"token_embd\.weight", "dest": "model.embed.weight", "expect_shape": ["vocab", "hidden"], "bits": 8, "group_size": 32},
        {"name": "head", "match": r"output\.weight", "dest": "lm_head.weight", "optional": True},
        {"name": "final", "match": r"output_norm\.weight", "dest": "model.norm.weight", "quantize": False, "expect_shape": ["hidden"], "steps": [{"op": "add", "args": {"value": -1.0}}]},
        {"name": "norm", "match": r"blk\.(?P<n>\d+)\.attn_norm\.weight", "dest": "model.layers.{n}.norm.weight", "quantize": False, "expect_shape": [None]},
        {"name": "q", "match": r"blk\.(?P<n>\d+)\.attn_q\.weight", "dest": "model.layers.{n}.q.weight", "expect_shape": ["q", "hidden"], "inputs": {"lo": {"slice": {"axis": 0, "lo": 0, "hi": {"div": ["q", 2]}}}, "hi": {"slice": {"axis": 0, "lo": {"div": ["q", 2]}}}}, "steps": [
            {"op": "concat", "inputs": ["lo", "hi"], "output": "whole", "args": {"axis": 0}},
            {"op": "reshape", "input": "whole", "output": "heads", "args": {"shape": {"list": ["n_heads", {"div": ["head_dim", 2]}, 2, "hidden"]}}},
            {"op": "permute", "input": "heads", "output": "turned", "args": {"axes": {"list": [0, 2, 1, 3]}}},
            {"op": "reshape", "input": "turned", "args": {"shape": {"list": ["q", "hidden"]}}}]},
    ],
    "coverage": {"per_layer_required": ["model.layers.{layer}.norm.weight"], "per_layer_alternatives": [["model.layers.{layer}.q.weight", "model.layers.{layer}.other.weight"]]},
    "output": {"model_type": "toy", "architectures": ["Toy"], "top_level": {"tie_word_embeddings": {"not": ["has:output.weight"]}}, "text_config": {"hidden_size": "hidden", "num_layers": "n_layers", "rope": ["ref:rope", None], "nested": {"a": "q"}}, "reference_config": {"drop_fields": ["gone"]}, "required_fields": ["hidden_size", "rope", "nested.a"], "max_shard_bytes": 4000},
}
#: Output tensors: the norm loses its offset, rows of the heads change places.
OUT_SQL = STORED_SQL + """, o AS (SELECT CASE WHEN name = 'token_embd.weight' THEN 'model.embed.weight' WHEN name = 'output_norm.weight' THEN 'model.norm.weight' WHEN name LIKE '%norm%' THEN 'model.layers.' || split_part(name, '.', 2) || '.norm.weight' ELSE 'model.layers.' || split_part(name, '.', 2) || '.q.weight' END AS key,
CASE WHEN name LIKE '%attn_q%' THEN (row // 8) * 8 + (row % 2) * 4 + (row % 8) // 2 ELSE row END AS row, col, CASE WHEN name = 'output_norm.weight' THEN value - 1 ELSE value END AS v FROM t)"""


@once("model")
def model_file(spark: SparkSession, sf_dir: str) -> str:
    tensors = {"rope_freqs.weight": ("F32", np.arange(8, dtype="float32"))}
    for name, (source, row, col, rows, kind) in COUNTS.items():
        where = source.strip("()").removeprefix("SELECT * FROM ").split(" WHERE ")
        df = spark.read.parquet(f"{sf_dir}/{where[0]}.parquet").where(where[1] if len(where) > 1 else "true")
        x = np.zeros((rows, 64), "float32")
        for r in df.groupBy(F.expr(row).alias("r"), F.expr(col).alias("c")).count().collect():  # at most rows x 64 groups
            x[r.r, r.c] = r["count"] % 50
        tensors[name] = (kind, x if rows > 1 else x[0])
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").count()
    out = folder(spark, "model")
    metadata = {"general.architecture": "toy", "toy.block_count": 5, "toy.embedding_length": 64, "toy.head_count": 4, "customers": customers, "long": list(range(5000)), "some": [1, 2, 3], "flag": True, "eps": 0.5}
    gguf_sink.write(out, "model.gguf", metadata, tensors)
    return f"{out}/model.gguf"


REFERENCE = {"rope": {"a": 1}, "num_layers": 9, "kept": 5, "gone": 1}


@once("plan")
def planned(spark: SparkSession, sf_dir: str):
    model = gguf.open_model(spark, model_file(spark, sf_dir))
    return planner.plan(spark, config.parse(RAW_CONFIG), gguf.catalogue(spark, model.header), model.header.metadata, REFERENCE), model


def converted(bits: int | None):
    @once(f"out{bits}")
    def run(spark: SparkSession, sf_dir: str):
        plan, model = planned(spark, sf_dir)
        out = f"{folder(spark, 'converted')}/out"
        return out, convert.convert(spark, plan, model, out, selection.select(spark, plan, bits), 64)

    return run


floats, four_bits = converted(None), converted(4)


def cells(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(key, "row", F.posexplode("values").alias("col", "value")).select(key, "row", F.col("col").cast("bigint"), F.round(F.col("value").cast("double"), 6).alias("value"))


LAYERS_SQL = "l AS (SELECT r_regionkey AS r FROM region)"


@query("q_model_catalogue", f"WITH {LAYERS_SQL} SELECT 'token_embd.weight' AS name, '25x64' AS shape, 'Q8_0' AS qtype, 1600::BIGINT AS n_elements, (25 * 2 * 34)::BIGINT AS n_bytes UNION ALL SELECT 'output_norm.weight', '64', 'F16', 64, 128 UNION ALL SELECT 'rope_freqs.weight', '8', 'F32', 8, 32 UNION ALL SELECT 'blk.' || r || '.attn_norm.weight', '64', 'F32', 64, 256 FROM l UNION ALL SELECT 'blk.' || r || '.attn_q.weight', '32x64', 'Q8_0', 2048, 32 * 2 * 34 FROM l")
def model_catalogue(spark, sf_dir):
    c = gguf.catalogue(spark, gguf.open_model(spark, model_file(spark, sf_dir)).header)
    return c.select("name", F.array_join(F.col("hf_shape").cast("array<string>"), "x").alias("shape"), "qtype", "n_elements", "n_bytes")


@query("q_model_metadata", "SELECT * FROM (VALUES ('general.architecture', 'str', 'toy'), ('toy.block_count', 'int', '5'), ('toy.embedding_length', 'int', '64'), ('toy.head_count', 'int', '4'), ('long', 'str', '<array of 5000>'), ('some', 'list', '[1, 2, 3]'), ('flag', 'bool', 'True'), ('eps', 'float', '0.5'), ('customers', 'int', (SELECT count(*)::VARCHAR FROM customer))) v(key, kind, value)")
def model_metadata(spark, sf_dir):
    return gguf.metadata_frame(spark, gguf.read_header(model_file(spark, sf_dir)))


@query("q_model_lookup", "SELECT * FROM (VALUES ('block_count', '5'), ('toy.block_count', '5'), ('customers', (SELECT count(*)::VARCHAR FROM customer)), ('nothing', NULL)) v(key, value)")
def model_lookup(spark, sf_dir):
    """Metadata by its own name or below the architecture's."""
    found = planned(spark, sf_dir)[0].resolver
    return spark.createDataFrame([(k, None if (v := found.lookup(k)) is None else str(v)) for k in ("block_count", "toy.block_count", "customers", "nothing")], "key string, value string")


@query("q_model_values", f"WITH {STORED_SQL} SELECT name, row, col, round(value, 6) AS value FROM t UNION ALL SELECT 'rope_freqs.weight', 0, i, i::DOUBLE FROM range(8) r(i)")
def model_values(spark, sf_dir):
    return cells(gguf.open_model(spark, model_file(spark, sf_dir))(), "name")


@query("q_model_matrix", f"WITH {STORED_SQL} SELECT name, row, col, round(value, 6) AS value FROM t WHERE name = 'token_embd.weight'")
def model_matrix(spark, sf_dir):
    return cells(gguf.read_matrix(gguf.open_model(spark, model_file(spark, sf_dir)), "token_embd.weight"), "name")


@query("q_model_row_range", f"WITH {STORED_SQL} SELECT name, row, col, round(value, 6) AS value FROM t WHERE name = 'blk.2.attn_q.weight' AND row BETWEEN 5 AND 18")
def model_row_range(spark, sf_dir):
    return cells(gguf.read_rows(gguf.open_model(spark, model_file(spark, sf_dir)), "blk.2.attn_q.weight", 5, 19), "name")


@query("q_model_vector", f"WITH {STORED_SQL} SELECT name, row, col, round(value, 6) AS value FROM t WHERE name = 'output_norm.weight'")
def model_vector(spark, sf_dir):
    return cells(gguf.read_vector(gguf.open_model(spark, model_file(spark, sf_dir)), "output_norm.weight"), "name")


@query("q_model_dims", "SELECT * FROM (VALUES ('n_layers', (SELECT count(*) FROM region)), ('hidden', 64), ('n_heads', 4), ('vocab', (SELECT count(*) FROM nation)), ('q', 32), ('head_dim', 8)) v(dim, value)")
def model_dims(spark, sf_dir):
    return spark.createDataFrame(list(planned(spark, sf_dir)[0].dims.items()), "dim string, value bigint")


JOBS_SQL = f"""{LAYERS_SQL}, j AS (SELECT 'model.embed.weight' AS dest, 'emb' AS rule, 'token_embd.weight' AS source, true AS quantize, 8 AS bits, '25x64' AS out_shape, (1600 + 4 * 50)::BIGINT AS est_bytes UNION ALL SELECT 'model.norm.weight', 'final', 'output_norm.weight', false, NULL, '64', 256
UNION ALL SELECT 'model.layers.' || r || '.norm.weight', 'norm', 'blk.' || r || '.attn_norm.weight', false, NULL, '64', 256 FROM l UNION ALL SELECT 'model.layers.' || r || '.q.weight', 'q', 'blk.' || r || '.attn_q.weight', true, NULL, '32x64', 2048 FROM l)"""


@query("q_model_plan", f"WITH {JOBS_SQL} SELECT dest, rule, source, quantize, bits::INTEGER AS bits, out_shape, est_bytes FROM j")
def model_plan(spark, sf_dir):
    """Jobs with the shapes that their pipelines end with."""
    frame = planned(spark, sf_dir)[0].frame(spark)
    return frame.select("dest", "rule", "source", "quantize", "bits", F.array_join(F.col("out_shape").cast("array<string>"), "x").alias("out_shape"), "est_bytes")


@query("q_model_plan_totals", f"WITH {JOBS_SQL} SELECT count(*) AS jobs, sum(est_bytes)::BIGINT AS est_bytes, 2 + sum(CASE WHEN quantize THEN 3 ELSE 1 END)::BIGINT - 2 AS keys, 'rope_freqs.weight' AS dropped FROM j")
def model_plan_totals(spark, sf_dir):
    plan = planned(spark, sf_dir)[0]
    return spark.createDataFrame([(len(plan.jobs), plan.est_bytes, len(plan.keys()), plan.dropped[0][0])], "jobs bigint, est_bytes bigint, keys bigint, dropped string")


@query("q_model_slots", f"WITH {LAYERS_SQL} SELECT 'model.layers.' || r || '.q.weight' AS dest, s.slot, s.lo::BIGINT AS lo, s.hi::BIGINT AS hi, '16x64' AS shape, 0.5::DOUBLE AS share FROM l, (VALUES ('lo', 0, 16), ('hi', 16, 32)) s(slot, lo, hi)")
def model_slots(spark, sf_dir):
    """Row ranges that the slots of a rule read, with the share of the tensor that they are."""
    rows = [(j.dest, s.name, int(s.cut.lo), int(s.cut.hi), "x".join(map(str, s.shape)), share) for j in planned(spark, sf_dir)[0].jobs for s, share in zip(j.slots, j.shares(), strict=True) if s.cut]
    return spark.createDataFrame(rows, "dest string, slot string, lo bigint, hi bigint, shape string, share double")


@query("q_model_plan_summary", f"WITH {JOBS_SQL} SELECT '  ' || source || ' -> ' || dest || ' [' || replace(out_shape, 'x', ', ') || ']: ' || CASE rule WHEN 'final' THEN 'add' WHEN 'q' THEN 'concat > reshape > permute > reshape' ELSE 'as it is' END || ', ' || CASE WHEN quantize THEN 'quantized' ELSE 'float32' END || ' (' || rule || ')' AS line FROM j UNION ALL SELECT 'dropped: rope_freqs.weight (rope)' UNION ALL SELECT 'architecture toy' UNION ALL SELECT count(*) || ' jobs' FROM j")
def model_plan_summary(spark, sf_dir):
    lines = planned(spark, sf_dir)[0].summary()
    return spark.createDataFrame([(x,) for x in lines if not x.startswith(("dims", "about"))], "line string")


@query("q_model_float_output", f"WITH {OUT_SQL} SELECT key, CASE WHEN key LIKE '%norm%' THEN 'F32' ELSE 'F16' END AS dtype, row, col, round(CASE WHEN key LIKE '%norm%' THEN v ELSE {half_sql('v')} END, 6) AS value FROM o")
def model_float_output(spark, sf_dir):
    """Without quantization: what the written shards hold, read back."""
    got = safetensors.as_numbers(safetensors.read(spark, floats(spark, sf_dir)[0]))
    return got.select("key", "dtype", "row", F.posexplode("values").alias("col", "value")).select("key", "dtype", "row", F.col("col").cast("bigint"), F.round("value", 6).alias("value"))


def grouped_sql(where: str, bits: int, group: int) -> str:
    top = 2**bits - 1
    return f"""SELECT key, row, col, CASE WHEN st = 0 THEN 0 ELSE least(greatest(round_even((h - lo) / st, 0), 0), {top}) END * {half_sql('st')} + {half_sql('lo')} AS value FROM (SELECT *, (hi - lo) / {top}.0 AS st FROM (SELECT *, min(h) OVER g AS lo, max(h) OVER g AS hi FROM (SELECT *, {half_sql('v')} AS h FROM o WHERE {where}) WINDOW g AS (PARTITION BY key, row, col // {group})))"""


@query("q_model_quantized_output", f"WITH {OUT_SQL}, q AS ({grouped_sql('key LIKE ' + chr(39) + '%q.weight' + chr(39), 4, 64)} UNION ALL {grouped_sql('key LIKE ' + chr(39) + '%embed%' + chr(39), 8, 32)}) SELECT key, row, col, round(value, 6) AS value FROM q")
def model_quantized_output(spark, sf_dir):
    """Words, scales and biases of the written shards, joined by module and made values again; one rule has settings of its own."""
    plan = planned(spark, sf_dir)[0]
    record = {planner.module_of(j.dest): j.setting(4, 64) for j in plan.jobs if j.quantize}
    return cells(convert.unpacked(safetensors.read(spark, four_bits(spark, sf_dir)[0]), record), "key")


KEYS_SQL = f"""{LAYERS_SQL}, k AS (SELECT 'model.embed.weight' AS key, 'U32' AS dtype, '25x16' AS shape, 1600::BIGINT AS n_bytes UNION ALL SELECT 'model.embed.' || x, 'F16', '25x2', 100 FROM (VALUES ('scales'), ('biases')) v(x) UNION ALL SELECT 'model.norm.weight', 'F32', '64', 256
UNION ALL SELECT 'model.layers.' || r || '.norm.weight', 'F32', '64', 256 FROM l UNION ALL SELECT 'model.layers.' || r || '.q.weight', 'U32', '32x8', 1024 FROM l UNION ALL SELECT 'model.layers.' || r || '.q.' || x, 'F16', '32x1', 64 FROM l, (VALUES ('scales'), ('biases')) v(x))"""


@query("q_model_stored_keys", f"WITH {KEYS_SQL} SELECT key, dtype, shape, n_bytes, true AS indexed FROM k")
def model_stored_keys(spark, sf_dir):
    """What the headers of the shards say, beside the index."""
    out = four_bits(spark, sf_dir)[0]
    k = safetensors.keys_frame(spark, out).alias("k").join(safetensors.index_frame(spark, out).alias("i"), "key", "left")
    return k.select("key", "dtype", F.array_join(F.col("shape").cast("array<string>"), "x").alias("shape"), "n_bytes", F.col("i.shard").eqNullSafe(F.col("k.shard")).alias("indexed"))


@query("q_model_report", f"WITH {KEYS_SQL}, {JOBS_SQL.split(',', 1)[1]} SELECT (SELECT sum(n_bytes)::BIGINT FROM k) AS output_bytes, (SELECT count(*) FROM j) AS tensors, 4 AS bits, 'num_layers: 9 becomes 5' AS overridden")
def model_report(spark, sf_dir):
    r = json.loads(four_bits(spark, sf_dir)[1].json())
    return spark.createDataFrame([(r["output_bytes"], r["n_tensors"], r["bits"]["target_bits"], r["overridden"][0])], "output_bytes bigint, tensors bigint, bits int, overridden string")


@query("q_model_config", """SELECT * FROM (VALUES ('architectures', '["Toy"]'), ('model_type', '"toy"'), ('tie_word_embeddings', 'true'), ('hidden_size', '64'), ('num_layers', (SELECT count(*)::VARCHAR FROM region)), ('rope.a', '1'), ('nested.a', '32'), ('kept', '5'), ('quantization.bits', '4'), ('quantization.group_size', '64'), ('quantization.mode', '"affine"'), ('quantization.model.embed.bits', '8'), ('quantization.model.embed.group_size', '32')) v(path, value)""")
def model_config(spark, sf_dir):
    """The written configuration, one row a leaf; what the selection found has a query of its own."""
    path = f"{four_bits(spark, sf_dir)[0]}/config.json"
    c = compare.config_frame(spark, json.loads(files.read(path, 0, files.size_of(path))))
    return c.where(~F.col("path").startswith("quantization_"))


@query("q_model_selection", f"WITH {LAYERS_SQL} SELECT 'auto' AS requested, 8 AS bits, 'Q8_0' AS leader, ((SELECT count(*) FROM l) * 32 * 2 * 34 + 25 * 2 * 34)::BIGINT AS bytes, ((SELECT count(*) FROM l) + 1)::DOUBLE AS tensors")
def model_selection(spark, sf_dir):
    d = selection.select(spark, planned(spark, sf_dir)[0], "auto").record()
    return spark.createDataFrame([(d["requested"], d["target_bits"], d["dominant_source_type"], d["source_quant_histogram_bytes"]["Q8_0"], float(d["source_quant_histogram_counts"]["Q8_0"]))], "requested string, bits int, leader string, bytes bigint, tensors double")


def tampered(spark: SparkSession, sf_dir: str) -> str:
    """The quantized output without the record of the module that differs, and with one key gone from the index."""
    source, bad = four_bits(spark, sf_dir)[0], folder(spark, "tampered")
    for name in files.listing(source):
        data = files.read(f"{source}/{name}", 0, files.size_of(f"{source}/{name}"))
        if name == "config.json":
            c = json.loads(data)
            c["quantization"].pop("model.embed")
            data = json.dumps(c).encode()
        if name == safetensors.INDEX:
            c = json.loads(data)
            c["weight_map"].pop("model.norm.weight")
            data = json.dumps(c).encode()
        sharded.put(bad, name, data)
    return bad


@query("q_model_verify", f"WITH {JOBS_SQL} SELECT 'fine' AS folder, count(*) AS numeric, count(*) AS shapes, 0::BIGINT AS failures, '' AS dests FROM j UNION ALL SELECT 'tampered', (SELECT count(*) FROM j), (SELECT count(*) FROM j), NULL, 'model.embed.weight,model.norm.weight'")
def model_verify(spark, sf_dir):
    """Every check of a written folder: keys, structure, recorded settings, values within tolerance, finite numbers."""
    plan, model = planned(spark, sf_dir)
    good = verify.verify(spark, plan, model, four_bits(spark, sf_dir)[0])
    bad = verify.verify(spark, plan, model, tampered(spark, sf_dir))
    named = ",".join(sorted({j.dest for j in plan.jobs if any(j.dest in f for f in bad.failures)}))
    return spark.createDataFrame([("fine", good.numeric, good.shapes, len(good.failures), ""), ("tampered", bad.numeric, bad.shapes, None, named)], "folder string, numeric bigint, shapes bigint, failures bigint, dests string")


@query("q_model_structure", "SELECT 'model.embed.weight' AS dest, 'packed width' AS failure")
def model_structure(spark, sf_dir):
    """Jobs against the headers of the shards, with the wrong bits for one module."""
    plan = planned(spark, sf_dir)[0]
    rows = [(j.dest, j.quantize, list(j.out_shape), *((6, 32) if j.rule.name == "emb" else j.setting(4, 64))) for j in plan.jobs]
    jobs = spark.createDataFrame(rows, "dest string, quantize boolean, out_shape array<bigint>, bits int, group_size int")
    return verify.structure(jobs, safetensors.keys_frame(spark, four_bits(spark, sf_dir)[0]))


@query("q_model_classes", f"WITH {LAYERS_SQL} SELECT 'layer.q' AS cls, '4:' || count(*) AS histogram, '4' AS bits FROM l UNION ALL SELECT 'model.embed', '8:1', '8'")
def model_classes(spark, sf_dir):
    """Bits of the modules of each class, from the record and the keys of a folder."""
    out = four_bits(spark, sf_dir)[0]
    path = f"{out}/config.json"
    q = json.loads(files.read(path, 0, files.size_of(path)))["quantization"]
    modules = {planner.module_of(j.dest): {"bits": b, "group_size": g} for j in planned(spark, sf_dir)[0].jobs if j.quantize for b, g in [j.setting(q["bits"], q["group_size"])]}
    c = compare.class_bits(compare.profile(spark, q | modules, safetensors.keys_frame(spark, out)))
    return c.select("cls", F.array_join(F.transform(F.map_entries("histogram"), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))), ",").alias("histogram"), F.array_join(F.col("distinct_bits").cast("array<string>"), ",").alias("bits"))


@query("q_model_unquantized", f"WITH {LAYERS_SQL} SELECT 'model.norm.weight' AS key UNION ALL SELECT 'model.layers.' || r || '.norm.weight' FROM l")
def model_unquantized(spark, sf_dir):
    plan = planned(spark, sf_dir)[0]
    modules = spark.createDataFrame([(planner.module_of(j.dest),) for j in plan.jobs if j.quantize], "module string")
    return compare.unquantized(safetensors.keys_frame(spark, four_bits(spark, sf_dir)[0]), modules)


@query("q_model_structural_problems", "SELECT 'missing file ghost.safetensors' AS problem UNION ALL SELECT 'no architectures'")
def model_structural_problems(spark, sf_dir):
    out = four_bits(spark, sf_dir)[0]
    index = safetensors.index_frame(spark, out).unionByName(spark.createDataFrame([("x", "ghost.safetensors")], "key string, shard string"))
    present = spark.createDataFrame([(s,) for s in safetensors.shards(out)], "shard string")
    return compare.structural_problems(spark, index, present, {"model_type": "toy", "architectures": []})


@query("q_model_tensor", f"WITH {OUT_SQL} SELECT row, col, round(v, 6) AS value FROM o WHERE key = 'model.norm.weight'")
def model_tensor(spark, sf_dir):
    """A single tensor; an unknown key is an error."""
    out = floats(spark, sf_dir)[0]
    try:
        safetensors.tensor(spark, out, "nothing")
        raise AssertionError("an unknown key was read")
    except LoomError:
        pass
    return cells(safetensors.as_numbers(safetensors.tensor(spark, out, "model.norm.weight")), "key").drop("key")


@query("q_model_transaction", "SELECT * FROM (VALUES ('kept', 1), ('refused', 1), ('replaced', 1)) v(what, n)")
def model_transaction(spark, sf_dir):
    """A failing write leaves the old folder as it was; a folder with files is replaced only when asked for."""
    target = f"{folder(spark, 'staged')}/t"
    system, at = files.located(target)
    system.create_dir(at)
    sharded.put(target, "old", b"x")
    out = []
    try:
        with sharded.staged(target, True) as part:
            sharded.put(part, "new", b"y")
            raise ValueError
    except ValueError:
        out.append(("kept", len(files.listing(target)) if files.listing(target) == ["old"] else 0))
    try:
        with sharded.staged(target) as part:
            sharded.put(part, "new", b"y")
    except LoomError:
        out.append(("refused", len(files.listing(target))))
    with sharded.staged(target, True) as part:
        sharded.put(part, "new", b"y")
    out.append(("replaced", int(files.listing(target) == ["new"])))
    return spark.createDataFrame(out, "what string, n int")


@query("q_config_paths", "SELECT * FROM (VALUES ('a', true), ('a.b', true), ('a.c', false), ('n', true), ('n.x', false), ('z', false)) v(path, held)")
def config_paths(spark, sf_dir):
    """Required paths of a configuration: null is a value."""
    c = {"a": {"b": 1}, "n": None}
    return spark.createDataFrame([(p, convert.present(c, p)) for p in ("a", "a.b", "a.c", "n", "n.x", "z")], "path string, held boolean")


@query("q_config_discovery", "SELECT * FROM (VALUES ('name', 'one'), ('arch', 'two'), ('several', 'error'), ('nobody', 'error')) v(asked, id)")
def config_discovery(spark, sf_dir):
    """Configurations in folders on the driver: by name, by the only one that accepts an architecture, or not at all."""
    with tempfile.TemporaryDirectory() as d:
        for name, archs in (("one", ["a"]), ("two", ["b"]), ("three", ["c"]), ("four", ["c"])):
            with open(f"{d}/{name}.yaml", "w") as f:
                json.dump(RAW_CONFIG | {"architecture": {"id": name, "gguf_arch": archs}}, f)

        def found(**how):
            try:
                return config.resolve_config([d], **how).id
            except LoomError:
                return "error"

        rows = [("name", found(name="one")), ("arch", found(arch="b")), ("several", found(arch="c")), ("nobody", found(arch="zz"))]
    return spark.createDataFrame(rows, "asked string, id string")


@query("q_tokenizer_contract", "SELECT * FROM (VALUES ('both', true), ('no vocabulary', false), ('empty vocabulary', false), ('bad JSON', false)) v(what, fine)")
def tokenizer_contract(spark, sf_dir):
    rows = []
    for what, held in (("both", {"tokenizer.json": b"{}", "tokenizer_config.json": b"{}"}), ("no vocabulary", {"tokenizer_config.json": b"{}"}), ("empty vocabulary", {"tokenizer.json": b"", "tokenizer_config.json": b"{}"}), ("bad JSON", {"tokenizer.json": b"{", "tokenizer_config.json": b"{}"})):
        at = folder(spark, "tokenizer")
        for name, data in held.items():
            sharded.put(at, name, data)
        try:
            sharded.check_tokenizer(at)
            rows.append((what, True))
        except LoomError:
            rows.append((what, False))
    return spark.createDataFrame(rows, "what string, fine boolean")


@query("q_assets", "SELECT 'd/' || n_nationkey || '.txt' AS path, length(n_name)::BIGINT AS size, sha256(n_name) AS sha256 FROM nation")
def assets(spark, sf_dir):
    """A file for each nation, listed and hashed; a hidden one is passed over."""
    root = folder(spark, "assets")
    system, at = files.located(f"{root}/d")
    system.create_dir(at)
    for r in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name").collect():  # twenty-five
        sharded.put(f"{root}/d", f"{r.n_nationkey}.txt", r.n_name.encode())
    sharded.put(root, ".hidden", b"x")
    return records.read_assets(spark, root, 3)


@query("q_run_records", "SELECT user_id || event_type AS id, arg_max(value, event_id) AS gen_s, arg_max(event_id % 2 = 0, event_id) AS truncated FROM events GROUP BY ALL")
def run_records(spark, sf_dir):
    """Events as run records in files of JSON lines, in order of the event; the last record of an id counts."""
    at = f"{folder(spark, 'runs')}/r"
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    e.repartitionByRange(4, "event_id").sortWithinPartitions("event_id").select(F.concat(F.col("user_id").cast("string"), "event_type").alias("id"), F.col("value").alias("gen_s"), (F.col("event_id") % 2 == 0).alias("truncated")).write.json(at)
    return records.read_runs(spark, at).select("id", "gen_s", "truncated")


@query("q_run_records_strict", "SELECT event_id::VARCHAR AS id, event_type AS answer_key FROM events")
def run_records_strict(spark, sf_dir):
    """The same with an id each; one that occurs twice is refused."""
    at = folder(spark, "strict")
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("answer_key"))
    e.write.json(f"{at}/once")
    e.limit(1).unionByName(e).write.json(f"{at}/twice")
    try:
        records.read_runs_strict(spark, f"{at}/twice")
        raise AssertionError("an id that occurs twice was read")
    except LoomError:
        return records.read_runs_strict(spark, f"{at}/once").select("id", "answer_key")


@query("q_question_set", "SELECT n_nationkey::VARCHAR AS id, 'r' || n_regionkey AS category, lower(regexp_replace(n_name, '[^a-zA-Z0-9]', '', 'g')) AS pattern, 64 AS max_tokens FROM nation")
def question_set(spark, sf_dir):
    """A question for each nation in one JSON file; patterns are normalised when read."""
    at = folder(spark, "questions")
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").collect()  # twenty-five
    data = {"max_tokens": 64, "questions": [{"id": str(r.n_nationkey), "category": f"r{r.n_regionkey}", "prompt": "p", "checks": [{"type": "contains", "patterns": [f" {r.n_name}. "]}]} for r in rows]}
    sharded.put(at, "q.json", json.dumps(data, indent=1).encode())
    q = records.read_questions(spark, f"{at}/q.json")
    return q.select("id", "category", F.col("checks")[0]["patterns"][0].alias("pattern"), "max_tokens")


def _bytes_sql(n: int, put: dict[int, str]) -> str:
    """A list of n bytes from hashes of the id, some replaced."""
    hexed = " || ".join(f"sha256(doc_id || ':{k}')" for k in range(-(-n // 32)))
    fixed = " ".join(f"WHEN {k} THEN {int(v, 16)}" for k, v in put.items())
    return f"list_transform(range({n}), lambda i: CASE i {fixed} ELSE ('0x' || substr({hexed}, 2 * i + 1, 2))::INTEGER END)"


# Bytes of half floats, lowest first: 1.0 and 0.5.
ONE, HALF = ("00", "3c"), ("00", "38")
BLOCKS = {
    "Q8_0": (34, {0: ONE[0], 1: ONE[1]}, 32, "CASE WHEN b[i + 3] > 127 THEN b[i + 3] - 256 ELSE b[i + 3] END"),
    "Q4_0": (18, {0: ONE[0], 1: ONE[1]}, 32, "((b[i % 16 + 3] >> (4 * (i // 16))) & 15) - 8"),
    "Q4_K": (144, {0: ONE[0], 1: ONE[1], 2: HALF[0], 3: HALF[1]}, 256, "CASE WHEN i < 128 THEN b[i // 32 + 5] & 63 ELSE (b[i // 32 + 9] & 15) | ((b[i // 32 + 1] >> 6) << 4) END * ((b[32 * (i // 64) + i % 32 + 17] >> (4 * (i // 32 % 2))) & 15) - 0.5 * CASE WHEN i < 128 THEN b[i // 32 + 9] & 63 ELSE (b[i // 32 + 9] >> 4) | ((b[i // 32 + 5] >> 6) << 4) END"),
    "Q6_K": (210, {208: ONE[0], 209: ONE[1]}, 256, "CASE WHEN b[i // 16 + 193] > 127 THEN b[i // 16 + 193] - 256 ELSE b[i // 16 + 193] END * ((((b[64 * (i // 128) + i % 64 + 1] >> (4 * (i % 128 // 64))) & 15) | (((b[32 * (i // 128) + i % 32 + 129] >> (2 * (i % 128 // 32))) & 3) << 4)) - 32)"),
    "Q2_K": (84, {80: ONE[0], 81: ONE[1], 82: HALF[0], 83: HALF[1]}, 256, "(b[i // 16 + 1] & 15) * ((b[32 * (i // 128) + i % 32 + 17] >> (2 * (i % 128 // 32))) & 3) - 0.5 * (b[i // 16 + 1] >> 4)"),
    "Q5_0": (22, {0: ONE[0], 1: ONE[1]}, 32, "(((b[i % 16 + 7] >> (4 * (i // 16))) & 15) | (((b[i // 8 + 3] >> (i % 8)) & 1) << 4)) - 16"),
    "Q8_K": (292, {0: "00", 1: "00", 2: "80", 3: "3f"}, 256, "CASE WHEN b[i + 5] > 127 THEN b[i + 5] - 256 ELSE b[i + 5] END"),
    "IQ4_NL": (18, {0: ONE[0], 1: ONE[1]}, 32, "([-127, -104, -83, -65, -49, -35, -22, -10, 1, 13, 25, 38, 53, 69, 89, 113])[((b[i % 16 + 3] >> (4 * (i // 16))) & 15) + 1]"),
    "IQ4_XS": (136, {0: ONE[0], 1: ONE[1]}, 256, "((((b[i // 64 + 5] >> (4 * (i // 32 % 2))) & 15) | ((((b[3] + 256 * b[4]) >> (2 * (i // 32))) & 3) << 4)) - 32) * ([-127, -104, -83, -65, -49, -35, -22, -10, 1, 13, 25, 38, 53, 69, 89, 113])[((b[16 * (i // 32) + i % 16 + 9] >> (4 * (i % 32 // 16))) & 15) + 1]"),
}


def _decoded(kind: str):
    n, put, width, formula = BLOCKS[kind]

    @query(f"q_blocks_{kind.lower()}", f"WITH d AS (SELECT doc_id, {_bytes_sql(n, put)} AS b FROM labels) SELECT doc_id, list_sum(list_transform(range({width}), lambda i: ({formula}) * (i + 1)))::DOUBLE AS total FROM d")
    def run(spark, sf_dir):
        """A block of hashed bytes for each label, decoded; its values, weighted by their place, as one sum."""
        hexed = F.concat(*[F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit(f":{k}")), 256) for k in range(-(-n // 32))])
        parts, at = [], 0
        for k in sorted(put):
            parts += [F.substring(hexed, 2 * at + 1, 2 * (k - at)), F.lit(put[k])]
            at = k + 1
        raw = F.unhex(F.concat(*parts, F.substring(hexed, 2 * at + 1, 2 * (n - at))))

        def decode(batches):
            for b in batches:
                x = blocks.decode(kind, b"".join(b.column("raw").to_pylist()), width).astype("float64")
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(x @ np.arange(1.0, width + 1))], ["doc_id", "total"])

        return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", raw.alias("raw")).mapInArrow(decode, "doc_id bigint, total double")


for _kind in BLOCKS:
    _decoded(_kind)


@query("q_anomaly_markdown", "SELECT '| ' || lang || ' | ' || count(*) || ' |' AS line FROM documents GROUP BY lang UNION ALL SELECT '| lang | n |' UNION ALL SELECT '| --- | --- |'")
def markdown(spark, sf_dir):
    """A small result as the lines of a table."""
    from .scoring import markdown as table

    d = spark.read.parquet(f"{sf_dir}/documents.parquet").groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang")
    return spark.createDataFrame([(x,) for x in table(d).split("\n")], "line string")


