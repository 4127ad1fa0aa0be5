import copy
import json
import shutil
from pathlib import Path

import numpy as np
import pytest
from model_files import CONFIG, expected, model, tokenizer

from sparkloom import config
from sparkloom.errors import ConversionError, PlanError, SourceError, VerifyError
from sparkloom.plans import convert, planner, selection, verify
from sparkloom.sinks import sharded
from sparkloom.sources import gguf, safetensors


def planned(spark, path, raw=CONFIG, reference=None):
    m = gguf.open_model(spark, str(path))
    return planner.plan(spark, config.parse(raw), gguf.catalogue(spark, m.header), m.header.metadata, reference), m


@pytest.fixture(scope="module")
def done(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("model")
    tensors = model(folder / "m.gguf")
    plan, rows = planned(spark, folder / "m.gguf", reference={"rope": {"a": 1}, "num_layers": 9, "kept": 5})
    decision = selection.select(spark, plan, "auto")
    report = convert.convert(spark, plan, rows, str(folder / "out"), decision, 64, tokenizer(folder / "tok"))
    return folder, tensors, plan, rows, report


def test_source(spark, tmp_path):
    tensors = model(tmp_path / "m.gguf")
    rows = gguf.open_model(spark, str(tmp_path / "m.gguf"))
    head = rows.header
    assert head.arch == "toy" and head.metadata["some"] == [1, 2, 3] and head.metadata["long"] == "<array of 5000>" and head.metadata["flag"] is True
    got = np.array([r["values"] for r in gguf.read_matrix(rows, "token_embd.weight").orderBy("row").collect()])
    assert np.array_equal(got, tensors["token_embd.weight"])
    part = gguf.read_rows(rows, "blk.0.attn_q.weight", 3, 7).orderBy("row").collect()
    assert [r.row for r in part] == [3, 4, 5, 6] and np.array_equal(np.array([r["values"] for r in part]), tensors["blk.0.attn_q.weight"][3:7])
    assert gguf.read_vector(rows, "output_norm.weight").count() == 1
    with pytest.raises(SourceError):
        gguf.read_vector(rows, "token_embd.weight")
    data = (tmp_path / "m.gguf").read_bytes()
    for name, bad in (("short", data[:-100]), ("magic", b"XXXX" + data[4:]), ("cut", data[:50])):
        (tmp_path / name).write_bytes(bad)
        with pytest.raises(SourceError):
            gguf.read_header(str(tmp_path / name))


def test_plan(done):
    _, _, plan, _, _ = done
    assert plan.dims["head_dim"] == 16 and plan.dropped == (("rope_freqs.weight", "rope"),) and not plan.unmatched
    shapes = {j.dest: j.out_shape for j in plan.jobs}
    assert shapes["model.layers.1.qkv.weight"] == (192, 64) and len(plan.jobs) == 8
    assert any("reshape > permute > reshape" in x for x in plan.summary())


def test_output(spark, done):
    folder, tensors, plan, rows, report = done
    out = folder / "out"
    assert report.shards > 1 and report.decision.dominant == "Q8_0" and report.decision.bits == 8 and report.overridden == ("num_layers: 9 becomes 2",)
    settings = json.loads((out / "config.json").read_text())
    assert settings["quantization"] == {"bits": 8, "group_size": 64, "mode": "affine", "model.embed": {"bits": 8, "group_size": 32}}
    assert settings["rope"] == {"a": 1} and settings["kept"] == 5 and settings["tie_word_embeddings"] is True and settings["nested"] == {"a": 64}
    index = json.loads((out / safetensors.INDEX).read_text())
    assert index["metadata"]["total_size"] == sum(s.rows * s.row_bytes for s in safetensors.stored(str(out))) == report.output_bytes
    got = safetensors.as_numbers(safetensors.read(spark, str(out)))
    norm = got.where("key = 'model.norm.weight'").first()["values"]
    assert np.allclose(norm, expected(tensors, "model.norm.weight"), atol=1e-6)
    record = {planner.module_of(j.dest): j.setting(8, 64) for j in plan.jobs if j.quantize}
    values = convert.unpacked(safetensors.read(spark, str(out)), record)
    for j in plan.jobs:
        if j.quantize:
            x = np.array([r["values"] for r in values.where(values.key == j.dest).orderBy("row").collect()])
            want = expected(tensors, j.dest)
            assert x.shape == want.shape and np.abs(x - want).max() <= (want.max() - want.min()) / 255


def test_verify_and_tampering(spark, done, tmp_path):
    folder, _, plan, rows, _ = done
    report = verify.verify(spark, plan, rows, str(folder / "out"))
    assert report.ok and report.numeric == 8 and report.finite == 18, report.failures
    assert verify.verify(spark, plan, rows, str(folder / "out"), sample=True, finite=False).ok
    with pytest.raises(VerifyError):
        verify.verify(spark, plan, rows, str(folder / "out"), bits=4)
    bad = tmp_path / "bad"
    shutil.copytree(folder / "out", bad)
    s = next(x for x in safetensors.stored(str(bad)) if x.key == "model.layers.0.q.weight")
    data = bytearray((bad / s.shard).read_bytes())
    data[s.offset : s.offset + 64] = bytes(255 - b for b in data[s.offset : s.offset + 64])
    (bad / s.shard).write_bytes(data)
    shutil.copy(bad / s.shard, bad / "stray.safetensors")
    settings = json.loads((bad / "config.json").read_text())
    del settings["quantization"]["model.embed"]
    (bad / "config.json").write_text(json.dumps(settings))
    found = " | ".join(verify.verify(spark, plan, rows, str(bad)).failures)
    assert "model.layers.0.q.weight: differs" in found and "unreferenced shard" in found and "model.embed.weight: the rule says" in found
    index = json.loads((bad / safetensors.INDEX).read_text())
    index["weight_map"]["ghost.weight"] = s.shard
    del index["weight_map"]["model.norm.weight"]
    (bad / safetensors.INDEX).write_text(json.dumps(index))
    found = verify.verify(spark, plan, rows, str(bad), finite=False).failures
    assert any("ghost.weight: extra" in f for f in found) and any("model.norm.weight: missing" in f for f in found)


def test_half_floats_without_quantization(spark, done, tmp_path):
    folder, tensors, plan, rows, _ = done
    decision = selection.select(spark, plan, None)
    convert.convert(spark, plan, rows, str(tmp_path / "half"), decision)
    assert verify.verify(spark, plan, rows, str(tmp_path / "half"), tol=0.01).ok
    assert {s.dtype for s in safetensors.stored(str(tmp_path / "half"))} == {"F16", "F32"}


def test_a_failure_leaves_nothing(spark, done, tmp_path):
    _, _, plan, rows, _ = done
    decision = selection.select(spark, plan, 4)
    target = tmp_path / "t"
    with pytest.raises(ConversionError):
        convert.convert(spark, plan, rows, str(target), decision, tokenizer=str(tmp_path / "none"))
    assert not list(tmp_path.iterdir())
    target.mkdir()
    (target / "old").write_text("x")
    with pytest.raises(ConversionError):
        convert.convert(spark, plan, rows, str(target), decision)
    convert.convert(spark, plan, rows, str(target), decision, overwrite=True)
    assert not (target / "old").exists() and {p.name for p in tmp_path.iterdir()} == {"t"}
    with pytest.raises(RuntimeError), sharded.staged(str(tmp_path / "u")) as folder:
        Path(folder, "part").write_text("x")
        raise RuntimeError
    assert {p.name for p in tmp_path.iterdir()} == {"t"}


def test_values_that_are_not_finite_stop(spark, tmp_path):
    model(tmp_path / "m.gguf", extra=[("output_norm.weight", ("F32", np.full(64, np.inf)))])
    plan, rows = planned(spark, tmp_path / "m.gguf")
    with pytest.raises(Exception, match="aren't finite"):
        convert.convert(spark, plan, rows, str(tmp_path / "o"), selection.select(spark, plan, 4))
    assert not (tmp_path / "o").exists()


def change(**rules):
    raw = copy.deepcopy(CONFIG)
    for r in raw["rules"]:
        r.update(rules.get(r["name"], {}))
    return raw


@pytest.mark.parametrize(("raw", "says"), [
    (change(q={"expect_shape": ["hidden", 7]}), "instead of"),
    (change(q={"expect_shape": ["hidden"]}), "rank"),
    (change(q={"expect_shape": ["hiden", "hidden"]}), "unknown dimension"),
    (change(norm={"dest": "model.one.weight"}), "would both become"),
    (change(norm={"dest": "model.layers.{m}.norm.weight"}), "neither a group"),
    (change(norm={"quantize": True}), "two axes"),
    (change(head={"optional": False}), "had to match"),
    (change(norm={"match": r"blk\.(?P<n>[1])\.attn_norm\.weight"}), "match no rule"),
    (change(emb={"group_size": 128}), "whole groups"),
    (change(qkv={"steps": [{"op": "concat", "inputs": ["qk", "v"], "args": {}}]}), "axis"),
    (change(qkv={"steps": []}), "several slots"),
    (change(q={"steps": [{"op": "reshape", "args": {"shape": {"list": [7, 7]}}}]}), "can't become"),
    (change(q={"steps": [{"op": "slice", "args": {"axis": 0, "start": 5, "stop": 5}}]}), "empty"),
    (change(q={"dest": "model.layers.{n}.elsewhere.weight"}), "none of"),
])
def test_plans_that_fail_before_data_is_read(spark, tmp_path, raw, says):
    model(tmp_path / "m.gguf")
    with pytest.raises(PlanError, match=says):
        planned(spark, tmp_path / "m.gguf", raw)


def test_unmatched_may_be_a_warning(spark, tmp_path):
    model(tmp_path / "m.gguf", extra=[("blk.7.odd", ("F32", np.ones(4)))])
    raw = copy.deepcopy(CONFIG)
    raw["unmatched_tensors"] = "warn"
    assert planned(spark, tmp_path / "m.gguf", raw)[0].unmatched == ("blk.7.odd",)
    raw["rules"].insert(0, {"match": r"blk\.{i}\..*", "drop": True, "range": {"start": "n_layers", "end": {"add": ["n_layers", 6]}}})
    assert planned(spark, tmp_path / "m.gguf", raw)[0].dropped[-1][0] == "blk.7.odd"


def test_selection(spark):
    reads = lambda *rows: selection.histogram(spark.createDataFrame(rows, "qtype string, n_bytes bigint, share double"))
    three = reads(("IQ3_XXS", 700, 1.0), ("Q4_K", 200, 1.0), ("IQ2_S", 100, 1.0))
    d = selection.decide(three)
    assert d.bits == 3 and "70.0 %" in d.reason and d.advice and not selection.decide(three, 3).advice
    assert selection.decide(reads(("Q4_K", 600, 1.0), *[("IQ3_S", 20, 1.0)] * 20)).bits == 4
    tie = selection.dominant(reads(("Q4_K", 5, 1.0), ("Q6_K", 5, 1.0))).first()
    assert tie.qtype == "Q6_K" and tie.bits == 6
    for rows in ([("Q5_K_M", 9, 1.0), ("Q4_K", 1, 1.0)], [("F32", 9, 1.0)]):
        with pytest.raises(PlanError):
            selection.decide(reads(*rows))
    with pytest.raises(PlanError):
        selection.decide(three, 5)
    assert selection.decide(three, None).bits == 0


def test_shards_close_when_full():
    e = [sharded.Entry(str(i), "F32", (8, 8)) for i in range(6)]
    assert [len(s) for s in sharded.assign(e, 512)] == [2, 2, 2]
    assert [len(s) for s in sharded.assign(e, 513)] == [3, 3]
