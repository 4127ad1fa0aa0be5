import json

import numpy as np
import pytest
from model_files import gguf as write_gguf

from sparkloom import architectures, config
from sparkloom.plans import convert, planner, selection, verify
from sparkloom.sources import gguf

R = np.random.default_rng(4)


@pytest.mark.parametrize(("name", "rules"), [("gemma3", 16), ("llama", 13), ("qwen3", 14), ("qwen3_5", 24), ("qwen3_5_moe", 29)])
def test_built_in_configurations_are_in_the_grammar(name, rules):
    c = config.resolve_config([], name)
    assert len(c.rules) == rules and config.resolve_config([], arch=c.accepted[0]).id == name
    assert {r.name for r in c.rules if r.optional} == {"lm_head"}


def whole(*shape):
    return R.integers(-40, 40, shape).astype("float32")


def dense(family, path, hidden=64, heads=4, kv=2, dim=16, ff=96):
    t = {"token_embd.weight": ("Q8_0", whole(40, hidden)), "output_norm.weight": ("F32", R.normal(size=hidden))}
    if family == "llama":
        t["rope_freqs.weight"] = ("F32", R.normal(size=8))
    norms = {"llama": ["attn_norm", "ffn_norm"], "qwen3": ["attn_norm", "ffn_norm"], "gemma3": ["attn_norm", "post_attention_norm", "ffn_norm", "post_ffw_norm"]}[family]
    for i in range(2):
        t |= {f"blk.{i}.{n}.weight": ("F32", R.normal(size=hidden)) for n in norms}
        t |= {f"blk.{i}.{n}.weight": ("Q8_0", whole(*s)) for n, s in (("attn_q", (heads * dim, hidden)), ("attn_k", (kv * dim, hidden)), ("attn_v", (kv * dim, hidden)), ("attn_output", (hidden, heads * dim)), ("ffn_gate", (ff, hidden)), ("ffn_up", (ff, hidden)), ("ffn_down", (hidden, ff)))}
        if family != "llama":
            t |= {f"blk.{i}.attn_{x}_norm.weight": ("F32", R.normal(size=dim)) for x in "qk"}
    meta = {"general.architecture": family, **{f"{family}.{k}": v for k, v in {"embedding_length": hidden, "block_count": 2, "attention.head_count": heads, "attention.head_count_kv": kv, "attention.key_length": dim, "feed_forward_length": ff, "attention.layer_norm_rms_epsilon": 1e-6, "rope.freq_base": 1e4, "context_length": 128, "attention.sliding_window": 32}.items()}}
    write_gguf(path, meta, t)
    return {k: x for k, (_, x) in t.items()}


@pytest.mark.parametrize("family", ["llama", "qwen3", "gemma3"])
def test_dense_families_convert_and_verify(spark, tmp_path, family):
    t = dense(family, tmp_path / "m.gguf")
    model = gguf.open_model(spark, str(tmp_path / "m.gguf"))
    plan = planner.plan(spark, config.resolve_config([], arch=model.header.arch), gguf.catalogue(spark, model.header), model.header.metadata)
    report = convert.convert(spark, plan, model, str(tmp_path / "o"), selection.select(spark, plan, 4), 32)
    assert report.tensors == len(t) - (family == "llama") and verify.verify(spark, plan, model, str(tmp_path / "o")).ok
    written = json.loads((tmp_path / "o/config.json").read_text())
    assert written["hidden_size"] == 64 and written["tie_word_embeddings"] is True and written["attention_bias"] is False
    if family == "llama":
        job = next(j for j in plan.jobs if j.source == "blk.1.attn_k.weight")
        got = np.array([r["values"] for r in convert.transformed(plan, model, [job]).df.orderBy("row").collect()])
        assert np.array_equal(got, t["blk.1.attn_k.weight"].reshape(2, 8, 2, 64).transpose(0, 2, 1, 3).reshape(32, 64))
    if family == "gemma3":
        job = next(j for j in plan.jobs if j.source == "blk.0.attn_q_norm.weight")
        assert np.allclose(convert.transformed(plan, model, [job]).df.first()["values"], t["blk.0.attn_q_norm.weight"] - 1, atol=1e-6)


def test_hybrid_experts(spark, tmp_path):
    hidden, kh, kd, vh, vd, experts, wide = 64, 4, 8, 8, 8, 2, 64
    key, val = kh * kd, vh * vd
    t = {"token_embd.weight": ("Q8_0", whole(40, hidden)), "output_norm.weight": ("F32", R.normal(size=hidden)), "blk.2.leftover": ("F32", R.normal(size=4)), "output.weight": ("Q8_0", whole(40, hidden))}
    for i in range(2):
        t |= {f"blk.{i}.{n}.weight": ("F32", R.normal(size=s)) for n, s in (("attn_norm", hidden), ("post_attention_norm", hidden), ("ffn_gate_inp_shexp", hidden))}
        t |= {f"blk.{i}.{n}.weight": ("Q8_0", whole(*s)) for n, s in (("ffn_gate_inp", (experts, hidden)), ("ffn_gate_shexp", (wide, hidden)), ("ffn_up_shexp", (wide, hidden)), ("ffn_down_shexp", (hidden, wide)), ("ffn_gate_exps", (experts, wide, hidden)), ("ffn_up_exps", (experts, wide, hidden)), ("ffn_down_exps", (experts, hidden, wide)))}
    t |= {f"blk.0.{n}": ("F32", x) for n, x in (("attn_qkv.weight", whole(2 * key + val, hidden)), ("attn_gate.weight", whole(val, hidden)), ("ssm_alpha.weight", whole(vh, hidden)), ("ssm_beta.weight", whole(vh, hidden)), ("ssm_out.weight", whole(hidden, val)), ("ssm_conv1d.weight", R.normal(size=(2 * key + val, 4))), ("ssm_dt.bias", R.normal(size=vh)), ("ssm_a", -R.random(vh) - 0.1), ("ssm_norm.weight", R.normal(size=vd)))}
    t |= {f"blk.1.{n}.weight": ("F32", x) for n, x in (("attn_q", whole(2 * 4 * 16, hidden)), ("attn_k", whole(2 * 16, hidden)), ("attn_v", whole(2 * 16, hidden)), ("attn_output", whole(hidden, 4 * 16)), ("attn_q_norm", R.normal(size=16)), ("attn_k_norm", R.normal(size=16)))}
    a = "qwen35moe"
    meta = {"general.architecture": a, **{f"{a}.{k}": v for k, v in {"embedding_length": hidden, "block_count": 3, "nextn_predict_layers": 1, "attention.head_count": 4, "attention.head_count_kv": 2, "attention.key_length": 16, "expert_count": experts, "expert_used_count": 1, "expert_feed_forward_length": wide, "expert_shared_feed_forward_length": wide, "ssm.group_count": kh, "ssm.state_size": kd, "ssm.time_step_rank": vh, "ssm.inner_size": val, "ssm.conv_kernel": 4, "attention.layer_norm_rms_epsilon": 1e-6, "rope.freq_base": 1e4, "rope.dimension_count": 4, "context_length": 128, "rope.dimension_sections": [1, 2, 3, 4]}.items()}}
    write_gguf(tmp_path / "m.gguf", meta, t)
    model = gguf.open_model(spark, str(tmp_path / "m.gguf"))
    plan = planner.plan(spark, config.resolve_config([], arch=a), gguf.catalogue(spark, model.header), model.header.metadata)
    shapes = {j.dest.removeprefix("language_model.model.layers."): j.out_shape for j in plan.jobs}
    assert plan.dropped == (("blk.2.leftover", "further_tokens"),) and shapes["0.linear_attn.conv1d.weight"] == (128, 4, 1) and shapes["0.mlp.shared_expert_gate.weight"] == (1, 64) and shapes["1.mlp.switch_mlp.down_proj.weight"] == (2, 64, 64)
    job = next(j for j in plan.jobs if j.source == "blk.0.ssm_a")
    got = np.array(convert.transformed(plan, model, [job]).df.first()["values"])
    order = [(i % 2) * 4 + i // 2 for i in range(8)]
    assert np.allclose(got, np.log(-t["blk.0.ssm_a"][1][order]), atol=1e-5)
    convert.convert(spark, plan, model, str(tmp_path / "o"), selection.select(spark, plan, 3), 64)
    report = verify.verify(spark, plan, model, str(tmp_path / "o"))
    assert report.ok, report.failures
    written = json.loads((tmp_path / "o/config.json").read_text())
    assert written["text_config"]["rope_parameters"]["mrope_section"] == [1, 2, 3, 4] and written["quantization"]["language_model.model.layers.0.mlp.gate"] == {"bits": 8, "group_size": 64} and written["tie_word_embeddings"] is False
    assert set(architectures.BUILT_IN) >= {"llama"}
