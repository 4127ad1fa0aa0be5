"""Built-in configurations, put together from the parts that model families share.

A family is a few lists: what its layers hold, which dimensions they need, what its configuration says.
The result is plain data in the grammar of ``config``, the same that a file would hold.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

# Names of tensors in source files and in outputs, of metadata keys and of configuration fields.
TOKENIZER = ("tokenizer.json", "tokenizer_config.json", "generation_config.json", "special_tokens_map.json")
TOKENIZER_PARTS = ("merges.txt", "vocab.json")
HEADS = {"mul": ["n_heads", "head_dim"]}
KV_HEADS = {"mul": ["n_kv_heads", "head_dim"]}
FEED_FORWARD = (("ffn_gate", "mlp.gate_proj", ["intermediate_size", "hidden_size"]), ("ffn_up", "mlp.up_proj", ["intermediate_size", "hidden_size"]), ("ffn_down", "mlp.down_proj", ["hidden_size", "intermediate_size"]))
COMMON_DIMS = {
    "hidden_size": ("embedding_length", "hidden_size"), "n_layers": ("block_count", "num_hidden_layers"), "vocab_size": ("vocab_size", "vocab_size"), "n_heads": ("attention.head_count", "num_attention_heads"), "n_kv_heads": ("attention.head_count_kv", "num_key_value_heads"),
    "head_dim": ("attention.key_length", "head_dim"), "intermediate_size": ("feed_forward_length", "intermediate_size"), "rms_norm_eps": ("attention.layer_norm_rms_epsilon", "rms_norm_eps"), "rope_theta": ("rope.freq_base", "rope_theta"),
}
FIELDS = {"hidden_size": "hidden_size", "num_hidden_layers": "n_layers", "vocab_size": "vocab_size", "num_attention_heads": "n_heads", "num_key_value_heads": "n_kv_heads", "head_dim": "head_dim", "intermediate_size": "intermediate_size", "rms_norm_eps": "rms_norm_eps"}
LINEAR = ("linear_num_value_heads", "linear_num_key_heads", "linear_key_head_dim", "linear_value_head_dim", "linear_conv_kernel_dim")


def _rule(name: str, source: str, dest: str, shape: Sequence[Any], **more: Any) -> dict[str, Any]:
    return {"name": name, "match": source.replace(".", r"\."), "dest": dest, "expect_shape": list(shape), **more}


class Family:
    """Collects the parts of one configuration."""

    def __init__(self, name: str, archs: str | list[str], model_type: str, title: str, prefix: str = "", nested: bool = False):
        self.name, self.archs, self.model_type, self.title, self.prefix, self.nested = name, archs, model_type, title, prefix, nested
        self.dims: dict[str, Any] = {k: self.chain(*v) for k, v in COMMON_DIMS.items()}
        self.dims["vocab_size"].insert(1, "tshape:token_embd.weight.0")
        tied = {"not": ["has:output.weight"]}
        self.top, self.rules, self.required, self.alternatives = {"tie_word_embeddings": tied}, [], [], []
        self.text: dict[str, Any] = {k: [v] for k, v in FIELDS.items()}
        self.text |= {"max_position_embeddings": self.chain("context_length", "max_position_embeddings"), "attention_bias": ["gguf:attention.bias", False], "attention_dropout": 0.0, "tie_word_embeddings": tied}
        self.text |= {f"{t}_token_id": [f"gguf:tokenizer.ggml.{t}_token_id", f"ref:{t}_token_id", None] for t in ("eos", "bos", "pad")}
        self.drop_fields, self.tokenizer = ["architectures", "model_type"], list(TOKENIZER)

    @staticmethod
    def chain(key: str, ref: str, *last: Any) -> list[Any]:
        return [f"gguf:{key}", f"ref:{ref}", *last]

    def add(self, *rules: dict[str, Any]) -> None:
        self.rules += rules

    def whole(self, norm: dict[str, Any]) -> None:
        """Embeddings, head and last norm."""
        p = self.prefix
        self.add(_rule("embeddings", "token_embd.weight", f"{p}model.embed_tokens.weight", ["vocab_size", "hidden_size"]))
        self.add(_rule("lm_head", "output.weight", f"{p}lm_head.weight", ["vocab_size", "hidden_size"], optional=True))
        self.add(_rule("final_norm", "output_norm.weight", f"{p}model.norm.weight", ["hidden_size"], **norm))

    def layer(self, source: str, dest: str, shape: Sequence[Any], needed: bool = False, tail: str = ".weight", bare: bool = False, **more: Any) -> None:
        """One tensor of every layer; ``bare``: without the tail in the source or the output."""
        out = f"{self.prefix}model.layers.{{n}}.{dest}{'' if bare else tail}"
        rule = _rule(source, f"@.{source}{tail}", out, shape, **more)
        self.add(rule | {"match": rule["match"].replace(r"@\.", r"blk\.(?P<n>\d+)\.")})
        if needed:
            self.required.append(out.replace("{n}", "{layer}"))

    def one_of(self, *dests: str) -> None:
        self.alternatives.append([f"{self.prefix}model.layers.{{layer}}.{d}.weight" for d in dests])

    def attention(self, norms: dict[str, Any] | None, q: Sequence[Any] = (), k: Sequence[Any] = (), wide: int = 1, needed: bool = True) -> None:
        """Query, key, value and output projections, with norms of queries and keys where ``norms`` isn't None."""
        width = HEADS if wide == 1 else {"mul": [wide, "n_heads", "head_dim"]}
        step = lambda s: {"steps": list(s)} if s else {}
        self.layer("attn_q", "self_attn.q_proj", [width, "hidden_size"], **step(q))
        self.layer("attn_k", "self_attn.k_proj", [KV_HEADS, "hidden_size"], **step(k))
        self.layer("attn_v", "self_attn.v_proj", [KV_HEADS, "hidden_size"])
        self.layer("attn_output", "self_attn.o_proj", ["hidden_size", HEADS])
        if norms is not None:
            for x in "qk":
                self.layer(f"attn_{x}_norm", f"self_attn.{x}_norm", ["head_dim"], needed, **norms)

    def feed_forward(self) -> None:
        for source, dest, shape in FEED_FORWARD:
            self.layer(source, dest, shape, True)

    def fields(self, **more: Any) -> None:
        self.text |= more

    def raw(self, required: Sequence[str]) -> dict[str, Any]:
        where = "text_config." if self.nested else ""
        output = {
            "model_type": self.model_type, "architectures": [self.title], "top_level": self.top, "text_config": self.text, "reference_config": {"drop_fields": self.drop_fields},
            "tokenizer_files": self.tokenizer, "required_fields": ["tie_word_embeddings", *(f"{where}{f}" for f in (*FIELDS, "max_position_embeddings", *required))],
        }
        if self.nested:
            output["nest_config_under"] = "text_config"
        return {"architecture": {"id": self.name, "gguf_arch": self.archs}, "dims": self.dims, "rules": self.rules, "coverage": {"per_layer_required": self.required, "per_layer_alternatives": self.alternatives}, "output": output}


NORM = {"quantize": False, "dtype": "float32"}
#: Norms stored with one added, which outputs go without.
SHIFTED = NORM | {"steps": [{"op": "add", "args": {"value": -1}}]}


def rotary_rows(heads: str) -> list[dict[str, Any]]:
    """Rows of a head stored as pairs back to halves."""
    lists = lambda *x: {"shape": {"list": list(x)}}
    return [{"op": "reshape", "args": lists(heads, {"div": ["head_dim", 2]}, 2, "hidden_size")}, {"op": "permute", "args": {"axes": {"list": [0, 2, 1, 3]}}}, {"op": "reshape", "args": lists({"mul": [heads, "head_dim"]}, "hidden_size")}]


def llama() -> dict[str, Any]:
    f = Family("llama", "llama", "llama", "LlamaForCausalLM")
    f.add({"name": "rope_freqs", "match": r"rope_freqs\..*", "drop": True})
    f.whole(NORM)
    f.layer("attn_norm", "input_layernorm", ["hidden_size"], True, **NORM)
    f.layer("ffn_norm", "post_attention_layernorm", ["hidden_size"], True, **NORM)
    f.attention(None, rotary_rows("n_heads"), rotary_rows("n_kv_heads"))
    f.feed_forward()
    f.one_of("self_attn.q_proj")
    f.fields(rope_theta=["rope_theta"], rope_scaling=["ref:rope_scaling", None], hidden_act="silu")
    return f.raw([])


def qwen3() -> dict[str, Any]:
    f = Family("qwen3", "qwen3", "qwen3", "Qwen3ForCausalLM")
    f.whole(NORM)
    f.layer("attn_norm", "input_layernorm", ["hidden_size"], True, **NORM)
    f.layer("ffn_norm", "post_attention_layernorm", ["hidden_size"], True, **NORM)
    f.attention(NORM)
    f.feed_forward()
    f.one_of("self_attn.q_proj")
    f.fields(rope_theta=["rope_theta"], rope_scaling=["ref:rope_scaling", None], hidden_act="silu")
    f.drop_fields += ["rope_scaling", "attention_bias", "attention_dropout", "hidden_act", "tie_word_embeddings", "bos_token_id", "eos_token_id", "pad_token_id"]
    f.tokenizer += TOKENIZER_PARTS
    return f.raw(["rope_theta", "rope_scaling", "attention_bias", "attention_dropout", "hidden_act"])


def gemma3() -> dict[str, Any]:
    f = Family("gemma3", "gemma3", "gemma3_text", "Gemma3ForCausalLM")
    f.dims["sliding_window"] = f.chain("attention.sliding_window", "sliding_window")
    f.whole(SHIFTED)
    for source, dest in (("attn_norm", "input"), ("post_attention_norm", "post_attention"), ("ffn_norm", "pre_feedforward"), ("post_ffw_norm", "post_feedforward")):
        f.layer(source, f"{dest}_layernorm", ["hidden_size"], True, **SHIFTED)
    f.attention(SHIFTED)
    f.feed_forward()
    f.one_of("self_attn.q_proj")
    del f.text["tie_word_embeddings"]
    f.fields(rope_theta=["rope_theta"], rope_local_base_freq=["ref:rope_local_base_freq", 10000.0], sliding_window=["sliding_window"], sliding_window_pattern=["ref:sliding_window_pattern", 6], query_pre_attn_scalar=["head_dim"], rope_scaling=["ref:rope_scaling", None])
    f.drop_fields += ["rope_scaling", "rope_local_base_freq", "sliding_window_pattern", "attention_bias", "attention_dropout", "tie_word_embeddings", "bos_token_id", "eos_token_id", "pad_token_id"]
    return f.raw(["rope_theta", "rope_local_base_freq", "sliding_window", "sliding_window_pattern", "query_pre_attn_scalar", "attention_bias", "attention_dropout"])


def _hybrid(name: str, archs: str | list[str], title: str) -> Family:
    """Layers of linear attention with full attention between them; blocks that predict further tokens are left out."""
    f = Family(name, archs, name, title, "language_model.", True)
    d = f.dims
    d |= {"total_blocks": ["gguf:block_count"], "nextn_predict_layers": ["gguf:nextn_predict_layers", 0], "n_layers": [{"sub": ["gguf:block_count", "nextn_predict_layers"]}, "ref:num_hidden_layers"]}
    f.dims = d = {k: d[k] for k in ("hidden_size", "total_blocks", "nextn_predict_layers", "n_layers", *[k for k in d if k not in ("hidden_size", "total_blocks", "nextn_predict_layers", "n_layers")])}
    either = lambda first, key: [first, f"gguf:{key}", f"ref:{key}"]
    d |= {"linear_num_key_heads": either("gguf:ssm.group_count", "linear_num_key_heads"), "linear_key_head_dim": either("gguf:ssm.state_size", "linear_key_head_dim"), "linear_num_value_heads": either("gguf:ssm.time_step_rank", "linear_num_value_heads")}
    d |= {"linear_value_head_dim": either({"div": ["gguf:ssm.inner_size", "gguf:ssm.time_step_rank"]}, "linear_value_head_dim"), "linear_conv_kernel_dim": either("gguf:ssm.conv_kernel", "linear_conv_kernel_dim"), "full_attention_interval": f.chain("full_attention_interval", "full_attention_interval", 4)}
    d |= {"key_dim": {"mul": ["linear_num_key_heads", "linear_key_head_dim"]}, "value_dim": {"mul": ["linear_num_value_heads", "linear_value_head_dim"]}, "conv_dim": {"add": [{"mul": [2, "key_dim"]}, "value_dim"]}}
    d |= {"rope_theta": f.chain("rope.freq_base", "rope_parameters.rope_theta"), "rope_dim": f.chain("rope.dimension_count", "rope_parameters.partial_rotary_factor")}
    heads = lambda **args: {"op": "qwen35_v_head_unpermute", "args": args}
    edge = {"mul": [2, "key_dim"]}
    parts = {"inputs": {"qk": {"slice": {"axis": 0, "lo": 0, "hi": edge}}, "v": {"slice": {"axis": 0, "lo": edge, "hi": "conv_dim"}}}}
    joined = [heads(axis=0) | {"input": "v", "output": "v_nat"}, {"op": "concat", "inputs": ["qk", "v_nat"], "args": {"axis": 0}}]
    single, n = [heads(axis=0, block=1)], "linear_num_value_heads"
    f.add({"name": "further_tokens", "match": r"blk\.{i}\..*", "drop": True, "range": {"start": "n_layers", "end": "total_blocks"}})
    f.whole(NORM)
    f.layer("attn_norm", "input_layernorm", ["hidden_size"], True, **NORM)
    f.layer("post_attention_norm", "post_attention_layernorm", ["hidden_size"], True, **NORM)
    f.attention(NORM, wide=2, needed=False)
    f.layer("attn_qkv", "linear_attn.in_proj_qkv", ["conv_dim", "hidden_size"], steps=joined, **parts)
    f.layer("attn_gate", "linear_attn.in_proj_z", ["value_dim", "hidden_size"], steps=[heads(axis=0)])
    f.layer("ssm_alpha", "linear_attn.in_proj_a", [n, "hidden_size"], steps=single)
    f.layer("ssm_beta", "linear_attn.in_proj_b", [n, "hidden_size"], steps=single)
    f.layer("ssm_out", "linear_attn.out_proj", ["hidden_size", "value_dim"], steps=[heads(axis=1)])
    f.layer("ssm_conv1d", "linear_attn.conv1d", ["conv_dim", "linear_conv_kernel_dim"], steps=[*joined, {"op": "unsqueeze", "input": "_", "args": {"axis": -1}}], **parts, **NORM)
    f.layer("ssm_dt", "linear_attn.dt_bias", [n], tail=".bias", bare=True, steps=single, **NORM)
    f.layer("ssm_a", "linear_attn.A_log", [n], tail="", steps=[*single, {"op": "neg"}, {"op": "log"}], **NORM)
    f.layer("ssm_norm", "linear_attn.norm", ["linear_value_head_dim"], **NORM)
    f.one_of("self_attn.q_proj", "linear_attn.in_proj_qkv")
    f.fields(**{k: [k] for k in (*LINEAR, "full_attention_interval")}, attn_output_gate=True, hidden_act="silu", rope_parameters={"rope_type": "default", "rope_theta": ["rope_theta"], "partial_rotary_factor": [{"div": ["rope_dim", "head_dim"]}]})
    f.drop_fields = ["architectures", "model_name", "unsloth_version", "rope_parameters", "attention_bias", "attention_dropout", "attn_output_gate", "hidden_act"]
    f.tokenizer += ["chat_template.jinja", *TOKENIZER_PARTS]
    return f


HYBRID_FIELDS = (*LINEAR, "full_attention_interval", "attention_bias", "attention_dropout", "attn_output_gate", "hidden_act", "rope_parameters.rope_theta", "rope_parameters.partial_rotary_factor")


def qwen3_5() -> dict[str, Any]:
    f = _hybrid("qwen3_5", ["qwen35", "qwen3_5_text"], "Qwen3_5ForCausalLM")
    f.feed_forward()
    return f.raw(HYBRID_FIELDS)


def qwen3_5_moe() -> dict[str, Any]:
    f = _hybrid("qwen3_5_moe", "qwen35moe", "Qwen3_5MoeForConditionalGeneration")
    f.dims["intermediate_size"].append(0)
    wide, shared, hidden, experts = "moe_intermediate_size", "shared_expert_intermediate_size", "hidden_size", "n_experts"
    more = {experts: f.chain("expert_count", "num_experts"), "n_experts_used": f.chain("expert_used_count", "num_experts_per_tok"), wide: f.chain("expert_feed_forward_length", wide), shared: f.chain("expert_shared_feed_forward_length", shared)}
    f.dims |= more
    eight = {"bits": 8, "group_size": 64}
    f.layer("ffn_gate_inp", "mlp.gate", [experts, hidden], True, **eight)
    f.layer("ffn_gate_inp_shexp", "mlp.shared_expert_gate", [hidden], True, steps=[{"op": "unsqueeze", "args": {"axis": 0}}], **eight)
    for part, shape in (("gate", [shared, hidden]), ("up", [shared, hidden]), ("down", [hidden, shared])):
        f.layer(f"ffn_{part}_shexp", f"mlp.shared_expert.{part}_proj", shape, True)
    for part, shape in (("gate", [experts, wide, hidden]), ("up", [experts, wide, hidden]), ("down", [experts, hidden, wide])):
        f.layer(f"ffn_{part}_exps", f"mlp.switch_mlp.{part}_proj", shape, True)
    f.fields(num_experts=[experts], num_experts_per_tok=["n_experts_used"], moe_intermediate_size=[wide], shared_expert_intermediate_size=[shared], norm_topk_prob=["ref:norm_topk_prob", True], decoder_sparse_step=["ref:decoder_sparse_step", 1])
    f.text["rope_parameters"] |= {"mrope_section": ["gguf:rope.dimension_sections"], "mrope_interleaved": True}
    return f.raw((*HYBRID_FIELDS, "num_experts", "num_experts_per_tok", wide, shared, "norm_topk_prob", "decoder_sparse_step", "rope_parameters.mrope_section"))


BUILT_IN = {"gemma3": gemma3, "llama": llama, "qwen3": qwen3, "qwen3_5": qwen3_5, "qwen3_5_moe": qwen3_5_moe}
