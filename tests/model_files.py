"""Builds small model files for the tests."""

import json
import struct

import numpy as np

KINDS = {"F32": 0, "Q8_0": 8}


def text(s):
    return struct.pack("<Q", len(s.encode())) + s.encode()


def value(v):
    if isinstance(v, bool):
        return struct.pack("<I?", 7, v)
    if isinstance(v, int):
        return struct.pack("<II", 4, v)
    if isinstance(v, float):
        return struct.pack("<Id", 12, v)
    if isinstance(v, str):
        return struct.pack("<I", 8) + text(v)
    return struct.pack("<IIQ", 9, 4, len(v)) + struct.pack(f"<{len(v)}I", *v)


def q8(x):
    """Blocks of 32 with a scale that makes the round trip exact: the values must be whole numbers."""
    b = x.reshape(-1, 32)
    return b"".join(struct.pack("<e", 0.5) + (r * 2).astype("int8").tobytes() for r in b)


def gguf(path, metadata, tensors):
    """tensors: name -> (kind, array)."""
    head, data = b"", b""
    for name, (kind, x) in tensors.items():
        raw = x.astype("<f4").tobytes() if kind == "F32" else q8(x)
        head += text(name) + struct.pack("<I", x.ndim) + struct.pack(f"<{x.ndim}Q", *x.shape[::-1]) + struct.pack("<IQ", KINDS[kind], len(data))
        data += raw + b"\0" * (-len(raw) % 32)
    pairs = b"".join(text(k) + value(v) for k, v in metadata.items())
    start = b"GGUF" + struct.pack("<IQQ", 3, len(tensors), len(metadata)) + pairs + head
    with open(path, "wb") as f:
        f.write(start + b"\0" * (-len(start) % 32) + data)


def model(path, layers=2, hidden=64, heads=4, dim=16, seed=0, extra=()):
    r = np.random.default_rng(seed)
    whole = lambda *s: r.integers(-40, 40, s).astype("float32")
    t = {"token_embd.weight": ("Q8_0", whole(96, hidden)), "output_norm.weight": ("F32", r.normal(size=hidden)), "rope_freqs.weight": ("F32", r.normal(size=8))}
    for i in range(layers):
        t[f"blk.{i}.attn_norm.weight"] = ("F32", r.normal(size=hidden))
        t[f"blk.{i}.attn_q.weight"] = ("Q8_0", whole(heads * dim, hidden))
        t[f"blk.{i}.attn_qkv.weight"] = ("Q8_0", whole(3 * heads * dim, hidden))
    t |= dict(extra)
    gguf(path, {"general.architecture": "toy", "toy.block_count": layers, "toy.embedding_length": hidden, "toy.head_count": heads, "long": list(range(5000)), "some": [1, 2, 3], "flag": True, "eps": 1e-5}, t)
    return {k: x for k, (_, x) in t.items()}


CONFIG = {
    "architecture": {"id": "toy", "gguf_arch": ["toy", "toy2"], "strict_arch": True},
    "dims": {"n_layers": ["gguf:block_count", "ref:num_layers"], "hidden": "gguf:embedding_length", "n_heads": "gguf:head_count", "head_dim": {"div": ["hidden", "n_heads"]}, "vocab": ["gguf:nothing", "tshape:token_embd.weight.0"], "q": {"mul": ["n_heads", "head_dim"]}},
    "rules": [
        {"name": "rope", "match": r"rope_.*", "drop": True},
        {"name": "emb", "match": r"token_embd\.weight", "dest": "model.embed.weight", "expect_shape": ["vocab", "hidden"], "bits": 8, "group_size": 32},
        {"name": "head", "match": r"output\.weight", "dest": "lm_head.weight", "optional": True},
        {"name": "final", "match": r"output_norm\.weight", "dest": "model.norm.weight", "quantize": False, "steps": [{"op": "add", "args": {"value": -1.0}}]},
        {"name": "norm", "match": r"blk\.(?P<n>\d+)\.attn_norm\.weight", "dest": "model.layers.{n}.norm.weight", "quantize": False, "expect_shape": [None]},
        {"name": "q", "match": r"blk\.(?P<n>\d+)\.attn_q\.weight", "dest": "model.layers.{n}.q.weight", "expect_shape": ["q", "hidden"], "steps": [
            {"op": "reshape", "args": {"shape": {"list": ["n_heads", {"div": ["head_dim", 2]}, 2, "hidden"]}}},
            {"op": "permute", "args": {"axes": {"list": [0, 2, 1, 3]}}},
            {"op": "reshape", "args": {"shape": {"list": ["q", "hidden"]}}}]},
        {"name": "qkv", "match": r"blk\.(?P<n>\d+)\.attn_qkv\.weight", "dest": "model.layers.{n}.qkv.weight",
         "inputs": {"qk": {"slice": {"axis": 0, "lo": 0, "hi": {"mul": [2, "q"]}}}, "v": {"slice": {"axis": 0, "lo": {"mul": [2, "q"]}}}},
         "steps": [{"op": "reorder_grouped_heads", "input": "v", "output": "v2", "args": {"axis": 0, "block": 8, "ratio": 2}}, {"op": "concat", "inputs": ["qk", "v2"], "args": {"axis": 0}}]},
    ],
    "coverage": {"per_layer_required": ["model.layers.{layer}.norm.weight"], "per_layer_alternatives": [["model.layers.{layer}.q.weight", "model.layers.{layer}.other.weight"]]},
    "output": {"model_type": "toy", "architectures": ["Toy"], "top_level": {"tie_word_embeddings": {"not": ["has:output.weight"]}}, "text_config": {"hidden_size": "hidden", "num_layers": "n_layers", "rope": ["ref:rope", None], "nested": {"a": "q"}}, "required_fields": ["hidden_size", "rope", "nested.a"], "tokenizer_files": ["tokenizer.json", "tokenizer_config.json"], "max_shard_bytes": 12000},
}


def tokenizer(folder):
    folder.mkdir(exist_ok=True)
    for n in ("tokenizer.json", "tokenizer_config.json"):
        (folder / n).write_text(json.dumps({"a": 1}))
    return str(folder)


def expected(t, name, heads=4, dim=16):
    """What the output must hold, by plain numpy."""
    if name == "model.embed.weight":
        return t["token_embd.weight"]
    if name == "model.norm.weight":
        return t["output_norm.weight"] - 1
    i, what = name.split(".")[2], name.split(".")[3]
    if what == "norm":
        return t[f"blk.{i}.attn_norm.weight"]
    if what == "q":
        x = t[f"blk.{i}.attn_q.weight"]
        return x.reshape(heads, dim // 2, 2, -1).transpose(0, 2, 1, 3).reshape(heads * dim, -1)
    x = t[f"blk.{i}.attn_qkv.weight"]
    qk, v = x[: 2 * heads * dim], x[2 * heads * dim :]
    n = len(v) // 8
    blocks = [v[8 * k : 8 * k + 8] for k in range(n)]
    return np.concatenate([qk, *[blocks[(k % 2) * (n // 2) + k // 2] for k in range(n)]])
