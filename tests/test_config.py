import copy
import json

import pytest
from model_files import CONFIG

from sparkloom import config
from sparkloom.errors import ConfigError, PlanError
from sparkloom.plans.resolve import Resolver, java_pattern, with_dims


def broken(path, value):
    raw = copy.deepcopy(CONFIG)
    node = raw
    for k in path[:-1]:
        node = node[k]
    node[path[-1]] = value
    return raw


@pytest.mark.parametrize("raw", [
    [], {}, {"architecture": {"id": "x"}, "rules": []}, broken(["extra"], 1), broken(["architecture", "odd"], 1), broken(["architecture", "gguf_arch"], []), broken(["dims", "Bad"], 1),
    broken(["dims", "x"], {"mul": []}), broken(["dims", "x"], {"mul": [1], "add": [1]}), broken(["dims", "x"], "gguf:"), broken(["dims", "x"], "a b"), broken(["dims", "x"], {"list": []}),
    broken(["rules", 0, "dest"], "x"), broken(["rules", 1, "dest"], None), broken(["rules", 1, "match"], "("), broken(["rules", 1, "match"], ""), broken(["rules", 1, "bits"], 5), broken(["rules", 1, "bits"], True),
    broken(["rules", 3, "bits"], 4), broken(["rules", 1, "group_size"], 48), broken(["rules", 1, "dtype"], "bfloat16"), broken(["rules", 1, "name"], "q"), broken(["rules", 1, "range"], {"start": 0, "end": 1}),
    broken(["rules", 0, "match"], r"blk\.{i}"), broken(["rules", 0, "range"], {"start": 0, "end": 1}), broken(["rules", 3, "steps", 0, "op"], "nothing"), broken(["rules", 3, "steps", 0, "odd"], 1),
    broken(["rules", 6, "steps", 0, "input"], "w"), broken(["rules", 6, "inputs", "V"], "@"), broken(["rules", 6, "inputs", "v"], {"source": "other"}), broken(["rules", 6, "inputs", "v"], {"slice": {"lo": 1}}),
    broken(["rules", 6, "steps", 1, "input"], "v"), broken(["unmatched_tensors"], "ignore"), broken(["coverage", "odd"], []), broken(["coverage", "per_layer_alternatives"], [[]]), broken(["output", "odd"], 1),
    broken(["output", "max_shard_bytes"], 0), broken(["output", "required_fields"], [""]), broken(["rules", 5, "expect_shape"], "x"),
])
def test_grammar_is_closed(raw):
    with pytest.raises(ConfigError):
        config.parse(raw)


def test_files_and_discovery(tmp_path):
    import yaml

    for name, arch in (("a", "one"), ("b", ["two", "three"])):
        raw = copy.deepcopy(CONFIG)
        raw["architecture"] = {"id": name, "gguf_arch": arch, "aliases": ["alias"]}
        (tmp_path / f"{name}.yaml").write_text(yaml.safe_dump(raw))
    assert config.resolve_config([tmp_path], "a").id == "a" and config.resolve_config([tmp_path], arch="three").id == "b"
    assert config.resolve_config([], str(tmp_path / "b.yaml")).id == "b"
    for how in ({"name": "c"}, {"arch": "alias"}):
        with pytest.raises(ConfigError):
            config.resolve_config([tmp_path], **how)
    (tmp_path / "bad.yaml").write_text("!!python/object/apply:os.system ['true']")
    with pytest.raises(ConfigError):
        config.load(tmp_path / "bad.yaml")


def test_profiles(tmp_path):
    c = config.parse(CONFIG)
    (tmp_path / "p.json").write_text(json.dumps({"name": "p", "default": {"bits": 4}, "rules": [{"match": "embed", "bits": 3}, {"match": "layers", "group_size": 32}, {"match": "never", "bits": 2}, {"match": "norm", "bits": 2}]}))
    p = config.load_profile(tmp_path / "p.json")
    laid, changed, idle = config.overlay(c, p)
    of = {r.name: (r.bits, r.group_size) for r in laid.rules}
    assert of["emb"] == (3, 32) and of["q"] == (None, 32) and of["norm"] == (None, None) and idle == ["never", "norm"] and changed["emb"] == (3, 32)
    assert config.conversion_setting("auto", p.bits, "bits") == 4 and config.conversion_setting(None, None, "bits") is None
    with pytest.raises(ConfigError):
        config.conversion_setting(8, p.bits, "bits")
    for bad in ({}, {"name": " "}, {"name": "x" * 129}, {"name": "x", "odd": 1}, {"name": "x", "rules": [{"match": "a"}]}, {"name": "x", "rules": [{"match": "(", "bits": 4}]}, {"name": "x", "rules": [{"match": "a" * 513, "bits": 4}]}, {"name": "x", "default": {}}, {"name": "x", "default": {"bits": 5}}):
        with pytest.raises(ConfigError):
            config.parse_profile(bad)


def test_scalar_specs():
    r = Resolver({"a.n": 8, "n": None, "k": 3}, {"t.w": (4, 6)}, {"x": {"y": 5, "z": None}}, "a")
    v = lambda s, **d: r.value(s, "here", d)
    assert v("gguf:n") == 8 and v("ref:x.y") == 5 and v("tshape:t.w.-1") == 6 and v("has:t.w") is True and v("has:u") is False
    assert v({"mul": [2, "d", 3]}, d=4) == 24 and v({"div": [7, 2]}) == 3.5 and v({"div": [8, 2, 2]}) == 2 and isinstance(v({"div": [8, 2]}), int) and v({"sub": [9, 4, 1]}) == 4 and v({"not": [False, 1]}) is True
    assert v(["gguf:gone", "ref:x.y"]) == 5 and v([None, 3]) is None and v(["ref:x.z", 1]) is None and v("plain") == "plain" and v({"list": [1, "d"]}, d=2) == [1, 2] and v({"a": {"b": "d"}}, d=1) == {"a": {"b": 1}}
    for bad in ("gguf:gone", "ref:x.q", "tshape:t.w.2", "tshape:t.w.q", "tshape:u.0", ["gguf:gone"], {"add": ["word", 1]}, {"div": [1, 0]}):
        with pytest.raises(PlanError):
            v(bad)
    assert r.dims({"a": 2, "b": {"mul": ["a", 3]}}) == {"a": 2, "b": 6}
    for bad in ({"a": "wrod"}, {"a": True}, {"a": {"list": [1]}}):
        with pytest.raises(PlanError):
            r.dims(bad)
    assert with_dims(r"b\.{n}\.{i}", {"n": 3}, "x") == r"b\.3\.{i}" and java_pattern(r"(?P<a_b>\d)x(?P=a_b)") == r"^(?:(\d)x\1)$"
