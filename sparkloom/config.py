"""Architecture configurations and quantization profiles: a closed grammar, checked before anything runs.

A configuration is plain data (YAML or JSON).  Every level names the keys it may have; anything else
is an error that says where it stands.  Nothing in a configuration is ever executed.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Any

from .errors import ConfigError
from .operators import tensor as _tensor  # noqa: F401  registers the operators
from .operators.quant import BITS, GROUPS
from .operators.registry import all_ops

ARITHMETIC = ("mul", "add", "sub", "div", "not")
PREFIXES = ("gguf:", "ref:", "tshape:", "has:")
NAME = re.compile(r"[A-Za-z_]\w*", re.A)
SMALL_NAME = re.compile(r"[a-z][a-z0-9_]*")
MAX_PATTERN, MAX_TITLE = 512, 128


@dataclass(frozen=True)
class Cut:
    """A range on one axis; bounds are scalar specs, ``hi`` None means the end."""

    axis: int
    lo: Any = 0
    hi: Any = None


@dataclass(frozen=True)
class Step:
    op: str
    inputs: tuple[str, ...]
    args: Mapping[str, Any] = field(default_factory=dict)
    output: str | None = None


@dataclass(frozen=True)
class Rule:
    match: str
    name: str | None = None
    dest: str | None = None
    drop: bool = False
    optional: bool = False
    quantize: bool = True
    dtype: str = "float32"
    expect_shape: tuple[Any, ...] | None = None
    slots: Mapping[str, Cut | None] = field(default_factory=lambda: {"x": None})
    steps: tuple[Step, ...] = ()
    bits: int | None = None
    group_size: int | None = None
    block_range: tuple[Any, Any] | None = None

    @property
    def title(self) -> str:
        return self.name or self.match


@dataclass(frozen=True)
class Output:
    model_type: str | None = None
    architectures: tuple[str, ...] = ()
    nest_config_under: str | None = None
    top_level: Mapping[str, Any] = field(default_factory=dict)
    text_config: Mapping[str, Any] = field(default_factory=dict)
    drop_fields: tuple[str, ...] = ()
    tokenizer_files: tuple[str, ...] = ()
    max_shard_bytes: int = 4 << 30
    required_fields: tuple[str, ...] = ()


@dataclass(frozen=True)
class Config:
    id: str
    accepted: tuple[str, ...] | None
    strict: bool
    dims: Mapping[str, Any]
    rules: tuple[Rule, ...]
    required: tuple[str, ...] = ()
    alternatives: tuple[tuple[str, ...], ...] = ()
    output: Output = Output()
    unmatched: str = "error"
    description: str = ""
    aliases: tuple[str, ...] = ()

    def accepts(self, arch: str | None) -> bool:
        """Aliases are documentation; only the identifiers of ``gguf_arch`` count, and none means any."""
        return self.accepted is None or arch in self.accepted


def fail(where: str, what: str):
    raise ConfigError(f"{where}: {what}")


def closed(raw: Any, where: str, keys: str, needed: str = "") -> dict:
    """A mapping that has all of ``needed`` and nothing beyond ``keys``."""
    if not isinstance(raw, dict):
        fail(where, "must be a mapping")
    if odd := sorted(set(map(str, raw)) - set(keys.split())):
        fail(where, f"unknown keys {odd}")
    if gone := sorted(set(needed.split()) - set(raw)):
        fail(where, f"missing {gone}")
    return raw


def list_of(raw: Any, where: str, fits: Callable[[Any], bool] = lambda x: isinstance(x, str)) -> tuple:
    if not isinstance(raw, (list, tuple)) or not all(map(fits, raw)):
        fail(where, "must be a list of the right kind")
    return tuple(raw)


def scalar(spec: Any, where: str) -> Any:
    """A value or how to find it: prefix forms, names of dimensions, chains, arithmetic, nested mappings."""
    if spec is None or isinstance(spec, (bool, int, float)):
        return spec
    if isinstance(spec, str):
        prefix = next((p for p in PREFIXES if spec.startswith(p)), None)
        if prefix and len(spec) == len(prefix):
            fail(where, f"{spec!r} refers to nothing")
        if not prefix and not NAME.fullmatch(spec):
            fail(where, f"{spec!r} is neither a reference nor a name")
    elif isinstance(spec, list):
        for i, x in enumerate(spec):
            scalar(x, f"{where}[{i}]")
    elif isinstance(spec, dict):
        only = next(iter(spec)) if len(spec) == 1 else None
        if only == "list" or only in ARITHMETIC:
            if not isinstance(spec[only], list) or not spec[only]:
                fail(where, f"{only} takes a list of one value or more")
            scalar(spec[only], where)
        else:
            for k, x in spec.items():
                if k in ARITHMETIC:
                    fail(f"{where}.{k}", "arithmetic must stand alone in its mapping")
                scalar(x, f"{where}.{k}")
    else:
        fail(where, f"a {type(spec).__name__} is no value")
    return spec


def _choice(raw: Any, among: tuple[int, ...], where: str) -> int | None:
    if raw is not None and (isinstance(raw, bool) or raw not in among):
        fail(where, f"must be one of {among}, not {raw!r}")
    return raw


def _cut(raw: Any, where: str) -> Cut:
    c = closed(raw, where, "axis lo hi", "axis")
    if not isinstance(c["axis"], int):
        fail(where, "axis must be a number")
    return Cut(c["axis"], scalar(c.get("lo", 0), f"{where}.lo"), scalar(c.get("hi"), f"{where}.hi"))


def _slots(raw: Any, where: str) -> dict[str, Cut | None]:
    if not isinstance(raw, dict) or not raw:
        fail(where, "must be a mapping of one slot or more")
    out: dict[str, Cut | None] = {}
    for name, slot in raw.items():
        if not SMALL_NAME.fullmatch(str(name)):
            fail(where, f"{name!r} can't name a slot")
        s = {} if slot == "@" else closed(slot, f"{where}.{name}", "source slice")
        if s.get("source", "@") != "@":
            fail(f"{where}.{name}", "the source of a slot is the matched tensor, '@'")
        out[name] = _cut(s["slice"], f"{where}.{name}.slice") if s.get("slice") else None
    return out


def _steps(raw: Any, where: str, slots: Mapping[str, Any] | None) -> tuple[Step, ...]:
    if not isinstance(raw, list):
        fail(where, "must be a list")
    known, before, out = {*(slots or ()), "x", "_"}, None if slots else "x", []
    for i, one in enumerate(raw):
        at = f"{where}[{i}]"
        s = closed(one, at, "op input inputs args output", "op")
        if s["op"] not in all_ops():
            fail(at, f"no operator is called {s['op']!r}")
        if not isinstance(s.get("args", {}), dict):
            fail(at, "args must be a mapping")
        if s.get("inputs") and s.get("input") is not None:
            fail(at, "has both input and inputs")
        names = tuple(map(str, s.get("inputs") or [s.get("input") or before]))
        if names == ("None",):
            fail(at, "must name its input")
        if odd := [n for n in names if n not in known]:
            fail(at, f"nothing before is called {odd}")
        name = s.get("output")
        if name is not None and not SMALL_NAME.fullmatch(str(name)):
            fail(at, f"{name!r} can't name an output")
        out.append(Step(s["op"], names, s.get("args", {}), name))
        known |= {name} - {None}
        before = None if s.get("inputs") else "_"
    return tuple(out)


def _pattern(raw: Any, where: str) -> str:
    if not isinstance(raw, str) or not raw:
        fail(where, "match must be a pattern")
    tries = (re.sub(r"\{[A-Za-z_]\w*\}", "0", raw), raw)
    problems = []
    for t in tries:
        try:
            re.compile(t)
            return raw
        except re.error as e:
            problems.append(e)
    return fail(where, f"match is no regular expression: {problems[0]}")


def _rule(raw: Any, where: str) -> Rule:
    r = closed(raw, where, "name match dest drop optional quantize dtype expect_shape inputs steps range bits group_size", "match")
    match, drop, quantize = _pattern(r["match"], where), bool(r.get("drop")), bool(r.get("quantize", True))
    if drop != (r.get("dest") is None) or not drop and not (isinstance(r["dest"], str) and r["dest"]):
        fail(where, "a rule either drops tensors or has a dest")
    if r.get("name") is not None and not isinstance(r["name"], str):
        fail(where, "name must be a text")
    span = None
    if "range" in r:
        b = closed(r["range"], f"{where}.range", "start end", "start end")
        if not drop or "{i}" not in match:
            fail(where, "a range needs a drop rule whose match has {i}")
        span = scalar(b["start"], f"{where}.range.start"), scalar(b["end"], f"{where}.range.end")
    elif drop and "{i}" in match:
        fail(where, "{i} is reserved for rules with a range")
    bits, group = _choice(r.get("bits"), BITS, f"{where}.bits"), _choice(r.get("group_size"), GROUPS, f"{where}.group_size")
    if (bits or group) and not quantize:
        fail(where, "bits and group_size need a quantized rule")
    if r.get("dtype", "float32") not in ("float32", "float16"):
        fail(where, f"unknown dtype {r['dtype']!r}")
    expect = r.get("expect_shape")
    if expect is not None:
        scalar(list(list_of(expect, f"{where}.expect_shape", lambda x: True)), f"{where}.expect_shape")
    slots = _slots(r["inputs"], f"{where}.inputs") if r.get("inputs") else None
    steps = _steps(r.get("steps") or [], f"{where}.steps", slots)
    return Rule(match, r.get("name"), r.get("dest"), drop, bool(r.get("optional")), quantize, r.get("dtype", "float32"), None if expect is None else tuple(expect), slots or {"x": None}, steps, bits, group, span)


def _output(raw: Any) -> Output:
    o = closed({} if raw is None else raw, "output", "model_type architectures nest_config_under top_level text_config reference_config tokenizer_files max_shard_bytes required_fields")
    reference = closed(o.get("reference_config", {}), "output.reference_config", "drop_fields")
    for part in ("top_level", "text_config"):
        if not isinstance(o.get(part, {}), dict):
            fail(f"output.{part}", "must be a mapping")
    for k, v in o.get("text_config", {}).items():
        scalar(v, f"output.text_config.{k}")
    most = int(o.get("max_shard_bytes", 4 << 30))
    if most <= 0:
        fail("output.max_shard_bytes", "must be positive")
    texts = lambda k, of=o: list_of(of.get(k, []), f"output.{k}")
    fields = list_of(o.get("required_fields", []), "output.required_fields", lambda x: isinstance(x, str) and x)
    return Output(o.get("model_type"), texts("architectures"), o.get("nest_config_under"), o.get("top_level", {}), o.get("text_config", {}), texts("drop_fields", reference), texts("tokenizer_files"), most, fields)


def parse(raw: Any, where: str = "config") -> Config:
    c = closed(raw, where, "architecture dims rules coverage output unmatched_tensors", "architecture rules")
    a = closed(c["architecture"], "architecture", "id aliases gguf_arch strict_arch description", "id")
    accepted = a.get("gguf_arch")
    if accepted is not None:
        accepted = list_of([accepted] if isinstance(accepted, str) else accepted, "architecture.gguf_arch", lambda x: isinstance(x, str) and x)
        if not accepted:
            fail("architecture.gguf_arch", "must not be an empty list")
    dims = c.get("dims", {})
    if not isinstance(dims, dict):
        fail("dims", "must be a mapping")
    for name, spec in dims.items():
        if not re.fullmatch(r"[a-z_][a-z0-9_]*", str(name)):
            fail("dims", f"{name!r} can't name a dimension")
        scalar(spec, f"dims.{name}")
    if not isinstance(c["rules"], list) or not c["rules"]:
        fail("rules", "must be a list of one rule or more")
    rules = tuple(_rule(r, f"rules[{i}]") for i, r in enumerate(c["rules"]))
    names = [r.name for r in rules if r.name]
    if len(set(names)) < len(names):
        fail("rules", "a name occurs twice")
    cover = closed(c.get("coverage", {}), "coverage", "per_layer_required per_layer_alternatives")
    needed = list_of(cover.get("per_layer_required", []), "coverage.per_layer_required")
    groups = tuple(list_of(g, "coverage.per_layer_alternatives", lambda x: isinstance(x, str)) for g in cover.get("per_layer_alternatives", []))
    if not all(groups):
        fail("coverage.per_layer_alternatives", "a group must not be empty")
    if (policy := c.get("unmatched_tensors", "error")) not in ("error", "warn"):
        fail("unmatched_tensors", "must be error or warn")
    return Config(str(a["id"]), accepted, bool(a.get("strict_arch")), dims, rules, needed, groups, _output(c.get("output")), policy, str(a.get("description", "")), tuple(map(str, a.get("aliases", ()))))


def load(path: str | Path) -> Config:
    """A YAML (or JSON) configuration."""
    try:
        import yaml

        return parse(yaml.safe_load(Path(path).read_text("utf-8")), str(path))
    except ImportError:
        return parse(_json(path), str(path))
    except OSError as e:
        raise ConfigError(f"{path}: {e}") from e
    except yaml.YAMLError as e:
        raise ConfigError(f"{path}: {e}") from e


def _json(path: str | Path) -> Any:
    try:
        return json.loads(Path(path).read_text("utf-8"))
    except (OSError, ValueError) as e:
        raise ConfigError(f"{path}: {e}") from e


def discover(folders: list[str | Path]) -> dict[str, Path]:
    """Configurations by name; an earlier folder wins."""
    found: dict[str, Path] = {}
    for folder in folders:
        for p in sorted(Path(folder).glob("*.y*ml")):
            found.setdefault(p.stem, p)
    return found


def resolve_config(folders: list[str | Path], name: str | None = None, arch: str | None = None) -> Config:
    """By name, by path, or the only one that accepts the architecture identifier; files come before what is built in."""
    from .architectures import BUILT_IN

    known: dict[str, Callable[[], Config]] = {k: lambda f=f: parse(f(), k) for k, f in BUILT_IN.items()}
    known |= {k: lambda p=p: load(p) for k, p in discover(folders).items()}
    if name is not None:
        if name in known:
            return known[name]()
        if Path(name).is_file():
            return load(name)
        raise ConfigError(f"no configuration is called {name!r}; there are {sorted(known)}")
    fits = [c for c in (get() for get in known.values()) if c.accepted is not None and c.accepts(arch)]
    if len(fits) != 1:
        raise ConfigError(f"{len(fits)} configurations accept the architecture {arch!r}")
    return fits[0]


@dataclass(frozen=True)
class Profile:
    """Overlays (pattern, bits, group) in order, and defaults for a whole conversion."""

    name: str
    bits: int | None = None
    group_size: int | None = None
    overlays: tuple[tuple[str, int | None, int | None], ...] = ()


def _setting(raw: Any, where: str, keys: str) -> tuple[int | None, int | None]:
    s = closed(raw, where, keys)
    if s.get("bits") is None and s.get("group_size") is None:
        fail(where, "must set bits or group_size")
    return _choice(s.get("bits"), BITS, f"{where}.bits"), _choice(s.get("group_size"), GROUPS, f"{where}.group_size")


def parse_profile(raw: Any, where: str = "profile") -> Profile:
    p = closed(raw, where, "name default rules", "name")
    if not isinstance(p["name"], str) or not p["name"].strip() or len(p["name"]) > MAX_TITLE:
        fail(where, f"name must be a text of 1 to {MAX_TITLE} characters")
    defaults = _setting(p["default"], f"{where}.default", "bits group_size") if "default" in p else (None, None)
    overlays = []
    if not isinstance(p.get("rules", []), list):
        fail(where, "rules must be a list")
    for i, r in enumerate(p.get("rules", [])):
        at = f"{where}.rules[{i}]"
        match = closed(r, at, "match bits group_size", "match")["match"]
        if not isinstance(match, str) or not match.strip() or len(match) > MAX_PATTERN:
            fail(at, f"match must be a pattern of 1 to {MAX_PATTERN} characters")
        overlays.append((_pattern(match, at), *_setting(r, at, "match bits group_size")))
    return Profile(p["name"], *defaults, tuple(overlays))


def load_profile(path: str | Path) -> Profile:
    return parse_profile(_json(path), str(path))


def overlay(config: Config, profile: Profile) -> tuple[Config, dict[str, tuple[int | None, int | None]], list[str]]:
    """The configuration under a profile, what changed by rule, and the patterns that met no quantized rule.

    The first overlay found anywhere in a rule's dest counts; what it leaves out stays as the rule has it.
    """
    rules, changed, met = [], {}, set()
    for rule in config.rules:
        hit = next((o for o in profile.overlays if rule.quantize and not rule.drop and re.search(o[0], rule.dest or "")), None)
        if hit:
            met.add(hit[0])
            rule = replace(rule, bits=rule.bits if hit[1] is None else hit[1], group_size=rule.group_size if hit[2] is None else hit[2])
            changed[rule.title] = rule.bits, rule.group_size
        rules.append(rule)
    return replace(config, rules=tuple(rules)), changed, [o[0] for o in profile.overlays if o[0] not in met]


def conversion_setting(asked: Any, default: int | None, what: str) -> Any:
    """A profile's default stands in for nothing or ``auto``; beside a number it is a conflict."""
    if default is None:
        return asked
    if isinstance(asked, int):
        raise ConfigError(f"{what} {asked} conflicts with the profile's default {default}")
    return default
