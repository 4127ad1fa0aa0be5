"""The registered tensor operators: name, kind and shape rule."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from ..errors import PlanError

KINDS = ("elementwise", "shape", "combine", "permute")


@dataclass(frozen=True)
class Operator:
    name: str
    kind: str
    apply: Callable
    infer: Callable

    @property
    def chunk_safe(self) -> bool:
        return self.kind == "elementwise"


_REGISTERED: dict[str, Operator] = {}


def tensor_op(name: str, kind: str, infer: Callable):
    """Register a function (inputs, args, dims) -> TensorFrame; ``infer`` maps (shapes, args, dims) to a shape."""
    if kind not in KINDS:
        raise PlanError(f"unknown kind of operator: {kind}")

    def put(f):
        if name in _REGISTERED:
            raise PlanError(f"operator {name} is registered twice")
        _REGISTERED[name] = Operator(name, kind, f, infer)
        return f

    return put


def get_op(name: str) -> Operator:
    if name not in _REGISTERED:
        raise PlanError(f"no operator is called {name}; there are {', '.join(all_ops())}")
    return _REGISTERED[name]


def all_ops() -> list[str]:
    return sorted(_REGISTERED)


def infer(name: str, shapes, args=None, dims=None):
    """Shape of the result; raises ``PlanError`` before any data is touched."""
    return tuple(get_op(name).infer([tuple(s) for s in shapes], args or {}, dims or {}))


def apply(name: str, inputs, args=None, dims=None):
    """Check the shapes, then build the operator's plan on ``inputs`` (TensorFrames)."""
    infer(name, [t.shape for t in inputs], args, dims)
    return get_op(name).apply(list(inputs), args or {}, dims or {})
