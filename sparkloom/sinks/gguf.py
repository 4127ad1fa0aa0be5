"""Writes small model files: plain floats, half floats and 8-bit blocks, with a table of metadata."""

from __future__ import annotations

import struct
from collections.abc import Mapping
from typing import Any

import numpy as np

from ..errors import ConversionError
from ..sources.blocks import TYPES
from ..sources.gguf import ALIGNMENT, MAGIC
from .sharded import put

NUMBERS = {name: number for number, (name, _, _) in TYPES.items()}


def _text(s: str) -> bytes:
    return struct.pack("<Q", len(s.encode())) + s.encode()


def _value(v: Any) -> bytes:
    # Numbers of the value kinds.
    if isinstance(v, bool):
        return struct.pack("<I?", 7, v)
    if isinstance(v, int):
        return struct.pack("<Iq", 11, v)
    if isinstance(v, float):
        return struct.pack("<Id", 12, v)
    if isinstance(v, str):
        return struct.pack("<I", 8) + _text(v)
    return struct.pack("<IIQ", 9, 11, len(v)) + np.asarray(v, "<i8").tobytes()


def encode(kind: str, x: np.ndarray) -> bytes:
    """Bytes of a tensor; 8-bit blocks get the largest magnitude over 127 as their scale, as a half float."""
    if kind in ("F32", "F16"):
        return x.astype({"F32": "<f4", "F16": "<f2"}[kind]).tobytes()
    if kind != "Q8_0" or x.shape[-1] % 32:
        raise ConversionError(f"{x.shape} can't be written as {kind}")
    blocks = x.reshape(-1, 32).astype("float64")
    scale = (np.abs(blocks).max(1, keepdims=True) / 127).astype("<f2")
    codes = np.rint(blocks / np.where(scale == 0, 1, scale).astype("float64")).clip(-127, 127).astype("int8")
    return np.concatenate([scale.view("u1"), codes.view("u1")], axis=1).tobytes()


def write(folder: str, name: str, metadata: Mapping[str, Any], tensors: Mapping[str, tuple[str, np.ndarray]]) -> None:
    """``tensors``: name -> (type, array, outermost axis first)."""
    head, data = b"", b""
    for key, (kind, x) in tensors.items():
        head += _text(key) + struct.pack(f"<I{x.ndim}QIQ", x.ndim, *x.shape[::-1], NUMBERS[kind], len(data))
        raw = encode(kind, x)
        data += raw + bytes(-len(raw) % ALIGNMENT)
    start = MAGIC + struct.pack("<IQQ", 3, len(tensors), len(metadata)) + b"".join(_text(k) + _value(v) for k, v in metadata.items()) + head
    put(folder, name, start + bytes(-len(start) % ALIGNMENT) + data)
