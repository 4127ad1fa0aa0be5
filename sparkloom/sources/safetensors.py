"""Folders of safetensors files as (key, row, data): one partition per tensor and range of rows.

A tensor's rows are its last axis; ``data`` holds a row's bytes in the stored type.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Sequence
from dataclasses import dataclass
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import SourceError, VerifyError
from . import files

INDEX, SINGLE = "model.safetensors.index.json", "model.safetensors"
# numpy's layout of the stored types.
DTYPES = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "BF16": "<u2", "I64": "<i8", "I32": "<i4", "I16": "<i2", "I8": "i1", "U64": "<u8", "U32": "<u4", "U16": "<u2", "U8": "u1", "BOOL": "?"}
KEYS = "shard string, key string, dtype string, shape array<bigint>, n_bytes bigint"


@dataclass(frozen=True)
class Stored:
    shard: str
    key: str
    dtype: str
    shape: tuple[int, ...]
    offset: int

    @property
    def width(self) -> int:
        return self.shape[-1] if self.shape else 1

    @property
    def rows(self) -> int:
        return prod(self.shape[:-1])

    @property
    def row_bytes(self) -> int:
        return self.width * np.dtype(DTYPES[self.dtype]).itemsize


def header(folder: str, shard: str) -> list[Stored]:
    path = f"{folder.rstrip('/')}/{shard}"
    total = files.size_of(path)
    if total is None or total < 8:
        raise SourceError(f"{path} is no safetensors file")
    (n,) = struct.unpack("<Q", files.read(path, 0, 8))
    if 8 + n > total:
        raise SourceError(f"{path} ends inside its header")
    found = json.loads(files.read(path, 8, n))
    return [Stored(shard, k, v["dtype"], tuple(v["shape"]), 8 + n + v["data_offsets"][0]) for k, v in found.items() if k != "__metadata__"]


def shards(folder: str) -> list[str]:
    return [f for f in files.listing(folder) if f.endswith(".safetensors")]


def stored(folder: str) -> list[Stored]:
    """All tensors of all shards."""
    found = [s for f in shards(folder) for s in header(folder, f)]
    if not found:
        raise SourceError(f"{folder} has no safetensors file")
    return found


def load_index(folder: str) -> dict[str, str]:
    """key -> shard, from the index or else from the only file."""
    index = f"{folder.rstrip('/')}/{INDEX}"
    if (size := files.size_of(index)) is not None:
        return json.loads(files.read(index, 0, size))["weight_map"]
    if files.size_of(f"{folder.rstrip('/')}/{SINGLE}") is None:
        raise VerifyError(f"{folder} has neither {INDEX} nor {SINGLE}")
    return {s.key: SINGLE for s in header(folder, SINGLE)}


def index_frame(spark: SparkSession, folder: str) -> DataFrame:
    """(key, shard) as the index has it."""
    return spark.createDataFrame(list(load_index(folder).items()), "key string, shard string")


def keys_frame(spark: SparkSession, folder: str) -> DataFrame:
    """What the shards really hold."""
    rows = [(s.shard, s.key, s.dtype, list(s.shape), s.rows * s.row_bytes) for f in shards(folder) for s in header(folder, f)]
    return spark.createDataFrame(rows, KEYS)


@dataclass
class _Range(InputPartition):
    path: str
    tensor: Stored
    lo: int
    hi: int


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.folder, keys = options["path"], options.get("keys")
        self.keys = None if keys is None else set(json.loads(keys))

    def partitions(self):
        return [_Range(f"{self.folder.rstrip('/')}/{t.shard}", t, a, b) for t in stored(self.folder) if self.keys is None or t.key in self.keys for a, b in files.splits(t.rows, t.row_bytes)]

    def read(self, p: _Range):
        t, step = p.tensor, max(1, (8 << 20) // max(1, p.tensor.row_bytes))
        for a in range(p.lo, p.hi, step):
            b = min(p.hi, a + step)
            data = files.read(p.path, t.offset + a * t.row_bytes, (b - a) * t.row_bytes)
            rows = [data[k * t.row_bytes : (k + 1) * t.row_bytes] for k in range(b - a)]
            yield pa.RecordBatch.from_arrays([pa.array([t.key] * (b - a)), pa.array([t.dtype] * (b - a)), pa.array(range(a, b), pa.int64()), pa.array(rows, pa.binary())], ["key", "dtype", "row", "data"])


class SafetensorsSource(DataSource):
    @classmethod
    def name(cls):
        return "safetensors"

    def schema(self):
        return "key string, dtype string, row bigint, data binary"

    def reader(self, schema):
        return _Reader(self.options)


def read(spark: SparkSession, folder: str, keys: Sequence[str] | None = None) -> DataFrame:
    """(key, dtype, row, data) of all tensors or of those named; nothing else is read."""
    spark.dataSource.register(SafetensorsSource)
    reader = spark.read.format("safetensors")
    return (reader if keys is None else reader.option("keys", json.dumps(list(keys)))).load(folder)


def as_numbers(rows: DataFrame) -> DataFrame:
    """(key, dtype, row, values): doubles, from any stored type."""

    def run(batches):
        for b in batches:
            out = []
            for kind, data in zip(b.column("dtype").to_pylist(), b.column("data").to_pylist(), strict=True):
                x = np.frombuffer(data, DTYPES[kind])
                out.append((x.astype("uint32") << 16).view("float32").astype("float64") if kind == "BF16" else x.astype("float64"))
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("dtype"), b.column("row"), pa.array(out, pa.list_(pa.float64()))], ["key", "dtype", "row", "values"])

    return rows.mapInArrow(run, "key string, dtype string, row bigint, values array<double>")


def tensor(spark: SparkSession, folder: str, key: str) -> DataFrame:
    """One tensor; a key that isn't there is an error."""
    if key not in {s.key for s in stored(folder)}:
        raise VerifyError(f"{folder} has no tensor {key!r}")
    return read(spark, folder, [key])
