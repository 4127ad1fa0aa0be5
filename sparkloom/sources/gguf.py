"""Model files in GGUF layout as a Spark data source.

``spark.read.format("gguf").load(path)`` gives (name, row, values): a partition per tensor and range of
rows, decoded where it is read.  The options ``names``, ``lo`` and ``hi`` leave out partitions before
anything is read.  The header alone (metadata and the table of tensors) is read on the driver.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Sequence
from dataclasses import dataclass
from math import prod
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import SourceError
from . import blocks, files

MAGIC, ALIGNMENT = b"GGUF", 32
#: Arrays of metadata longer than this stand in the result as a remark.
MAX_ARRAY = 4096
# Layout of the scalar metadata types by number.
SCALARS = {0: "<B", 1: "<b", 2: "<H", 3: "<h", 4: "<I", 5: "<i", 6: "<f", 7: "<?", 10: "<Q", 11: "<q", 12: "<d"}
STRING, ARRAY = 8, 9
ROWS = "name string, row bigint, values array<float>"
CATALOGUE = "name string, ne array<bigint>, hf_shape array<bigint>, qtype string, n_elements bigint, n_bytes bigint, data_offset bigint"


@dataclass(frozen=True)
class Tensor:
    name: str
    ne: tuple[int, ...]
    qtype: str
    offset: int

    @property
    def shape(self) -> tuple[int, ...]:
        return self.ne[::-1]

    @property
    def quantized(self) -> bool:
        return self.qtype not in blocks.UNQUANTIZED

    @property
    def n_elements(self) -> int:
        return prod(self.ne)

    @property
    def rows(self) -> int:
        return prod(self.ne[1:])

    @property
    def row_bytes(self) -> int:
        return blocks.row_bytes(self.qtype, self.ne[0])

    @property
    def n_bytes(self) -> int:
        return self.rows * self.row_bytes


class _Cursor:
    """Reads a header in order; fetches the file in growing pieces."""

    def __init__(self, path: str):
        self.path, self.size, self.data, self.at = path, files.size_of(path), b"", 0
        if self.size is None:
            raise SourceError(f"{path} is no file")

    def take(self, n: int) -> bytes:
        if self.at + n > self.size:
            raise SourceError(f"{self.path} ends inside its header")
        while self.at + n > len(self.data):
            more = max(1 << 20, len(self.data), self.at + n - len(self.data))
            self.data += files.read(self.path, len(self.data), min(more, self.size - len(self.data)))
        self.at += n
        return self.data[self.at - n : self.at]

    def scalar(self, layout: str) -> Any:
        return struct.unpack(layout, self.take(struct.calcsize(layout)))[0]

    def text(self) -> str:
        return self.take(self.scalar("<Q")).decode("utf-8", "replace")

    def value(self, kind: int) -> Any:
        if kind == STRING:
            return self.text()
        if kind == ARRAY:
            inner, n = self.scalar("<I"), self.scalar("<Q")
            if inner in SCALARS:
                layout = SCALARS[inner]
                data = self.take(n * struct.calcsize(layout))
                if n <= MAX_ARRAY:
                    return list(struct.unpack(f"<{n}{layout[1]}", data))
            else:
                got = [x for i in range(n) for x in [self.value(inner)] if i < MAX_ARRAY]
                if n <= MAX_ARRAY:
                    return got
            return f"<array of {n}>"
        if kind not in SCALARS:
            raise SourceError(f"{self.path} has metadata of an unknown type {kind}")
        return self.scalar(SCALARS[kind])


@dataclass(frozen=True)
class Header:
    path: str
    metadata: dict[str, Any]
    tensors: tuple[Tensor, ...]

    @property
    def arch(self) -> str | None:
        return self.metadata.get("general.architecture")

    def shapes(self) -> dict[str, tuple[int, ...]]:
        return {t.name: t.shape for t in self.tensors}


def read_header(path: str) -> Header:
    c = _Cursor(path)
    if c.take(4) != MAGIC:
        raise SourceError(f"{path} doesn't begin as a GGUF file")
    version, n_tensors, n_pairs = c.scalar("<I"), c.scalar("<Q"), c.scalar("<Q")
    if version not in (2, 3):
        raise SourceError(f"{path} has the unknown version {version}")
    metadata = {}
    for _ in range(n_pairs):
        key = c.text()
        metadata[key] = c.value(c.scalar("<I"))
    found = []
    for _ in range(n_tensors):
        name = c.text()
        ne = tuple(c.scalar("<Q") for _ in range(c.scalar("<I")))
        kind, offset = c.scalar("<I"), c.scalar("<Q")
        if kind not in blocks.TYPES:
            raise SourceError(f"tensor {name!r} has an unknown type {kind}")
        found.append((name, ne, blocks.TYPES[kind][0], offset))
    if len({f[0] for f in found}) < len(found):
        raise SourceError(f"{path} names a tensor twice")
    align = int(metadata.get("general.alignment", ALIGNMENT))
    start = -(-c.at // align) * align
    tensors = tuple(Tensor(n, ne, q, start + o) for n, ne, q, o in found)
    if late := [t.name for t in tensors if t.offset + t.n_bytes > c.size]:
        raise SourceError(f"{path} ends inside the data of {late[:3]}")
    return Header(path, metadata, tensors)


def catalogue(spark: SparkSession, header: Header) -> DataFrame:
    rows = [(t.name, list(t.ne), list(t.shape), t.qtype, t.n_elements, t.n_bytes, t.offset) for t in header.tensors]
    return spark.createDataFrame(rows, CATALOGUE)


def metadata_frame(spark: SparkSession, header: Header) -> DataFrame:
    """(key, kind, value as text)."""
    return spark.createDataFrame([(k, type(v).__name__, str(v)) for k, v in header.metadata.items()], "key string, kind string, value string")


@dataclass
class _Range(InputPartition):
    path: str
    tensor: Tensor
    lo: int
    hi: int


class _Reader(DataSourceReader):
    """Tensors and rows to read come as options: filters pushed to scans of one table would be shared by all of them."""

    def __init__(self, options):
        self.path, names = options["path"], options.get("names")
        self.names = None if names is None else set(json.loads(names))
        self.lo, self.hi = int(options.get("lo", 0)), int(options.get("hi", -1))
        self.books = options.get("books")

    def partitions(self):
        out = []
        for t in read_header(self.path).tensors:
            if self.names is None or t.name in self.names:
                hi = t.rows if self.hi < 0 else min(self.hi, t.rows)
                out += [_Range(self.path, t, self.lo + a, self.lo + b) for a, b in files.splits(max(0, hi - self.lo), t.row_bytes)]
        return out

    def read(self, p: _Range):
        t, step = p.tensor, max(1, (4 << 20) // max(1, p.tensor.ne[0]))
        books = blocks.load_books(self.books) if self.books else None
        for a in range(p.lo, p.hi, step):
            b = min(p.hi, a + step)
            values = blocks.decode(t.qtype, files.read(p.path, t.offset + a * t.row_bytes, (b - a) * t.row_bytes), t.ne[0], books)
            flat = pa.array(values.ravel(), pa.float32())
            offsets = pa.array(range(0, (b - a) * t.ne[0] + 1, t.ne[0]), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([t.name] * (b - a)), pa.array(range(a, b), pa.int64()), pa.ListArray.from_arrays(offsets, flat)], ["name", "row", "values"])


class GGUFSource(DataSource):
    @classmethod
    def name(cls):
        return "gguf"

    def schema(self):
        return ROWS

    def reader(self, schema):
        return _Reader(self.options)


@dataclass(frozen=True)
class Model:
    """A model file: called with names of tensors (or none for all), it gives (name, row, values)."""

    spark: SparkSession
    header: Header
    books: str | None = None

    def __call__(self, names: Sequence[str] | None = None, lo: int = 0, hi: int | None = None) -> DataFrame:
        reader = self.spark.read.format("gguf").option("lo", lo).option("hi", -1 if hi is None else hi)
        if self.books is not None:
            reader = reader.option("books", self.books)
        if names is not None:
            reader = reader.option("names", json.dumps(list(names)))
        return reader.load(self.header.path)


def open_model(spark: SparkSession, path: str, books: str | None = None) -> Model:
    """The header is read at once, tensors when they are asked for. ``books``: a file of code books, for types that need one."""
    spark.dataSource.register(GGUFSource)
    return Model(spark, read_header(path), books)


def read_rows(model: Model, name: str, lo: int, hi: int) -> DataFrame:
    """Rows lo to hi - 1 of a tensor; nothing else is read."""
    return model([name], lo, hi)


def read_matrix(model: Model, name: str) -> DataFrame:
    return model([name])


def read_vector(model: Model, name: str) -> DataFrame:
    if len(model.header.shapes()[name]) != 1:
        raise SourceError(f"{name!r} is no vector")
    return model([name])
