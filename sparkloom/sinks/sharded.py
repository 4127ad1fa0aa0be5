"""Sharded safetensors folders: shards are laid out on the driver and written by one task each.

Only keys, types and shapes are known to the driver.  Rows are sorted by their place in the shard, so a
task streams them to its file behind a header it could write beforehand.  A task writes to a name of its
own and renames the file when it is complete, so a repeated task does no harm.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from math import prod

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ConversionError
from ..sources import files
from ..sources.safetensors import DTYPES, INDEX

VOCABULARIES, TOKENIZER_CONFIG = ("tokenizer.json", "tokenizer.model"), "tokenizer_config.json"


@dataclass(frozen=True)
class Entry:
    key: str
    dtype: str
    shape: tuple[int, ...]

    @property
    def n_bytes(self) -> int:
        return prod(self.shape) * np.dtype(DTYPES[self.dtype]).itemsize


def assign(entries: Iterable[Entry], most: int) -> list[list[Entry]]:
    """Shards in order: one is closed as soon as it holds ``most`` bytes or more; an entry is never split."""
    out: list[list[Entry]] = []
    held = most
    for e in entries:
        if held >= most:
            out.append([])
            held = 0
        out[-1].append(e)
        held += e.n_bytes
    return out


def _head(shard: list[Entry]) -> bytes:
    at, table = 0, {"__metadata__": {"format": "pt"}}
    for e in shard:
        table[e.key] = {"dtype": e.dtype, "shape": list(e.shape), "data_offsets": [at, at + e.n_bytes]}
        at += e.n_bytes
    text = json.dumps(table).encode()
    text += b" " * (-len(text) % 8)
    return struct.pack("<Q", len(text)) + text


def put(folder: str, name: str, data: bytes) -> None:
    system, at = files.located(folder)
    with system.open_output_stream(f"{at.rstrip('/')}/{name}") as f:
        f.write(data)


def write(rows: DataFrame, entries: list[Entry], folder: str, most: int) -> dict:
    """Write (key, row, data) to shards and an index; returns the index."""
    if not entries:
        raise ConversionError("no tensor to write")
    shards = assign(entries, most)
    names = [f"model-{i:05d}-of-{len(shards):05d}.safetensors" for i in range(1, len(shards) + 1)]
    place = {e.key: (i, k) for i, s in enumerate(shards) for k, e in enumerate(s)}
    spark = rows.sparkSession
    where = spark.createDataFrame([(k, i, n) for k, (i, n) in place.items()], "key string, shard int, at int")
    dealt = rows.join(F.broadcast(where), "key").repartitionByRange(len(shards), "shard").sortWithinPartitions("shard", "at", "row")
    heads, sizes = [_head(s) for s in shards], [sum(e.n_bytes for e in s) for s in shards]

    def run(batches):
        current, done = None, []
        for b in batches:
            for shard, data in zip(b.column("shard").to_pylist(), b.column("data"), strict=True):
                if current is None or current.shard != shard:
                    if current is not None:
                        done.append(current.close(sizes[current.shard]))
                    current = _File(folder, names[shard], shard, heads[shard])
                current.add(data.as_buffer())
        if current is not None:
            done.append(current.close(sizes[current.shard]))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int32()), pa.array([d[1] for d in done], pa.int64())], ["shard", "n_bytes"])

    written = {r.shard: r.n_bytes for r in dealt.select("shard", "data").mapInArrow(run, "shard int, n_bytes bigint").collect()}
    if written != dict(enumerate(sizes)):
        raise ConversionError(f"shards of {written} bytes instead of {sizes}")
    index = {"metadata": {"total_size": sum(sizes)}, "weight_map": {e.key: names[i] for i, s in enumerate(shards) for e in s}}
    put(folder, INDEX, json.dumps(index, indent=2).encode())
    return index


class _File:
    def __init__(self, folder: str, name: str, shard: int, head: bytes):
        self.system, at = files.located(folder)
        self.name, self.shard, self.n = f"{at.rstrip('/')}/{name}", shard, 0
        self.own = f"{self.name}.{uuid.uuid4().hex}.part"
        self.stream = self.system.open_output_stream(self.own)
        self.stream.write(head)

    def add(self, data) -> None:
        self.stream.write(data)
        self.n += len(data)

    def close(self, size: int) -> tuple[int, int]:
        self.stream.close()
        if self.n != size:
            raise ConversionError(f"{self.name} got {self.n} bytes instead of {size}")
        self.system.move(self.own, self.name)
        return self.shard, self.n


@contextmanager
def staged(target: str, overwrite: bool = False) -> Iterator[str]:
    """A folder beside ``target`` that takes its place when the block ends well, and goes when it doesn't."""
    system, at = files.located(target)
    at, prefix = at.rstrip("/"), target[: len(target) - len(at)] if target.endswith(at) else ""
    info = system.get_file_info(at)
    if info.type == fs.FileType.File:
        raise ConversionError(f"{target} is a file")
    there = info.type == fs.FileType.Directory
    if there and not overwrite and system.get_file_info(fs.FileSelector(at)):
        raise ConversionError(f"{target} isn't empty")
    mark = uuid.uuid4().hex[:12]
    stage, old = f"{at}.staging-{mark}", f"{at}.before-{mark}"
    system.create_dir(stage, recursive=True)
    try:
        yield prefix + stage
        if there:
            system.move(at, old)
        try:
            system.move(stage, at)
        except OSError:
            if there:
                system.move(old, at)
            raise
        if there:
            system.delete_dir(old)
    except BaseException:
        if system.get_file_info(stage).type == fs.FileType.Directory:
            system.delete_dir(stage)
        raise


def copy_files(source: str, folder: str, names: Iterable[str]) -> list[str]:
    """Copy those of the named files that exist."""
    done = []
    for n in names:
        if size := files.size_of(f"{source.rstrip('/')}/{n}"):
            put(folder, n, files.read(f"{source.rstrip('/')}/{n}", 0, size))
            done.append(n)
    return done


def check_tokenizer(folder: str) -> None:
    """A usable folder has a vocabulary and a tokenizer configuration; JSON must parse."""
    some = lambda n: bool(files.size_of(f"{folder.rstrip('/')}/{n}"))
    if not any(map(some, VOCABULARIES)) or not some(TOKENIZER_CONFIG):
        raise ConversionError(f"{folder} needs {TOKENIZER_CONFIG} and one of {VOCABULARIES}")
    if some("tokenizer.json"):
        path = f"{folder.rstrip('/')}/tokenizer.json"
        try:
            json.loads(files.read(path, 0, files.size_of(path)))
        except ValueError as e:
            raise ConversionError(f"{path}: {e}") from e
