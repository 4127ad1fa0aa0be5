"""Best-fit packing of token sequences, local first and then merged as a tree.

Every task encodes its documents, cuts those longer than a sequence, and packs the pieces best-fit
decreasing.  Nearly full bins are final.  The others become the items of the next round: dealt to
fewer tasks, they are packed best-fit again, whole bins being joined.  Rounds end when one task
holds all that is left, or when a round no longer joins bins.  A bin carries its pieces, of which it
has at most as many as tokens, so every row and every group is bounded.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .token_counts import WordTokens, word_tokens

CAPACITY = 2048
END = 0
#: A bin with at most so many free places is final.
NEARLY = 2
#: Pieces that a task holds at a time, and that one task of a later round receives.
PIECES_HELD = 200_000
#: Underfull bins that one task of a later round receives, at most.
GROUP = 20_000
ROUNDS = 8


def best_fit(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Indexes of the items of each bin: items by falling length, each into the fullest bin that takes it."""
    open_: dict[int, list[int]] = defaultdict(list)
    free: list[int] = []
    bins: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        k = bisect_left(free, n)
        if k == len(free):
            bins.append([i])
            at, left = len(bins) - 1, capacity - n
        else:
            left = free[k]
            at = open_[left].pop()
            if not open_[left]:
                del free[k]
            bins[at].append(i)
            left -= n
        if left > 0:
            if not open_[left]:
                insort(free, left)
            open_[left].append(at)
    return bins


def ended(tokens: WordTokens, texts: pa.Array) -> Iterator[memoryview]:
    """The ids of each text, the end id being the last."""
    ids, which, starts = tokens.of_column(texts, int(END).to_bytes(4, "little"))
    _, offsets, data = pa.array(ids, pa.large_binary()).take(pa.array(which)).buffers()
    at, data = np.frombuffer(offsets, "<i8")[starts].tolist(), memoryview(data)
    return (data[a:b] for a, b in zip(at, at[1:], strict=False))


def cut(ids: bytes | memoryview, capacity: int) -> list[tuple[int, int, int]]:
    """(start, length, crc32) of the pieces of a document's ids."""
    return [(a // 4, len(p) // 4, zlib.crc32(p)) for a in range(0, len(ids), 4 * capacity) for p in [ids[a : a + 4 * capacity]]]


PIECES = "array<struct<id:{kind},piece:int,start:bigint,length:bigint,ids_crc32:bigint,offset:bigint>>"


def _bins(groups: list[list[tuple]], number: int, kind) -> pa.RecordBatch:
    """Rows (bin, fill, pieces): bins are numbered from the task's own range."""
    piece = pa.struct([("id", kind), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())])
    flat = [(*p, at) for g in groups for p, at in zip(g, accumulate((p[3] for p in g), initial=0), strict=False)]
    cols = list(zip(*flat, strict=True)) if flat else [()] * 6
    inner = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(cols, piece, strict=True)], fields=list(piece))
    offsets = pa.array(np.cumsum([0, *map(len, groups)]), pa.int32())
    fill = [sum(p[3] for p in g) for g in groups]
    return pa.RecordBatch.from_arrays([pa.array(range(number, number + len(groups)), pa.int64()), pa.array(fill, pa.int64()), pa.ListArray.from_arrays(offsets, inner)], ["bin", "fill", "pieces"])


def _packed(items: list[list[tuple]], first: int, kind, capacity: int, rows: int = 20_000):
    groups = [[p for i in b for p in items[i]] for b in best_fit([sum(p[3] for p in x) for x in items], capacity)]
    for k in range(0, len(groups), rows):
        yield _bins(groups[k : k + rows], first + k, kind)


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", file: str = common.TOKENIZER_FILE, capacity: int = CAPACITY, nearly: int = NEARLY) -> DataFrame:
    """Rows (id, piece, start, length, ids_crc32, sequence_id, offset).

    Null text counts as empty: such a document is its end id alone.  A row that occurs twice is packed
    twice; ids may be null.  An empty table gives an empty table; columns other than ``key`` and ``text``
    aren't read.
    """
    common.small_batches(docs.sparkSession)
    docs = docs.select(common.column(key).alias("id"), common.column(text).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    schema = f"bin bigint, fill bigint, pieces {PIECES.format(kind=kind)}"

    def local(batches):
        tokens, task = word_tokens(file), TaskContext.get().partitionId()
        first, items, arrow = task << 32, [], None
        for b in common.pieces(batches, "text"):
            arrow = b.schema.field("id").type
            full = []
            for k, ids in zip(b.column("id").to_pylist(), ended(tokens, b.column("text")), strict=True):
                for i, (start, n, crc) in enumerate(cut(ids, capacity)):
                    (full if n == capacity else items).append([(k, i, start, n, crc)])
            if full:
                yield _bins(full, first, arrow)
                first += len(full)
            if len(items) >= PIECES_HELD:  # bounds the task's memory; what stays open goes on as bins
                for out in _packed(items, first, arrow, capacity):
                    first += out.num_rows
                    yield out
                items = []
        if items:
            yield from _packed(items, first, arrow, capacity)
        tokens.rest()

    def merge(k: int):
        def run(batches):
            items, arrow = [], None
            for b in batches:
                arrow = b.schema.field("pieces").type.value_type.field("id").type
                items += [[tuple(p.values())[:5] for p in ps] for ps in b.column("pieces").to_pylist()]
            if items:
                yield from _packed(items, k << 56 | TaskContext.get().partitionId() << 32, arrow, capacity)

        return run

    bins = common.stored(docs.mapInArrow(local, schema), "packing")
    done = []
    final = F.col("fill") >= capacity - nearly
    open_ = lambda df: df.where(~final).agg(F.count("*").alias("bins"), F.coalesce(F.sum(F.size("pieces")), F.lit(0)).alias("pieces")).first()
    left = open_(bins)
    for k in range(1, ROUNDS + 1):
        done.append(bins.where(final))
        rest = bins.where(~final)
        if left.bins == 0:
            break
        tasks = max(-(-left.bins // GROUP), -(-left.pieces // PIECES_HELD))
        dealt = rest.repartition(tasks, F.xxhash64(F.col("bin"), F.lit(k))) if tasks > 1 else rest.coalesce(1)
        bins = common.stored(dealt.mapInArrow(merge(k), schema), "packing")
        now = bins.count()
        if tasks == 1 or now > 0.99 * left.bins:
            done.append(bins)
            break
        left = open_(bins)
    else:
        done.append(bins)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    one = out.select("bin", F.explode("pieces").alias("x"))
    return one.select("x.id", "x.piece", "x.start", "x.length", "x.ids_crc32", F.col("bin").alias("sequence_id"), "x.offset")
