"""Mixing sources to target weights by the cube method.

Each source gets a target in words.  The ratio of target and source size, at most 2, gives every
document of the source a whole number of certain copies and one fractional inclusion probability.
The cube method turns the probabilities into decisions: it moves them, three documents at a time,
along the null space of the constraints (words, documents) until one of the three is 0 or 1, so both
totals stay as they are.  Blocks of bounded size fly in parallel and leave at most two undecided
documents each; these meet in the next round, until one block of each source lands its last two by
the rounding that misses the word total least.  What the landing still misses, at most about one
long document, is made up for by taking or leaving up to four single documents of the right size in
that last block.  For these few, and for the two of the landing, inclusion probabilities hold no longer; for all
others they do.  Random numbers come from the block's name, and the order in a block from a hash
of the row, so reruns agree however rows are partitioned.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product
from random import Random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEAT = 2
BLOCK = 5_000
#: Up to so many sources, their targets are sent to every executor; beyond, they are joined by shuffle.
BROADCAST_SOURCES = 50_000
EPS = 1e-9


def targets(sizes: Sequence[int], weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = REPEAT) -> list[float]:
    """Words for each source, in their order: ``share`` of all by weight, at most ``cap`` times a source."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    out, active, left = [0.0] * len(sizes), set(range(len(sizes))), share * sum(sizes)
    while active:
        total = sum(weight[i] for i in active)
        over = [i for i in sorted(active) if weight[i] * left / total > cap * sizes[i]]
        if not over:
            for i in active:
                out[i] = weight[i] * left / total
            break
        for i in over:
            out[i] = float(cap * sizes[i])
        left -= sum(out[i] for i in over)
        active -= set(over)
    return out


def fly(p: np.ndarray, size: np.ndarray, random: Random) -> np.ndarray:
    """Move probabilities until at most two (or units without a common direction) are undecided."""
    p, size = p.tolist(), size.tolist()
    waiting = [i for i in range(len(p) - 1, -1, -1) if EPS < p[i] < 1 - EPS]
    pool: list[int] = []
    while True:
        while len(pool) < 3 and waiting:
            pool.append(waiting.pop())
        if len(pool) == 3:
            a, b, c = (size[i] for i in pool)
            u = (b - c, c - a, a - b) if a != b or b != c else (1, -1, 0)
        elif len(pool) == 2 and size[pool[0]] == size[pool[1]]:
            u = (1, -1)
        else:
            break
        up = min((1 - p[i]) / d if d > 0 else p[i] / -d for i, d in zip(pool, u, strict=True) if d)
        down = min(p[i] / d if d > 0 else (1 - p[i]) / -d for i, d in zip(pool, u, strict=True) if d)
        step = up if random.random() * (up + down) < down else -down
        for i, d in zip(pool, u, strict=True):
            p[i] += step * d
            if p[i] <= EPS or p[i] >= 1 - EPS:
                p[i] = float(round(p[i]))
        pool = [i for i in pool if 0 < p[i] < 1]
    return np.asarray(p)


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Round the last few probabilities so that the word total is missed least, then the document total."""
    open_ = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    best = min(product((0.0, 1.0), repeat=len(open_)), key=lambda s: (abs(float(np.dot(size[open_], np.asarray(s) - p[open_]))), abs(sum(s) - float(p[open_].sum())), s)) if len(open_) else ()
    p = p.copy()
    p[open_] = best
    return np.round(p)


def settle(p: np.ndarray, size: np.ndarray, words: float, flips: int = 4) -> np.ndarray:
    """Take or leave a few single documents, each time the one that brings the word total nearest to ``words``.

    What the landing misses is at most about the size of a long document; a document of that size makes
    up for it.  Nothing changes once no single document helps.
    """
    p = p.copy()
    for _ in range(flips):
        miss = float(np.dot(p, size)) - words
        after = np.abs(miss + np.where(p > 0.5, -size, size))
        if not len(p) or after.min() >= abs(miss) - 0.5:
            break
        k = int(after.argmin())
        p[k] = 1 - p[k]
    return p


def word_sizes(docs: DataFrame, text: str, keep: list[str], out: str = "size") -> DataFrame:
    """The columns ``keep``, then the number of words; null text has none."""
    n = F.coalesce(F.regexp_count(common.column(text), F.lit(common.WORD)), F.lit(0)).cast("bigint")
    return docs.select(*map(common.column, keep), n.alias(out))


def mix(sized: DataFrame, keys: list[str], source: str = "source", size: str = "size", weights: Sequence[float] = WEIGHTS, share: float = SHARE, seed: int = 0) -> DataFrame:
    """Rows (*keys, source, size, source_size, target, copies) for rows with a word count.

    Sources stand in code-point order, null last.  Documents without words may be taken but add
    nothing.  A source without words has target 0.  Repeated rows are drawn one by one.  An empty
    table gives an empty table.  The driver holds one row for each source; ``keys`` may be null.
    """
    spark = sized.sparkSession
    common.small_batches(spark)
    sized = common.stored(sized.select(*[common.column(k).alias(f"k{i}") for i, k in enumerate(keys)], common.column(source).alias("source"), common.column(size).alias("size")), "mixing-sizes")
    ids = [f"k{i}" for i in range(len(keys))]
    sums = sorted(((r.source, r.n, r.total) for r in sized.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("total")).collect()), key=lambda r: (r[0] is None, r[0] or ""))
    wanted = targets([r[2] for r in sums], weights, share)
    blocks = [-(-r[1] // BLOCK) for r in sums]
    kind = ", ".join(f"{k} {sized.schema[k].dataType.simpleString()}" for k in ids)
    schema = f"{kind}, source string, size bigint, source_size bigint, target double, base int, p double, open boolean"

    def info(blocks):
        rows = [(s, total, t, t / total if total else 0.0, b) for (s, _, total), t, b in zip(sums, wanted, blocks, strict=True)]
        df = spark.createDataFrame(rows, "t_source string, source_size bigint, target double, ratio double, blocks int")
        return F.broadcast(df) if len(rows) <= BROADCAST_SOURCES else df

    def flight(last_round: int):
        def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
            g = rows.take(pc.sort_indices(rows, [(c, "ascending") for c in ("order", *ids, "size")]))
            n, wanted = g["size"].to_numpy(), g["p"].to_numpy()
            p = fly(wanted, n, Random(f"{seed}|{last_round}|{[k.as_py() for k in key]}"))
            if pc.max(g["blocks"]).as_py() == 1:
                p = settle(land(p, n), n, float(np.dot(wanted, n)))
            got = g.select([*ids, "source", "size", "source_size", "target", "base"])
            return got.append_column("p", pa.array(p)).append_column("open", pa.array((p > EPS) & (p < 1 - EPS)))

        return run

    joined = sized.join(info(blocks), F.col("source").eqNullSafe(F.col("t_source")))
    base = F.floor(F.col("ratio") + EPS).cast("int")
    rows = joined.select(*ids, "source", "size", "source_size", "target", "blocks", base.alias("base"), F.greatest(F.col("ratio") - base, F.lit(0.0)).alias("p"))
    done = []
    for k in range(20):
        order = F.xxhash64(*ids, F.lit(seed), F.lit(k))
        dealt = rows.withColumn("order", order).withColumn("block", F.pmod(F.xxhash64("order"), F.col("blocks")).cast("int"))
        out = common.stored(dealt.groupBy("source", "block").applyInArrow(flight(k), schema), "mixing")
        done.append(out.where("not open"))
        if max(blocks, default=1) <= 1:
            break
        blocks = [-(-2 * b // BLOCK) for b in blocks]
        rows = out.where("open").join(info(blocks).select("t_source", "blocks"), F.col("source").eqNullSafe(F.col("t_source"))).select(*ids, "source", "size", "source_size", "target", "blocks", "base", "p")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    copies = (F.col("base") + F.col("p")).cast("int").alias("copies")
    return out.select(*[F.col(i).alias(k) for i, k in zip(ids, keys, strict=True)], "source", "size", "source_size", "target", copies)


def mixed(docs: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """The rows of a plain file scan, each as often as the mix takes it: not at all, once or twice.

    All columns stay as they are, whatever their names; nulls in them are kept.  Null text has no
    words; a null source is a source of its own, the last.  Equal rows are drawn one by one, told apart
    by where they lie.  An empty table gives an empty table.
    """
    sized = word_sizes(common.located(docs, text=text, source=source), "text", ["x_file", "x_row", "source"])
    taken = mix(sized, ["x_file", "x_row"]).where("copies > 0").select("x_file", "x_row", "copies")
    full = common.placed(docs, taken, "copies")
    return full.withColumn(full.columns[-1], F.explode(F.sequence(F.lit(1), F.col(full.columns[-1])))).select(*common.columns(docs))
