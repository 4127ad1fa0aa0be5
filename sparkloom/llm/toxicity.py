"""Toxicity by a counterfactual-regularised linear classifier.

Features are the distinct words of a text and their beginnings.  Labelled sentences that name a group
are repeated with another group's name; the fit penalises the squared change of the score between the
two, so a neutral mention doesn't raise it.  The names come from two places: a list that the caller
gives, and the training rows themselves: words whose mention is mostly neutral (at most half of their rows
have label 1) and that stand in the same slots, between the same two words, name things of one kind.
Of those, pairs are swapped in which the model could tell the two words apart.  The model is fitted on a
bounded sample of labelled rows; scoring reads every whole text and moves no rows between tasks.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled rows used for the fit, least hash of the id first: the documented bound.
SAMPLE = 24_000
FEATURES = 20_000
#: Standard errors by which a feature must tell the labels apart.
MIN_STRENGTH = 3.0
PREFIXES = (4, 5, 6)
#: Words that slots may show to be of one kind: at most so many, in this part of the rows; and the pairs of
#: them that are swapped.
CANDIDATES, RARE, COMMON, PAIRS = 6_000, 0.002, 0.2, 100
THRESHOLD = 0.3
FOLDS, HELD_OUT = 4, 2
#: Names of groups; a term is swapped for the next one of its list.
IDENTITY = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"), ("black", "white", "asian", "latino", "african", "european", "arab"), ("immigrants", "natives"), ("disabled", "deaf", "blind"), ("old", "young"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)
EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def features_of(word: str) -> tuple[str, ...]:
    """A word's own feature and those of its beginnings; none for bare punctuation."""
    w = EDGE.sub("", word)
    return (w, *(f"{w[:k]}*" for k in PREFIXES if len(w) > k)) if w else ()


def words_of(text: str) -> set[str]:
    return set(text.lower().split())


def swapped(words: set[str], identity=IDENTITY) -> set[str] | None:
    """The words with every group's name replaced by another one's; None if there is none."""
    next_ = {t: g[(i + 1) % len(g)] for g in identity for i, t in enumerate(g)}
    bare = {w: EDGE.sub("", w) for w in words}
    if not any(b in next_ for b in bare.values()):
        return None
    return {next_.get(b, w) for w, b in bare.items()}


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float
    #: Pairs of words found in the training rows, and labelled rows whose counterfactual took part in the fit.
    found: tuple[tuple[str, str], ...] = ()
    counterfactuals: int = 0


class Rows:
    """Sparse rows of feature indexes."""

    def __init__(self, rows: Sequence[Sequence[int]], width: int):
        self.index = np.concatenate([np.empty(0, "int32"), *[np.asarray(r, "int32") for r in rows]])
        self.row = np.repeat(np.arange(len(rows), dtype="int32"), [len(r) for r in rows])
        self.shape = len(rows), width

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.index], self.shape[0])

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.index, g[self.row], self.shape[1])


def _arrays(column: pa.ChunkedArray) -> list[np.ndarray | None]:
    """The lists of a column as views of one array, null as None."""
    out: list[np.ndarray | None] = []
    for c in column.chunks:
        values, at = c.values.to_numpy(), c.offsets.to_numpy()
        out += [values[a:b] if fine else None for a, b, fine in zip(at[:-1], at[1:], c.is_valid().to_pylist(), strict=True)]
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def fit(rows: Sequence[Sequence[int]], twins: Sequence[tuple[int, Sequence[int]]], labels: np.ndarray, width: int, penalty: float = 1.0, ridge: float = 5e-4, steps: int = 250) -> tuple[np.ndarray, float]:
    """Logistic weights. twins: (row, features of its counterfactual); each costs penalty * (score change)^2."""
    x, n = Rows(rows, width), max(1, len(rows))
    other = Rows([t for _, t in twins], width)
    first = np.asarray([i for i, _ in twins], "int64")
    w, b = np.zeros(width), float(np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1)))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for k in range(1, steps + 1):
        s = _sigmoid(x.times(w) + b)
        back = (s - labels) / n
        grad, grad_b = np.zeros(width), back.sum()
        if len(first):
            t = _sigmoid(other.times(w) + b)
            d = 2 * penalty * (s[first] - t) / len(first)
            np.add.at(back, first, d * s[first] * (1 - s[first]))
            far = -d * t * (1 - t)
            grad += other.back(far)
            grad_b = back.sum() + far.sum()
        grad += x.back(back) + ridge * w
        g = np.append(grad, grad_b)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (1 - k / (steps + 1)) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def _counts(batches):
    """(feature, documents with label 1, documents with label 0) of a task."""
    seen = (Counter(), Counter())
    for b in common.pieces(batches, "text"):
        for text, label in zip(b.column("text").to_pylist(), b.column("label").to_pylist(), strict=True):
            seen[label].update({f for w in words_of(text or "") for f in features_of(w)})
    names = list(seen[0] | seen[1])
    for k in range(0, len(names), 50_000):
        part = names[k : k + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([seen[1][f] for f in part], pa.int64()), pa.array([seen[0][f] for f in part], pa.int64())], ["feature", "ones", "zeros"])


def _pairs(texts: DataFrame, candidates: dict[str, bool], most: int) -> tuple[tuple[str, str], ...]:
    """Pairs of candidates that most often fill the same slot, each word in one pair at most, and one of both marked.

    The fillers of a slot meet in a chain, not all with all; a slot has at most as many as there are candidates.
    """

    def run(batches):
        from xxhash import xxh3_64_intdigest

        seen = set()
        for b in common.pieces(batches, "text"):
            for t in b.column("text").to_pylist():
                words = [EDGE.sub("", w) for w in (t or "").lower().split()]
                for before, w, after in zip(words, words[1:], words[2:], strict=False):
                    if w in candidates:
                        seen.add((xxh3_64_intdigest(f"{before} {after}") >> 1, w, candidates[w]))
        slots = sorted(seen)
        for k in range(0, len(slots), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in slots[k : k + 100_000]], t) for j, t in enumerate((pa.int64(), pa.string(), pa.bool_()))], ["slot", "word", "marked"])

    slots = texts.select("text").mapInArrow(run, "slot bigint, word string, marked boolean").groupBy("slot").agg(F.collect_set(F.struct(F.xxhash64("word").alias("h"), "word", "marked")).alias("w")).where("size(w) > 1 AND exists(w, x -> x.marked)")
    linked = slots.select(F.array_sort("w").alias("c")).select(F.explode(F.arrays_zip(F.slice("c", F.lit(1), F.size("c") - 1).alias("u"), F.slice("c", F.lit(2), F.size("c") - 1).alias("v"))).alias("p")).where("p.u.marked OR p.v.marked")
    counted = linked.groupBy(F.least("p.u.word", "p.v.word").alias("u"), F.greatest("p.u.word", "p.v.word").alias("v")).agg(F.count("*").alias("n"))
    out, taken = [], set()
    for r in counted.orderBy(F.desc("n"), "u", "v").limit(20 * most).collect():
        if r.u not in taken and r.v not in taken and len(out) < most:
            out.append((r.u, r.v))
            taken |= {r.u, r.v}
    return tuple(out)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = FOLDS, held_out: int = HELD_OUT, sample: int = SAMPLE, penalty: float = 1.0, identity=IDENTITY, discover: int = PAIRS) -> Model:
    """Fit on at most ``sample`` labelled rows outside the held-out fold; without labels of both kinds every score is even.

    A document that is labelled both ways counts as labelled 1.  Rows without id or label aren't used; null
    text counts as empty.  ``identity`` lists groups of names to swap, ``discover`` is the number of
    pairs to look for in the training rows besides.
    """
    common.small_batches(docs.sparkSession)
    k = common.column(key)
    usable = labels.where(common.column(label).isin(0, 1) & k.isNotNull() & (common.id_bucket_column(k, folds) != held_out)).groupBy(k.alias("l_id")).agg(F.max(common.column(label).cast("int")).alias("label"))
    chosen = common.stored(usable.orderBy(F.xxhash64("l_id"), "l_id").limit(sample), "toxic-labels")
    texts = common.stored(docs.select(k.alias("id"), common.column(text).alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("l_id")).select("id", "text", "label"), "toxic-sample")
    counted = texts.mapInArrow(_counts, "feature string, ones bigint, zeros bigint").groupBy("feature").agg(F.sum("ones").alias("a"), F.sum("zeros").alias("b")).where("a + b >= 4")
    size = {r.label: r.n for r in texts.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(size) < 2:
        return Model({}, 0.0)
    p, q = (F.col("a") + 0.5) / (size[1] + 1), (F.col("b") + 0.5) / (size[0] + 1)
    strength = F.abs(F.ln(p / q)) / F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    counted = common.stored(counted.withColumn("strength", strength), "toxic-features")
    best = [r.feature for r in counted.where(F.col("strength") >= MIN_STRENGTH).orderBy(F.desc("strength"), "feature").limit(FEATURES).collect()]
    total = sum(size.values())
    strong = frozenset(best)
    neutral = (F.col("a") <= F.col("b")) & (F.col("a") + F.col("b")).between(RARE * total, COMMON * total) & ~F.col("feature").endswith("*")
    words = [r.feature for r in counted.where(neutral).orderBy(F.desc(F.col("a") + F.col("b")), "feature").limit(CANDIDATES).collect()] if discover else []
    found = _pairs(texts, {w: not strong.isdisjoint(features_of(w)) for w in words}, discover) if words else ()
    identity = (*identity, *found)
    index = {f: i for i, f in enumerate(best)}

    def encode(batches):
        for b in common.pieces(batches, "text"):
            rows, twins = [], []
            for t in b.column("text").to_pylist():
                words = words_of(t or "")
                take = lambda ws: sorted({index[f] for w in ws for f in features_of(w) if f in index})
                rows.append(take(words))
                other = swapped(words, identity)
                twins.append(None if other is None else take(other))
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array(rows, kind), pa.array(twins, kind)], ["id", "label", "row", "twin"])

    got = texts.mapInArrow(encode, f"id {texts.schema['id'].dataType.simpleString()}, label int, row array<int>, twin array<int>").toArrow().combine_chunks()
    ids, labels_, row, twin = got["id"].to_pylist(), got["label"].to_numpy(), _arrays(got["row"]), _arrays(got["twin"])
    order = sorted(range(len(ids)), key=lambda i: (str(ids[i]), row[i].tobytes()))  # whatever the partitioning
    rows = [row[i] for i in order]
    twins = [(k, twin[i]) for k, i in enumerate(order) if twin[i] is not None and not np.array_equal(twin[i], row[i])]
    w, bias = fit(rows, twins, labels_[order].astype("float64"), len(best), penalty)
    return Model({f: float(x) for f, x in zip(best, w, strict=True) if abs(x) > 1e-6}, bias, found, len(twins))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score): every row once. Null text counts as empty, which gets the score of a text without known words.

    Equal texts get equal scores; ids may be null or repeat; an empty table gives an empty table; columns
    other than ``key`` and ``text`` aren't read.
    """
    common.small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    rows = docs.select(common.column(key).alias("id"), common.column(text).alias("text"))

    def run(batches):
        weights, bias = sent.value
        known: dict[str, tuple[str, ...]] = {}
        for b in common.pieces(batches, "text"):
            z = []
            for t in b.column("text").to_pylist():
                hits = set()
                for w in words_of(t or ""):
                    f = known.get(w)
                    if f is None:
                        if len(known) > 500_000:
                            known.clear()
                        f = known[w] = tuple(x for x in features_of(w) if x in weights)
                    if f:
                        hits.update(f)
                z.append(bias + sum(weights[f] for f in sorted(hits)))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(_sigmoid(np.asarray(z)), pa.float64())], ["id", "score"])
        known.clear()
        common.trim()

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double")
