"""Language-model scores of whole documents, learned from the same corpus.

1. Every task counts the words of its training documents; Spark adds the counts up.
2. Words above a cut-off chosen from a histogram of the counts, at most ``KNOWN``, go to every
   executor; the others are looked up by a join, so no word's count is lost.
3. Every text is encoded once, two bytes a word, for training and scoring.
4. A first model is fitted on a bounded number of training documents, read ``PASSES`` times: where the fits of
   step 5 begin, so that their mean makes sense.
5. All training documents are dealt by a hash to groups of about ``GROUP_WORDS`` words; each group trains
   the first model further, and the mean of all, by words, is the model.
6. Every task scores its documents, with the state carried across windows.

Which group a document belongs to and its place there follow from the document, and means are sums of
whole numbers, so the model depends neither on partitions nor on the number of executors.  Scores are sums
of single-precision numbers whose order depends on a task's neighbours: they agree to about 1e-5 of their size.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, lm
from .token_counts import raw

FOLDS, HELD_OUT = 7, 2
#: Words whose counts every executor holds, at most.
KNOWN = 200_000
#: Documents of the first fit, least hash first, and how often it reads them.
SEED_DOCS, PASSES = 1_000, 3
#: The averaged fit reads one training document in so many, which is each, in groups of so many words.
TRAIN_EVERY, GROUP_WORDS = 1, 2_000_000
#: Rates of the first fit and of a group's, and the lanes that run side by side.
SEED_RATE, SEED_LANES, RATE, LANES = 0.01, 64, 0.004, 512
#: Words of documents that a task scores side by side, at least, if it has as many.
SIDE_BY_SIDE = 2_500_000
END = b""
#: Weights are averaged as whole numbers of this size.
GRAIN = 2.0**-20


def tail_class(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % lm.TAIL


def tail_classes(words: pa.Array) -> np.ndarray:
    """``tail_class`` of each word: few endings differ."""
    ends = pc.binary_slice(words, -3).dictionary_encode()
    return np.fromiter(map(tail_class, ends.dictionary.to_pylist()), "int32", len(ends.dictionary))[ends.indices.to_numpy()]


def tokens_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(tokens of all texts, where each text's begin and the last one's end); a null text is empty.

    A text that gets a space at its end and loses those before it splits into its words and one empty word, the end.
    """
    texts = pc.fill_null(texts.cast(pa.large_string(), safe=False), "")
    spaced = pc.binary_join_element_wise(texts, *pa.array(["", " "], pa.large_string()))
    # Lower case after the copy: pyarrow 23 mixes up the texts of a slice that was cast.
    split = pc.ascii_split_whitespace(pc.ascii_ltrim_whitespace(pc.ascii_lower(spaced)))
    return split.flatten().cast(pa.large_binary()), np.r_[0, np.cumsum(pc.list_value_length(split).to_numpy())]


def word_counts(docs: DataFrame, text: str = "text", flush: int = 400_000) -> DataFrame:
    """(word, n) over all rows; the end of a document is the empty word."""

    def run(batches):
        held, size = [], 0

        def counted():
            return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])

        for b in common.pieces(batches, "text"):
            got = pc.value_counts(tokens_of(b.column("text"))[0])
            held.append(pa.table([got.field(0).cast(pa.binary()), got.field(1)], ["word", "n"]))
            size += len(got)
            if size > 2 * flush:
                held = [counted()]
                size = len(held[0])
                if size > flush:
                    yield from held[0].to_batches(100_000)
                    held, size = [], 0
        if held:
            yield from counted().to_batches(100_000)

    return docs.select(common.column(text).alias("text")).mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """The words that every executor holds, most frequent first, and the totals of all words."""

    def __init__(self, words: list[bytes], counts: np.ndarray, total: int, distinct: int, classes: np.ndarray):
        self.words, self.counts, self.total, self.distinct = words, counts, total, distinct
        tail = np.fromiter(map(tail_class, words), "int32", len(words))
        top = min(lm.FREQUENT, len(words))
        inside = classes - np.bincount(tail[:top], counts[:top] + 1.0, lm.TAIL)
        #: log10 of the smoothed total of each class of other words; one more for a word never seen.
        self.class_log = np.log10(np.maximum(inside, 0) + 1)
        # By position; the last entry, which position -1 reads, is that of a word that isn't held.
        self.log_count = np.r_[np.log10(counts + 1.0), 0]
        #: The share of a held word in its class, where counts decide on it.
        self.inner = np.r_[np.where(np.arange(len(words)) < top, 0, self.log_count[:-1] - self.class_log[tail]), 0]
        self.once = np.r_[counts == 1, False]
        #: What ``lm`` reads: the frequent word, or its class after all of these.
        self.code = np.r_[np.arange(top), lm.FREQUENT + tail[top:], 0].astype("<u2")
        self.log_total = math.log10(total + distinct + 1)

    def start(self, seed: int = 1) -> dict[str, np.ndarray]:
        """A model whose biases already give every word its smoothed share of the corpus."""
        p = lm.fresh(seed)
        share = np.full(lm.FREQUENT, 1e-3)
        top = min(lm.FREQUENT, len(self.words))
        share[:top] = self.counts[:top] + 1
        share = share.reshape(lm.HEAD, lm.PER_CLASS)
        p["w"] = np.log(share).astype("float32")
        p["c"] = np.log(np.r_[share.sum(1), 10**self.class_log]).astype("float32")
        return p

    def held(self) -> pa.Array:
        return pa.array(self.words, pa.large_binary())


def _vocabulary(vocab: DataFrame, known: int) -> Vocabulary:
    bins = F.floor(F.log2("n") * 16).cast("int")
    rows = vocab.groupBy(bins.alias("bin")).agg(F.count("*").alias("words"), F.sum("n").alias("n")).orderBy(F.desc("bin")).collect()
    held, least = 0, None
    for r in rows:
        if held + r.words > known:
            break
        held, least = held + r.words, r.bin
    got = vocab.where(bins >= least).toPandas() if least is not None else vocab.limit(0).toPandas()
    words, counts = [bytes(w) for w in got["word"]], got["n"].tolist()
    order = sorted(range(len(words)), key=lambda i: (-counts[i], words[i]))
    per = vocab.mapInArrow(_class_sums, "cls int, n double").groupBy("cls").agg(F.sum("n").alias("n")).collect()
    classes = np.zeros(lm.TAIL)
    for r in per:
        classes[r.cls] = r.n
    return Vocabulary([words[i] for i in order], got["n"].to_numpy("float64")[order], sum(r.n for r in rows), sum(r.words for r in rows), classes)


def _class_sums(batches):
    total = np.zeros(lm.TAIL)
    for b in batches:
        total += np.bincount(tail_classes(b.column("word")), b.column("n").to_numpy(zero_copy_only=False) + 1.0, lm.TAIL)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(lm.TAIL), pa.int32()), pa.array(total)], ["cls", "n"])


_held: dict = {}


def _here(sent) -> tuple[Vocabulary, pa.Array]:
    """The broadcast vocabulary with its words, made once a worker."""
    if _held.get("id") != sent.value[0]:
        _held.clear()
        _held.update(id=sent.value[0], words=sent.value[1].held())
    return sent.value[1], _held["words"]


def _encoded(v: Vocabulary, held: pa.Array, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(positions in the vocabulary, codes of two bytes, places of words that aren't held, these words)."""
    at = pc.fill_null(pc.index_in(words, value_set=held), -1).to_numpy()
    rare, codes = np.flatnonzero(at < 0), v.code[at]
    others = words.take(pa.array(rare))
    codes[rare] = lm.FREQUENT + tail_classes(others)
    return at, codes, rare, others


def _decoded(codes: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(frequent word or -1, class of other words), as ``lm`` reads them."""
    c = np.frombuffer(codes, "<u2").astype("int32")
    frequent = c < lm.FREQUENT
    return np.where(frequent, c, -1), np.where(frequent, 0, c - lm.FREQUENT)


def _trained(weights: np.ndarray, docs: list, passes: int, rate: float, width: int = SEED_LANES) -> tuple[np.ndarray, int]:
    """Weights after some passes over the documents, all alike, and the words of one pass."""
    trainer = lm.Trainer(lm.unflat(weights), rate, width)
    for k in range(passes):
        trainer.rate = rate * (1 - 0.9 * k / passes)
        _, words = trainer.train(docs)
    return lm.flat(trainer.p), words


def _training(sent, passes: int, rate: float, width: int):
    """Train on each group of a task, rows sorted by group; yields (at, n, w): a stretch of the task's sum of
    the groups' weights, each counted as often as it has thousands of words, in whole numbers."""

    def run(batches):
        common.hold()
        weights = sent.value
        total, count = np.zeros(len(weights), "int64"), 0

        def add(docs):
            w, words = _trained(weights, docs, passes, rate, width)
            n = -(-words // 1000)
            return n * np.round(w.astype("float64") / GRAIN).astype("int64"), n

        docs, now = [], None
        for b in common.pieces(batches, "codes"):
            for g, x in zip(b.column("part").to_pylist(), raw(b.column("codes")), strict=True):
                if g != now and docs:
                    w, n = add(docs)
                    total, count, docs = total + w, count + n, []
                now = g
                docs.append(_decoded(x))
        if docs:
            w, n = add(docs)
            total, count = total + w, count + n
        if count:
            for k in range(0, len(total), 4096):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([count], pa.int64()), pa.array([total[k : k + 4096]], pa.list_(pa.int64()))], ["at", "n", "w"])
        common.trim()

    return run


def fitted(train_docs: DataFrame, v: Vocabulary) -> np.ndarray:
    """The weights: the mean of fits that together read all of the encoded training documents, begun from a first fit.

    The driver gets one number for each weight of the model, whose size is fixed.
    """
    spark = train_docs.sparkSession
    # Rows that agree in hash and id are told apart by their text; the least hash goes first.
    ranked = train_docs.select("mark", "id", "tie", "codes")
    order = ("part", "mark", "id", "tie")

    def averaged(docs, start, *how):
        sent = spark.sparkContext.broadcast(start)
        sums = docs.sortWithinPartitions(*order).select("part", "codes").mapInArrow(_training(sent, *how), "at bigint, n bigint, w array<bigint>")
        cells = sums.select("n", "at", F.posexplode("w").alias("k", "w")).groupBy((F.col("at") + F.col("k")).alias("k")).agg(F.sum("w").alias("w"), F.sum("n").alias("n"))
        got = cells.toPandas().sort_values("k")
        return (got["w"].to_numpy("float64") * GRAIN / got["n"].to_numpy("float64")) if len(got) else start

    sample = common.stored(ranked.orderBy("mark", "id", "tie").limit(SEED_DOCS).withColumn("part", F.lit(0)), "lm-seed")
    first = averaged(sample.repartition(1), lm.flat(v.start()), PASSES, SEED_RATE, SEED_LANES)
    parts = max(1, round(v.total / TRAIN_EVERY / GROUP_WORDS))
    dealt = ranked.where(F.pmod("mark", F.lit(TRAIN_EVERY)) == 0).withColumn("part", F.pmod(F.xxhash64("mark", "id", "tie"), F.lit(parts)))
    return averaged(dealt.repartition(F.col("part")), first, 1, RATE, LANES)


def object_id() -> str:
    import uuid

    return uuid.uuid4().hex


def _with_codes(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """One row per row: a number, id, two hashes that order the rows, the sums over known words and the coded text.

    ``inner`` is the part of the model's score that is the known words' share in their classes; ``rare`` has the
    words whose counts must be looked up.
    """
    sent = docs.sparkSession.sparkContext.broadcast((object_id(), v))

    def run(batches):
        number = TaskContext.get().partitionId() << 33
        v, held = _here(sent)
        for b in common.pieces(batches, "text"):
            words, ends = tokens_of(b.column("text"))
            at, codes, rare, others = _encoded(v, held, words)
            inner = v.inner[at]
            inner[rare] = -v.class_log[codes[rare] - lm.FREQUENT]
            known, single, base, inner = (np.add.reduceat(x, ends[:-1]) for x in ((at >= 0).astype("int64"), v.once[at].astype("int64"), v.log_count[at], inner))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(number, number + b.num_rows), pa.int64()), b.column("id"), b.column("mark"), b.column("tie"),
                    *map(pa.array, (np.diff(ends), known, single, base, inner)),
                    pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer((2 * ends).astype("int32")), pa.py_buffer(codes)]),
                    pa.ListArray.from_arrays(pa.array(np.searchsorted(rare, ends), pa.int32()), others.cast(pa.binary())),
                ],
                ["rid", "id", "mark", "tie", "n_tokens", "known", "single", "base", "inner", "codes", "rare"],
            )
            number += b.num_rows

    kept = docs.select("id", F.xxhash64("id", F.lit(11)).alias("mark"), F.xxhash64("text").alias("tie"), "text")
    return kept.mapInArrow(run, f"rid bigint, id {docs.schema['id'].dataType.simpleString()}, mark bigint, tie bigint, n_tokens bigint, known bigint, single bigint, base double, inner double, codes binary, rare array<binary>")


def lm_scores(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10), n_single.

    ``n_single`` counts the tokens that all of the training documents have once: a text that occurs once mostly has
    some, one that occurs twice among them has none.

    Documents whose crc32 of the id (null: of empty text) modulo 7 is 2 are never learned from.  Null
    text counts as empty, which is one end.  A word never seen in training has count 0: the base
    and the model both give it the smoothed share of a word not seen.  Without training documents the
    model is the untrained one.  Repeated rows get equal scores; an empty table gives an empty table;
    columns other than ``key`` and ``text`` aren't read.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    docs = docs.select(common.column(key).alias("id"), common.column(text).alias("text"))
    of_training = common.id_bucket_column(F.col("id"), FOLDS) != HELD_OUT
    vocab = common.stored(word_counts(docs.where(of_training)), "lm-words")
    v = _vocabulary(vocab, KNOWN)
    encoded = common.stored(_with_codes(docs, v), "lm-codes")
    sent = spark.sparkContext.broadcast(fitted(encoded.where(of_training), v))

    def run(batches):
        common.hold()
        p = lm.unflat(sent.value)
        held: list[tuple[pa.RecordBatch, list]] = []

        def out():
            """Score what is held side by side: the longest document decides on the number of steps."""
            ln = lm.score(p, [x for _, part in held for x in part]) / math.log(10)
            at = 0
            for rids, part in held:
                yield pa.RecordBatch.from_arrays([rids, pa.array(ln[at : at + len(part)])], ["rid", "model"])
                at += len(part)
            held.clear()

        size = 0
        for b in common.pieces(batches, "codes"):
            part = [_decoded(x) for x in raw(b.column("codes"))]
            held.append((pa.array(b.column("rid").to_pylist(), pa.int64()), part))  # a copy: the column would keep its batch
            size += sum(len(w) for w, _ in part)
            if size >= SIDE_BY_SIDE:
                yield from out()
                size = 0
        if held:
            yield from out()
        common.trim()

    scored = common.stored(encoded.select("rid", "codes").mapInArrow(run, "rid bigint, model double"), "lm-scored")
    rest = encoded.select("rid", F.explode("rare").alias("word")).join(vocab, "word").groupBy("rid").agg(F.count("*").alias("more"), F.count_if(F.col("n") == 1).alias("once"), F.sum(F.log10(F.col("n") + 1)).alias("logs"))
    more, once, logs = F.coalesce("more", F.lit(0)), F.coalesce("once", F.lit(0)), F.coalesce("logs", F.lit(0.0))
    return encoded.drop("rare", "codes").join(scored, "rid").join(rest, "rid", "left").select(
        "id",
        (common.id_bucket_column(F.col("id"), FOLDS) == HELD_OUT).alias("held_out"),
        "n_tokens",
        (F.col("known") + more).alias("n_known"),
        F.lit(v.total).cast("bigint").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_tokens") * F.lit(v.log_total)).alias("base_score"),
        (F.col("inner") + F.col("model") + logs).alias("score"),
        (F.col("single") + once).alias("n_single"),
    )
