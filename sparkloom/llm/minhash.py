"""Near-duplicate groups by circulant MinHash, banding and exact verification.

Two random permutations make the whole signature: the first scatters the shingles of a set over the
universe, the second, circularly shifted by k places, orders them for coordinate k.  Signatures are
cut in bands; sets that agree in a band are candidates.  Before that, equal sets collapse to one
class, so copies never meet in pairs.  Small buckets compare all their classes; in large ones every
class meets a few pivots first, those that share most with the bucket.  Classes that this doesn't
connect to the bucket's largest component meet the rest only where a link is possible at all: two
sets that are similar enough share one of their rarest shingles, within a prefix whose length follows
from both sizes.  That filter is exact, so no link is lost and no group expands into all pairs.  A
link counts only after the full sets were compared.
"""

from __future__ import annotations

from functools import cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components
from .token_counts import raw

UNIVERSE = 1 << 20
BANDS, ROWS = 32, 4
#: Coordinates of a signature; the bands use the first BANDS * ROWS of them.
COORDINATES = 256
WORDS = 5
PERCENT = 80
#: Buckets of up to so many classes compare all of them; larger ones begin with pivots.
SMALL = 16
PIVOTS = 4
REMEMBERED = 500_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    def __missing__(self, word):
        import xxhash

        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def shingles(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; ASCII letters count in lower case."""
    w = text.lower().split()
    if not w:
        return np.empty(0, "uint64")
    h = np.fromiter(map(_words.__getitem__, w), "uint64", len(w))
    n = min(words, len(w))
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out *= _MIX
        out ^= out >> np.uint64(29)
        out += h[k : len(h) - n + 1 + k]
    out ^= out >> np.uint64(32)
    return np.unique(out)


@cache
def _permutations(seed: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first permutation, and a view whose row i holds the second one's values from i on."""
    r = np.random.default_rng(seed)
    first, second = r.permutation(UNIVERSE).astype("int32"), r.permutation(UNIVERSE).astype("int32")
    return first, np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[:size]]), size)


def signature(hashes: np.ndarray, size: int = COORDINATES, seed: int = 1) -> np.ndarray:
    """Least value of each shifted permutation over the set, which must not be empty."""
    first, shifted = _permutations(seed, size)
    at = first[(hashes & np.uint64(UNIVERSE - 1)).astype("int64")]
    return np.min([shifted[at[k : k + 20_000]].min(axis=0) for k in range(0, len(at), 20_000)], axis=0)


def sketch(sig: np.ndarray) -> np.ndarray:
    """The lowest two bits of every coordinate, 32 coordinates to a 64-bit number."""
    two = (sig & 3).reshape(-1, 32).astype("uint64") << np.arange(0, 64, 2, dtype="uint64")
    return np.bitwise_or.reduce(two, axis=1).view("int64")


def _may_link(percent: int):
    """Whether two sketches leave it possible that the sets are similar enough.

    Unequal coordinates differ in their two bits three times out of four.  The bound lies 5.2 standard
    deviations above the expectation at the threshold, so like banding it misses less than one in a million.
    """
    p = 0.75 * (1 - percent / 100)
    most = int(COORDINATES * p + 5.2 * (COORDINATES * p * (1 - p)) ** 0.5) + 1
    differ = F.lit(0)
    for k in range(COORDINATES // 32):
        x = F.get("sketch", F.lit(k)).bitwiseXOR(F.get("sketch2", F.lit(k)))
        differ = differ + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    return differ <= most


def bands(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band; keys of different bands differ."""
    s = sig[: BANDS * rows].reshape(-1, rows).astype("uint64")
    out = np.arange(1, len(s) + 1, dtype="uint64") * np.uint64(0xD6E8FEB86659FD93)
    for k in range(rows):
        out = (out ^ s[:, k]) * _MIX
        out ^= out >> np.uint64(31)
    return out.view("int64")


def _signed(words: int):
    def run(batches):
        number = TaskContext.get().partitionId() << 33
        for b in common.pieces(batches, "text"):
            n, digests, keys, sketches = [], [], [], []
            for x in raw(b.column("text")):
                s = shingles(x, words)
                n.append(len(s))
                digests.append(blake2b(s.tobytes(), digest_size=16).digest())
                sig = signature(s) if len(s) else np.empty(0, "int32")
                keys.append(bands(sig))
                sketches.append(sketch(sig))
            yield pa.RecordBatch.from_arrays([pa.array(range(number, number + len(n)), pa.int64()), b.column("id"), b.column("x_file"), b.column("x_row"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))], ["rid", "id", "x_file", "x_row", "n", "digest", "bands", "sketch"])
            number += len(n)
        _words.clear()  # idle workers hold nothing
        common.trim()

    return run


def _hashed(words: int):
    def run(batches):
        for b in common.pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("cid"), pa.array([shingles(x, words).view("int64") for x in raw(b.column("text"))], pa.list_(pa.int64()))], ["cid", "hashes"])
        _words.clear()
        common.trim()

    return run


def _near_sizes(percent: int):
    return F.least("n", "n2") * 100 >= F.greatest("n", "n2") * percent


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of a plain file scan: id, x_file, x_row, n_shingles, component_id, kept.

    The component is the smallest id reachable by links of Jaccard similarity ``percent``.  Texts that
    are null, empty or without words have an empty set, link with nothing and stand alone.  Texts of
    fewer than ``words`` words have one shingle, the whole sequence.  Of rows with the same id only
    the one first in file order is kept; null ids are never a component's id unless alone in it.
    An empty table gives an empty table; columns other than ``key`` and ``text`` aren't read.
    """
    common.small_batches(docs.sparkSession)
    places = common.located(docs, id=key, text=text)
    signed = places.mapInArrow(_signed(words), f"rid bigint, id {places.schema['id'].dataType.simpleString()}, x_file string, x_row bigint, n bigint, digest binary, bands array<bigint>, sketch array<bigint>")
    signed = common.stored(signed, "near-signatures")
    classes = signed.where("n > 0").groupBy("digest").agg(F.min("rid").alias("cid"))
    members = common.stored(signed.where("n > 0").select("rid", "id", "x_file", "x_row", "n", "digest").join(classes, "digest").drop("digest"), "near-members")
    heads = members.where("rid = cid").select("cid", "x_file", "x_row", "n")
    marks = signed.select(F.col("rid").alias("cid"), "sketch")

    banded = signed.where("n > 0").join(heads.select("cid"), F.col("rid") == F.col("cid"), "left_semi").select(F.col("rid").alias("cid"), "n", F.explode("bands").alias("bucket"))
    shared = common.stored(banded.groupBy("bucket").agg(F.count("*").alias("held"), F.min("cid").alias("least")).where("held > 1"), "near-buckets")
    rows = common.stored(banded.join(shared, "bucket"), "near-rows")
    small, large = rows.where(F.col("held") <= SMALL), rows.where(F.col("held") > SMALL)
    score = large.groupBy("cid").agg(F.sum("held").alias("score"))
    big = common.stored(large.join(score, "cid").join(marks, "cid"), "near-big")
    other = lambda df: df.select("bucket", F.col("cid").alias("cid2"), F.col("n").alias("n2"))
    pairs = small.join(other(small), "bucket").where((F.col("cid") < F.col("cid2")) & _near_sizes(percent)).select(F.col("cid").alias("a"), F.col("cid2").alias("b"))
    rank = F.struct("score", F.col("cid").alias("cid2"), F.col("n").alias("n2"), F.col("sketch").alias("sketch2"))
    best = [F.max(F.when(F.pmod(F.xxhash64("cid"), F.lit(PIVOTS)) == k, rank)).alias(f"p{k}") for k in range(PIVOTS)]
    pivots = big.groupBy("bucket").agg(*best).select("bucket", F.explode(F.array(*[f"p{k}" for k in range(PIVOTS)])).alias("p")).where("p is not null").select("bucket", "p.cid2", "p.n2", "p.sketch2")
    starred = big.join(pivots, "bucket").where((F.col("cid") != F.col("cid2")) & _near_sizes(percent) & _may_link(percent)).select(F.least("cid", "cid2").alias("a"), F.greatest("cid", "cid2").alias("b"))
    pairs = common.stored(_likely(pairs.distinct(), marks, percent).unionByName(starred).distinct(), "near-pairs")
    links = _confirmed(places, heads, pairs, words, percent)
    found = common.stored(components(links), "near-components")

    if big.head(1):
        placed = common.stored(big.join(found, F.col("cid") == F.col("node"), "left").select("bucket", "cid", "n", F.coalesce("component", "cid").alias("component")), "near-placed")
        main = placed.groupBy("bucket", "component").agg(F.count("*").alias("of")).groupBy("bucket").agg(F.max(F.struct("of", "component")).alias("m")).select("bucket", F.col("m.component").alias("main"))
        late = common.stored(placed.join(main, "bucket").where("component <> main").select("bucket", "cid"), "near-late")
        if late.head(1):
            asked = placed.join(late.select("bucket").distinct(), "bucket", "left_semi").groupBy("cid").agg(F.first("n").alias("n"), F.first("component").alias("component"))
            asked = asked.join(late.select("cid").distinct().withColumn("late", F.lit(True)), "cid", "left").join(marks, "cid").select("cid", "n", "component", F.coalesce("late", F.lit(False)).alias("late"), "sketch")
            more = common.stored(_prefix_pairs(places, heads, common.stored(asked, "near-asked"), words, percent), "near-pairs")
            extra = _confirmed(places, heads, more, words, percent)
            found = common.stored(components(links.unionByName(extra)), "near-components")
        common.done_with(placed, late)

    grouped = common.stored(members.join(found, F.col("cid") == F.col("node"), "left").select("id", "x_file", "x_row", F.col("n").alias("n_shingles"), F.coalesce("component", "cid").alias("c")), "near-grouped")
    best = F.struct(F.col("id").isNull().alias("no_id"), "id", "x_file", "x_row")
    tops = grouped.groupBy("c").agg(F.min(best).alias("top"))
    is_top = (F.col("x_file") == F.col("top.x_file")) & (F.col("x_row") == F.col("top.x_row"))
    linked = grouped.join(tops, "c").select("id", "x_file", "x_row", "n_shingles", F.col("top.id").alias("component_id"), is_top.alias("kept"))
    common.done_with(members, shared, rows, big, pairs, links, found)
    return linked.unionByName(signed.where("n = 0").select("id", "x_file", "x_row", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"), F.lit(True).alias("kept")))


def _likely(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sketches leave a link possible: narrow rows, before full sets are moved."""
    side = lambda c, name: marks.select(F.col("cid").alias(c), F.col("sketch").alias(name))
    return pairs.join(side("a", "sketch"), "a").join(side("b", "sketch2"), "b").where(_may_link(percent)).select("a", "b")


def _prefix_pairs(places: DataFrame, heads: DataFrame, asked: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b): all pairs of ``asked`` (cid, n, component, late, sketch) that may be linked, one of them late, in different components.

    Sets of sizes n and m that are similar enough share at least k = percent (n + m) / (100 + percent)
    shingles.  In any order common to both, the first n - k + 1 of one and the first m - k + 1 of the other
    then have one in common; the rarest first makes that rare.  Where many sets share even their rarest
    shingles, the sketches, compared in the join itself, keep unlike sets from becoming rows.
    """
    sets = common.stored(_sets(places, heads, asked.select("cid"), words), "near-asked-sets")
    cells = sets.select("cid", F.explode("hashes").alias("z"))
    counted = cells.join(cells.groupBy("z").agg(F.count("*").alias("f")), "z")
    first = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    ordered = counted.groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("f", "z"))).alias("order")).join(asked, "cid")
    kinds = ("n", "component", "late", "sketch")
    posted = ordered.select("cid", *kinds, F.posexplode(F.slice("order", F.lit(1), first.cast("int"))).alias("at", "o")).where("o.f > 1")
    posted = common.stored(posted.select(F.col("o.z").alias("z"), "cid", *kinds, "at"), "near-posted")
    other = posted.select("z", *[F.col(c).alias(f"{c}2") for c in ("cid", *kinds, "at")])
    least = F.ceil((F.col("n") + F.col("n2")) * percent / (100 + percent))
    fits = (F.col("component") != F.col("component2")) & (~F.col("late2") | (F.col("cid") < F.col("cid2"))) & _near_sizes(percent) & (F.col("at") <= F.col("n") - least) & (F.col("at2") <= F.col("n2") - least) & _may_link(percent)
    return posted.where("late").join(other, "z").where(fits).select(F.least("cid", "cid2").alias("a"), F.greatest("cid", "cid2").alias("b")).distinct()


def _sets(places: DataFrame, heads: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(cid, hashes) of the wanted classes, from the text of their first member."""
    at = heads.join(wanted, "cid").select("cid", "x_file", "x_row")
    return places.select("text", "x_file", "x_row").join(at, ["x_file", "x_row"]).select("cid", "text").mapInArrow(_hashed(words), "cid bigint, hashes array<bigint>")


def _confirmed(places: DataFrame, heads: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; Spark intersects them, one pair at a time."""
    wanted = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct()
    sets = common.stored(_sets(places, heads, wanted, words), "near-sets")
    side = lambda c, name: sets.select(F.col("cid").alias(c), F.col("hashes").alias(name))
    both = pairs.join(side("a", "left"), "a").join(side("b", "right"), "b")
    both = both.select("a", "b", F.size(F.array_intersect("left", "right")).alias("shared"), (F.size("left") + F.size("right")).alias("sizes"))
    links = common.stored(both.where(F.col("shared") * 100 >= percent * (F.col("sizes") - F.col("shared"))).select("a", "b"), "near-links")
    common.done_with(sets)
    return links


def near_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of each group of a plain file scan, with its columns as they were, whatever their names.

    Rows of a group are ordered by id (null last), then by place, so exactly one stays of rows that agree
    in everything.  Null and empty texts all stay.  An empty table gives an empty table.
    """
    return common.placed(docs, near_groups(docs, key, text, words, percent).where("kept"))
