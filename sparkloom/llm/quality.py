"""Quality rules with thresholds that adapt to each language and source (DataFrame functions only).

Every document gets counts (words, symbols, repeated lines, repeated passages).  Rates made of
these counts are summarised per (language, source) in a mergeable quantile sketch: values fall in
logarithmic bins whose counts add up, so partial sketches of any partitioning merge to the same
result, with a bounded relative error and no randomness.  No limit is set by hand; two come from the
sketch, and the lower one holds:

* the fence: the median plus the distance to the 90 % point, times ``t ** REACH``, where t says how much
  farther the 95 % point lies, so heavy tails get a wider fence.  Rates that are zero in nine of ten
  documents have no fence;
* the valley: where a mode of outliers stands apart from the bulk, it begins after ``VALLEY`` doublings
  of the rate that hold next to no documents.

A group of fewer than ``MIN_GROUP`` documents can't tell its 95 % point; it uses the merged sketch of its
language, and if that is too small as well the sketch of all documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

SYMBOLS = "#*$%&|<>"
#: rate per 1000 words -> what it counts.
RATES = {"symbols_pm": "n_symbols", "dup_lines_pm": "n_dup_lines", "repeat_pm": "n_repeat_words", "word_len_pm": "word_chars"}
ACCURACY = 0.01
#: Powers of the tail's weight that a fence lies away: from the 95 % point on, about six halvings of what lies beyond.
REACH = 6
#: Bins that make one doubling of the rate, and doublings that an outlier mode stands apart.
DOUBLING, VALLEY = 35, 7
#: The valley holds less than this part of what lies above it; the bulk below is three quarters at least.
EMPTY, BULK = 8, 75
MIN_GROUP = 50
#: Up to so many thresholds are sent to every executor; beyond, they are joined by shuffle.
BROADCAST_GROUPS = 20_000
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeats(words: Column) -> Column:
    """Words that stand in a 5-word window which the text holds at least twice."""

    def windows(h: Column) -> Column:
        return F.when(F.size(h) < 5, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.slice(h, F.lit(1), F.greatest(F.size(h) - 4, F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, 5)]))
        )

    def twice(s: Column) -> Column:
        """Positions of windows whose neighbour in sorted order has the same hash."""
        same = lambda a, b: F.get(s, a)["h"].eqNullSafe(F.get(s, b)["h"])
        return F.filter(F.transform(s, lambda e, i: F.when(((i > 0) & same(i - 1, i)) | ((i < F.size(s) - 1) & same(i + 1, i)), e["p"])), lambda p: p.isNotNull())

    def covered(w: Column) -> Column:
        pairs = F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        at = F.array_sort(common.let(pairs, twice))
        start = F.struct(F.lit(-5).alias("last"), F.lit(0).cast("bigint").alias("n"))
        step = lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(5), p - a["last"])).alias("n"))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("bigint")).otherwise(F.aggregate(at, start, step, lambda a: a["n"]))

    return common.let(common.let(F.transform(words, lambda w: F.xxhash64(w)), windows), covered)


def rule_counts(text: Column) -> Column:
    """A struct of the counts in ``STATS``; null counts as empty text, which has zero everywhere."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.ltrim(F.translate(x, common.SPACE[1:], " " * 5))) > 0)
    long = lambda c: c.cast("bigint")
    return F.struct(
        common.let(words, lambda w: F.struct(long(F.size(w)).alias("n_words"), _repeats(w).alias("n_repeat_words"))).alias("w"),
        long(F.length(F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", ""))).alias("word_chars"),
        long(F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]+", ""))).alias("n_symbols"),
        common.let(lines, lambda x: long(F.size(x) - F.size(F.array_distinct(x)))).alias("n_dup_lines"),
    )


def _names(docs: DataFrame, out: str) -> str:
    """A prefix that begins no column of ``docs``."""
    while any(c.lower().startswith(out.lower()) for c in docs.columns):
        out += "_"
    return out


def with_counts(docs: DataFrame, text: str = "text", out: str = "q_") -> DataFrame:
    """Append the counts, named ``out`` + name, and ``out`` + base_failed; null text counts as empty."""
    s = common.free(docs, f"{out}struct")[0]
    got = lambda n: F.col(s)["w"][n] if n in ("n_words", "n_repeat_words") else F.col(s)[n]
    bare = docs.withColumn(s, rule_counts(common.column(text))).select(*common.columns(docs), *[got(n).alias(f"{out}{n}") for n in STATS])
    return bare.withColumn(f"{out}base_failed", (F.col(f"{out}n_words") < 10) | (100 * F.col(f"{out}n_repeat_words") > 20 * F.col(f"{out}n_words")))


def _rate(rate: str, out: str) -> Column:
    return F.expr(f"1000 * {out}{RATES[rate]} div greatest({out}n_words, 1)")


def _sketch(counted: DataFrame, lang: str, source: str, out: str) -> DataFrame:
    """(lang, source, rate, bin, n): log bins of ratio (1 + accuracy) / (1 - accuracy); bin -1 holds zeros."""
    step = math.log((1 + ACCURACY) / (1 - ACCURACY))
    rates = F.explode(F.array(*[F.struct(F.lit(r).alias("rate"), _rate(r, out).alias("v")) for r in RATES])).alias("r")
    long = counted.where(~F.col(f"{out}base_failed")).select(common.column(lang).alias("lang"), common.column(source).alias("source"), rates)
    bin_ = F.when(F.col("r.v") <= 0, F.lit(-1)).otherwise(F.ceil(F.ln(F.col("r.v").cast("double")) / F.lit(step)).cast("int"))
    return long.groupBy("lang", "source", F.col("r.rate").alias("rate"), bin_.alias("bin")).agg(F.count("*").alias("n"))


def _limits(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, rate, total, limit) of each merged sketch; the limit is null where neither fence nor valley exists."""
    gamma = (1 + ACCURACY) / (1 - ACCURACY)
    by = Window.partitionBy(*keys, "rate")
    merged = sketch.groupBy(*keys, "rate", "bin").agg(F.sum("n").alias("n"))
    ranked = merged.select(*keys, "rate", "bin", F.sum("n").over(by.orderBy("bin")).alias("upto"), F.sum("n").over(by).alias("total"))
    at = lambda q: F.min(F.when(F.col("upto") * 100 >= F.col("total") * q, F.col("bin")))
    value = lambda b: F.when(F.col(b) < 0, F.lit(0.0)).otherwise(F.pow(F.lit(gamma), F.col(b)))
    near, far = value("b90") - value("b50"), value("b95") - value("b50")
    fence = F.when(F.col("b90") > F.col("b50"), value("b50") + near * F.pow(far / near, F.lit(REACH)))
    fences = ranked.groupBy(*keys, "rate").agg(F.max("total").alias("total"), at(50).alias("b50"), at(90).alias("b90"), at(95).alias("b95")).select(*keys, "rate", "total", fence.alias("limit"))

    doubled = merged.groupBy(*keys, "rate", F.floor(F.col("bin") / DOUBLING).cast("int").alias("d")).agg(F.sum("n").alias("n"))
    upto = lambda k: F.coalesce(F.sum("n").over(by.orderBy("d").rangeBetween(Window.unboundedPreceding, k)), F.lit(0))
    parts = doubled.select(*keys, "rate", "d", F.sum("n").over(by).alias("total"), upto(-1).alias("below"), upto(-1 - VALLEY).alias("bulk"))
    apart = (EMPTY * (F.col("below") - F.col("bulk")) < F.col("total") - F.col("below")) & (F.col("bulk") * 100 >= F.col("total") * BULK)
    valleys = parts.where(apart).groupBy(*keys, "rate").agg(F.min("d").alias("d")).select(*keys, "rate", F.lit(0).cast("bigint").alias("total"), F.pow(F.lit(gamma), F.col("d") * DOUBLING - 1).alias("limit"))
    return fences.unionByName(valleys).groupBy(*keys, "rate").agg(F.max("total").alias("total"), F.min("limit").alias("limit"))


def thresholds(counted: DataFrame, lang: str = "lang", source: str = "source", out: str = "q_") -> DataFrame:
    """One row (t_lang, t_source, t_<rate>...) per language and source; a null limit rejects nothing."""
    sketch = common.stored(_sketch(counted, lang, source, out), "quality-sketch")
    name = lambda df, tail: df.select(*[F.col(c).alias(f"{c}_{tail}") for c in df.columns])
    o, l, a = name(_limits(sketch, ["lang", "source"]), "o"), name(_limits(sketch, ["lang"]), "l"), name(_limits(sketch, []), "a")
    joined = o.join(l, F.col("lang_o").eqNullSafe(F.col("lang_l")) & (F.col("rate_o") == F.col("rate_l")), "left").join(a, F.col("rate_o") == F.col("rate_a"), "left")
    limit = F.when(F.col("total_o") >= MIN_GROUP, F.col("limit_o")).when(F.col("total_l") >= MIN_GROUP, F.col("limit_l")).otherwise(F.col("limit_a"))
    return joined.groupBy(F.col("lang_o").alias("t_lang"), F.col("source_o").alias("t_source")).agg(*[F.max(F.when(F.col("rate_o") == r, limit)).alias(f"t_{r}") for r in RATES])


def judged(counted: DataFrame, lang: str = "lang", source: str = "source", out: str = "q_") -> DataFrame:
    """Append ``out`` + kept to a table that ``with_counts`` made.

    Kept means: the base rules pass and no rate exceeds its group's limit.  Groups are compared
    null-safely, so rows without language or source form groups of their own.  An empty table
    gives an empty table; repeated rows are judged alike, each counting in the sketch.
    """
    p = _names(counted, f"{out}limit_")
    limits = common.stored(thresholds(counted, lang, source, out), "quality-limits")
    held = limits.count()
    limits = limits.select(*[F.col(c).alias(p + c) for c in limits.columns])
    same = common.column(lang).eqNullSafe(F.col(f"{p}t_lang")) & common.column(source).eqNullSafe(F.col(f"{p}t_source"))
    if held <= BROADCAST_GROUPS:
        joined = counted.join(F.broadcast(limits), same, "left")
    else:  # hot groups are spread over 32 copies of their limit
        salt = F.pmod(F.xxhash64(*[f"{out}{n}" for n in STATS]), F.lit(32)).cast("int")
        joined = counted.withColumn(f"{p}salt", salt).join(limits.withColumn(f"{p}copy", F.explode(F.sequence(F.lit(0), F.lit(31)))), same & (F.col(f"{p}salt") == F.col(f"{p}copy")), "left")
    fine = ~F.col(f"{out}base_failed")
    for r in RATES:
        fine = fine & (_rate(r, out) <= F.coalesce(F.col(f"{p}t_{r}"), F.lit(float("inf"))))
    return joined.select(*common.columns(counted), fine.alias(f"{out}kept"))


def quality_filter(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The documents that pass, with their columns as they were, whatever their names.

    The counts are computed once and written beside the documents: the sketch reads a few narrow columns
    of that table, the filter all of it, and no document moves between tasks.  Null and empty texts
    fail the base rules; repeated rows pass or fail together; an empty table gives an empty table.
    """
    out = _names(docs, "q_")
    return judged(common.stored(with_counts(docs, text, out), "quality-counted"), lang, source, out).where(F.col(f"{out}kept")).select(*common.columns(docs))
