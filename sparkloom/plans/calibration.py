"""Losses and choices from logits: windows of tokens, log-softmax, divergence, accuracy and margin.

Logits are rows of an array column, one row per token; a row never leaves its record, so log-softmax and
everything made of it is a projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import let


def token_windows(ids: Column, width: int, most: int | None = None) -> Column:
    """Consecutive windows of ``width`` tokens; one that would end exactly with the text is left out."""

    def cut(x):
        last = F.floor((F.size(x) - 1) / width).cast("int")
        n = last if most is None else F.least(last, F.lit(most))
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda k: F.slice(x, k * width + 1, F.lit(width)))).otherwise(F.slice(F.array(x), 1, 0))

    return let(ids, cut)


def log_softmax(logits: Column) -> Column:
    """Shifted by the largest logit, so nothing overflows."""


    def shifted(x, top):
        total = F.aggregate(x, F.lit(0.0), lambda a, v: a + F.exp(v - top))
        return let(top + F.ln(total), lambda off: F.transform(x, lambda v: v - off))

    return let(F.transform(logits, lambda x: x.cast("double")), lambda x: let(F.array_max(x), lambda top: shifted(x, top)))


def divergence(reference: Column, candidate: Column) -> Column:
    """KL of two rows of log probabilities."""
    return F.aggregate(F.zip_with(reference, candidate, lambda p, q: F.exp(p) * (p - q)), F.lit(0.0), lambda a, x: a + x)


def token_losses(rows: DataFrame) -> DataFrame:
    """(win, nll_ref, nll, kl) of rows (win, pos, reference, candidate, target): logits of both sides and the next token."""
    lp = rows.select("win", log_softmax(F.col("reference")).alias("p"), log_softmax(F.col("candidate")).alias("q"), F.col("target").cast("int").alias("t"))
    return lp.select("win", (-F.get("p", F.col("t"))).alias("nll_ref"), (-F.get("q", F.col("t"))).alias("nll"), divergence(F.col("p"), F.col("q")).alias("kl"))


def losses(rows: DataFrame) -> DataFrame:
    """One row: mean over windows of the windows' means, and what the candidate loses."""
    per = token_losses(rows).groupBy("win").agg(F.avg("nll_ref").alias("nll_ref"), F.avg("nll").alias("nll"), F.avg("kl").alias("kl"))
    return per.agg(F.avg("nll_ref").alias("nll_ref"), F.avg("nll").alias("nll"), F.avg(F.col("nll") - F.col("nll_ref")).alias("delta_ce"), F.avg("kl").alias("kl"))


def continuation(logprobs: DataFrame, tokens: DataFrame) -> DataFrame:
    """(id, option, total): log probability of each continuation.

    ``logprobs`` (id, option, pos, lp array), ``tokens`` (id, option, at, token): the token at offset ``at``
    behind a prompt whose last position is ``pos`` 0.
    """
    one = tokens.join(logprobs, (tokens["id"] == logprobs["id"]) & (tokens["option"] == logprobs["option"]) & (tokens["at"] == logprobs["pos"]))
    return one.select(tokens["id"], tokens["option"], F.get("lp", F.col("token").cast("int")).alias("x")).groupBy("id", "option").agg(F.sum("x").alias("total"))


def choices(scores: DataFrame) -> DataFrame:
    """(id, right, margin) of scores (id, option, answer, score): whether the best option (of equals, the first) is the answer."""
    mine = F.col("option") == F.col("answer")
    best = F.max_by("option", F.struct("score", F.negative(F.ascii("option")).alias("first")))
    return scores.groupBy("id").agg((best == F.first("answer")).alias("right"), (F.max(F.when(mine, F.col("score"))) - F.max(F.when(~mine, F.col("score")))).alias("margin"), F.bool_or(mine).alias("known"))


def choice_metrics(letter: DataFrame, whole: DataFrame) -> DataFrame:
    """One row: questions, those skipped, accuracy by letter and by text, mean margin; questions whose answer is no option are skipped."""
    a = choices(letter)
    b = choices(whole).select("id", F.col("right").alias("right_text"))
    known = F.col("known")
    mean = lambda c, n: F.coalesce(F.avg(F.when(known, c)), F.lit(0.0)).alias(n)
    return a.join(b, "id", "left").agg(F.count_if(known).alias("n_questions"), F.count_if(~known).alias("n_skipped"), mean(F.col("right").cast("int"), "mc_letter_acc"), mean(F.col("right_text").cast("int"), "mc_text_acc"), mean(F.col("margin"), "mean_letter_margin"))
