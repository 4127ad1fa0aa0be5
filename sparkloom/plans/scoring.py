"""Scores of evaluation runs: pairing, consistency, rates by side and category, promotion gates.

Inputs are tables of run records; every score is a join on the question and a grouped aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import VerifyError
from ..functions import text

#: Most percentage points that a candidate may lose in clean accuracy and gain in anomalies.
MAX_ACCURACY_GAP, MAX_ANOMALY_GAP = 5.0, 2.0


def scored_side(runs: DataFrame) -> DataFrame:
    """Runs (id, raw_output, truncated, ...) with final, normal and anomalies."""
    flag = F.lit(False)
    for c in ("truncated", "truncated_suspect"):
        if c in runs.columns:
            flag = flag | F.coalesce(F.col(c), F.lit(False))
    raw = F.coalesce("raw_output", F.lit(""))
    with_final = runs.withColumn("final", text.extract_final(raw))
    return with_final.withColumn("normal", text.norm(F.col("final"))).withColumn("anomalies", text.detect_anomalies(F.col("raw_output"), F.col("final"), flag))


def paired(questions: DataFrame, source: DataFrame, candidate: DataFrame, partial: bool = False) -> DataFrame:
    """One row per question that both sides answered, scored on both; missing answers are an error unless ``partial``."""
    if not partial:
        for name, side in (("source", source), ("candidate", candidate)):
            gap = questions.join(side, "id", "left_anti").agg(F.count("*").alias("n"), F.min("id").alias("id")).first()
            if gap.n:
                raise VerifyError(f"the {name} side lacks {gap.n} questions, such as {gap.id!r}")
    joined = questions
    for name, side in (("source", source), ("candidate", candidate)):
        s = scored_side(side)
        times = [F.col(c).alias(f"{name}_{c}") for c in ("gen_s", "load_s", "eval_s") if c in s.columns]
        joined = joined.join(s.select("id", F.col("final").alias(f"{name}_final"), F.col("normal").alias(f"{name}_normal"), F.col("anomalies").alias(f"{name}_anomalies"), *times), "id")
    return judged(joined)


def judged(items: DataFrame) -> DataFrame:
    """Items (checks and both sides' final, normal and anomalies) with verdicts and agreement; also for stored items whose checks changed."""
    ok = lambda side: text.gated_correct(F.col("checks"), F.col(f"{side}_final"), F.col(f"{side}_normal"), F.col(f"{side}_anomalies"))
    return items.withColumn("source_correct", ok("source")).withColumn("candidate_correct", ok("candidate")).withColumn("agree", F.col("source_normal") == F.col("candidate_normal")).withColumn("scored", F.get("checks", F.lit(0))["type"] != "open")


def changed_verdicts(before: DataFrame, after: DataFrame) -> DataFrame:
    """Ids whose verdict on a side, or agreement, differs between two judgements."""
    columns = ("source_correct", "candidate_correct", "agree")
    both = before.select("id", *[F.col(c).alias(f"{c}_before") for c in columns]).join(after.select("id", *columns), "id")
    differ = F.lit(False)
    for c in columns:
        differ = differ | ~F.col(c).eqNullSafe(F.col(f"{c}_before"))
    return both.where(differ)


def rate(flag: Column) -> Column:
    return F.avg(flag.cast("int"))


def summary(items: DataFrame) -> DataFrame:
    """One row: numbers of questions, accuracies, rates of agreement and anomalies, flips."""
    scored = F.col("scored")
    of_scored = lambda c: F.avg(F.when(scored, c.cast("int")))
    same = F.col("source_correct") == F.col("candidate_correct")
    odd = lambda side: rate(F.size(f"{side}_anomalies") > 0)
    return items.agg(
        F.count("*").alias("n_questions"), F.count_if(scored).alias("n_scored"), F.count_if(~scored).alias("n_open"),
        of_scored(F.col("source_correct")).alias("source_accuracy"), of_scored(F.col("candidate_correct")).alias("candidate_accuracy"),
        rate(F.col("agree")).alias("agreement"), of_scored(same).alias("verdict_agreement"), F.count_if(scored & ~same).alias("n_flips"),
        odd("source").alias("source_anomaly_rate"), odd("candidate").alias("candidate_anomaly_rate"),
    )


def flips(items: DataFrame) -> DataFrame:
    """(id) of the scored questions on which the sides' verdicts differ."""
    return items.where(F.col("scored") & (F.col("source_correct") != F.col("candidate_correct"))).select("id")


def by_category(items: DataFrame) -> DataFrame:
    return items.where("scored").groupBy("category").agg(F.count_if("source_correct").alias("source_correct"), F.count_if("candidate_correct").alias("candidate_correct"), F.count("*").alias("n"))


def anomaly_breakdown(items: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """(*by, anomaly, n), most frequent first."""
    return items.select(*by, F.explode(column).alias("anomaly")).groupBy(*by, "anomaly").agg(F.count("*").alias("n")).orderBy(*by, F.desc("n"), "anomaly")


def timings(rows: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Total to one place, mean and exact median to two; nulls don't count."""
    return rows.groupBy(*by).agg(F.round(F.sum(column), 1).alias("total_s"), F.round(F.avg(column), 2).alias("mean_s"), F.round(F.median(column), 2).alias("median_s"))


def parameters(runs: DataFrame, side: str = "side") -> DataFrame:
    """(side, settings): the distinct (max_tokens, temp) of each side."""
    return runs.groupBy(side).agg(F.collect_set(F.struct("max_tokens", "temp")).alias("settings"))


def check_parameters(runs: DataFrame, side: str = "side") -> tuple[int, float]:
    """The one setting that all runs of all sides share; anything else is an error."""
    got = runs.agg(F.slice(F.array_sort(F.collect_set(F.struct("max_tokens", "temp"))), 1, 5).alias("s")).first().s
    if len(got) != 1 or got[0].max_tokens is None or got[0].temp is None:
        raise VerifyError(f"runs with different settings can't be compared: {got}")
    return int(got[0].max_tokens), float(got[0].temp)


def side_problems(runs: DataFrame, side: str = "side") -> DataFrame:
    """(id, problem): ids that a side lacks, or whose key or prompt differs between sides."""
    sides = runs.select(side).distinct().count()
    seen = runs.groupBy("id").agg(F.count_distinct(side).alias("sides"), F.count_distinct(F.coalesce("answer_key", F.lit(""))).alias("keys"), F.count_distinct(F.coalesce("prompt_sha256", F.lit(""))).alias("prompts"))
    problem = F.when(F.col("sides") < sides, "coverage").when(F.col("keys") > 1, "answer key").when(F.col("prompts") > 1, "prompt")
    return seen.select("id", problem.alias("problem")).where("problem is not null")


def check_sides(runs: DataFrame, side: str = "side") -> None:
    if bad := side_problems(runs, side).orderBy("id").limit(5).collect():
        raise VerifyError(f"the sides don't cover the same questions: {[(r.id, r.problem) for r in bad]}")
    check_parameters(runs, side)


def choice_scores(runs: DataFrame, side: str = "side") -> DataFrame:
    """One row per side of multiple-choice runs (letter, answer_key, raw_output, truncated, repetition, extra_text, gen_s)."""
    odd = runs.withColumn("anomalies", text.choice_anomalies(F.col("raw_output"), F.col("letter"), F.col("repetition"), F.col("truncated")))
    right, clean = F.col("letter").eqNullSafe(F.col("answer_key")), F.size("anomalies") == 0
    alone = F.col("letter").isNotNull() & ~F.coalesce("extra_text", F.lit(False))
    return odd.groupBy(side).agg(F.count("*").alias("n"), rate(right).alias("accuracy"), rate(right & clean).alias("clean_accuracy"), rate(~clean).alias("anomaly_rate"), F.sum(F.size("anomalies")).alias("anomaly_events"), rate(alone).alias("letter_only_compliance"), F.round(F.median("gen_s"), 3).alias("median_gen_s"), F.round(F.sum("gen_s"), 1).alias("total_gen_s"))


def gate(scores: DataFrame, source: str, side: str = "side") -> DataFrame:
    """Scores with the gaps to the source side in percentage points and whether a candidate passes (null for the source)."""
    base = scores.where(F.col(side) == source).select(F.col("clean_accuracy").alias("base_accuracy"), F.col("anomaly_rate").alias("base_anomalies"))
    both = scores.crossJoin(F.broadcast(base))  # one row
    lost, more = (F.col("base_accuracy") - F.col("clean_accuracy")) * 100, (F.col("anomaly_rate") - F.col("base_anomalies")) * 100
    passed = F.when(F.col(side) != source, (lost <= MAX_ACCURACY_GAP) & (more <= MAX_ANOMALY_GAP))
    return both.select(*scores.columns, F.round(lost, 2).alias("accuracy_gap_pp"), F.round(more, 2).alias("anomaly_gap_pp"), passed.alias("passed"))


def generation_bar(outputs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Whether generated texts (output) clear the bar: none empty, nearly all printable, the longest of 30 characters or more."""
    fine = F.bool_and(text.strip(F.col("output")) != "") & F.bool_and(text.printable_share_of_all(F.col("output")) > 0.9) & (F.max(F.length("output")) >= 30)
    return outputs.groupBy(*by).agg(fine.alias("passed"))


def rollup(stages: DataFrame, by: Sequence[str]) -> DataFrame:
    """(*by, status, n_pass, n): PASS if every stage is."""
    return stages.groupBy(*by).agg(F.when(F.bool_and(F.col("status") == "PASS"), "PASS").otherwise("FAIL").alias("status"), F.count_if(F.col("status") == "PASS").alias("n_pass"), F.count("*").alias("n"))


def markdown(rows: DataFrame) -> str:
    """A small result as a table."""
    cell = lambda v: f"{v:g}" if isinstance(v, float) else str("" if v is None else v)
    lines = [rows.columns, ["---"] * len(rows.columns), *[[cell(v) for v in r] for r in rows.collect()]]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)
