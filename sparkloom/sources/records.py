"""Sources of evaluation records: run records, question sets, choice sets and asset folders."""

from __future__ import annotations

import hashlib
import random
import re
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import SourceError
from ..functions import text
from . import files

RUN = "id string, prompt string, raw_output string, gen_s double, load_s double, eval_s double, eval_tokens int, truncated_suspect boolean, truncated boolean, max_tokens int, temp double"
CHOICE_RUN = "id string, answer_key string, prompt_sha256 string, raw_output string, letter string, gen_s double, truncated boolean, repetition boolean, extra_text boolean, max_tokens int, temp double"
QUESTIONS = f"max_tokens int, questions array<struct<id:string,lang:string,category:string,prompt:string,answer:string,checks:array<{text.CHECK}>>>"


def _lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with where each stands; a line that is no record fails the read."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return rows.select("*", F.col("_metadata.file_path").alias("x_file"), F.col("_metadata.file_block_start").alias("x_block"), F.monotonically_increasing_id().alias("x_line"))


def read_runs(spark: SparkSession, path: str, schema: str = RUN) -> DataFrame:
    """Run records, of which the last one of an id counts."""
    return latest(_lines(spark, path, schema), ["id"], ["x_file", "x_block", "x_line"]).drop("x_file", "x_block", "x_line")


def read_runs_strict(spark: SparkSession, path: str, schema: str = CHOICE_RUN) -> DataFrame:
    """Run records of one side: no record, a record without id or an id twice is an error."""
    rows = _lines(spark, path, schema).drop("x_file", "x_block", "x_line")
    check_unique(rows, path)
    return rows


def duplicates(rows: DataFrame, key: str = "id") -> DataFrame:
    """(key, n) of the keys that several records have; records without one count as one key."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def check_unique(rows: DataFrame, name: str) -> None:
    if not rows.head(1):
        raise SourceError(f"{name} has no records")
    if rows.where("id is null").head(1):
        raise SourceError(f"{name} has a record without id")
    if twice := duplicates(rows).orderBy("id").first():
        raise SourceError(f"{name} has the id {twice.id!r} twice")


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of the records of each key the last one: an aggregate, so before the shuffle each task sends one row a key."""
    last = F.max_by(F.struct(*rows.columns), F.struct(*order))
    return rows.groupBy(*key).agg(last.alias("x_last")).select("x_last.*")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """(id, lang, category, prompt, answer, checks, max_tokens), with the patterns of the checks normalised."""
    rows = spark.read.schema(QUESTIONS).option("multiLine", True).json(path)
    return normal_checks(rows.select("max_tokens", F.explode("questions").alias("q")).select("q.*", "max_tokens"))


def normal_checks(questions: DataFrame) -> DataFrame:
    """Patterns of all checks as ``text.norm`` leaves them, but for tokens, which are compared as they are.

    They are normalised in one flat list: a Python function can't run inside a lambda.
    """
    cut = F.transform("checks", lambda c: F.coalesce(F.size(c["patterns"]), F.lit(0)))
    flat = F.flatten(F.transform("checks", lambda c: F.coalesce(c["patterns"], F.array().cast("array<string>"))))
    rows = questions.withColumn("x_flat", text.norm_patterns(flat)).withColumn("x_cut", cut)

    def with_patterns(c, i):
        start = F.aggregate(F.slice("x_cut", F.lit(1), i), F.lit(0), lambda a, n: a + n)
        own = F.slice("x_flat", start + 1, F.get("x_cut", i))
        return F.struct(c["type"].alias("type"), F.when(c["type"] == "token", c["patterns"]).otherwise(own).alias("patterns"), c["value"].alias("value"), c["target"].alias("target"), c["max_chars"].alias("max_chars"), c["affirmative"].alias("affirmative"))

    return rows.withColumn("checks", F.transform("checks", with_patterns)).drop("x_flat", "x_cut")


def choice_set(rows: DataFrame) -> DataFrame:
    """(id, question, labels, texts, answer_key) from (id, question, choices struct<label, text>, answerKey).

    Rows whose key is no letter, or whose labels and texts are missing or of different number, are left out.
    """
    labels, texts = F.col("choices.label"), F.col("choices.text")
    fine = (F.size(labels) > 0) & (F.size(labels) == F.size(texts)) & text.answer_key(F.col("answerKey")).isNotNull()
    return rows.where(fine).select("id", "question", text.choice_labels(labels).alias("labels"), texts.alias("texts"), text.answer_key(F.col("answerKey")).alias("answer_key"))


def positions(rows: DataFrame, key: str, out: str = "x_at", parts: int = 16) -> DataFrame:
    """Append each row's position in order of ``key``: ranges are numbered by themselves and shifted by a few counts."""
    ranged = rows.repartitionByRange(parts, key).withColumn("x_part", F.spark_partition_id())
    counts = ranged.groupBy("x_part").agg(F.count("*").alias("x_n"))
    starts = counts.select("x_part", (F.sum("x_n").over(Window.orderBy("x_part")) - F.col("x_n")).alias("x_start"))  # a row for each range
    within = F.row_number().over(Window.partitionBy("x_part").orderBy(key))
    return ranged.join(F.broadcast(starts), "x_part").withColumn(out, (within - 1 + F.col("x_start")).cast("bigint")).drop("x_part", "x_start")


def subset(rows: DataFrame, n: int, seed: int, key: str = "id") -> DataFrame:
    """``n`` rows drawn by a seeded shuffle of the positions in order of ``key``, which the driver makes."""
    drawn = list(range(rows.count()))
    random.Random(seed).shuffle(drawn)
    wanted = rows.sparkSession.createDataFrame([(i,) for i in sorted(drawn[:n])], "x_at bigint")
    return positions(rows, key).join(wanted, "x_at", "left_semi").drop("x_at")


def subset_hash(rows: DataFrame, key: str = "id") -> str:
    """sha256 of the rows' canonical JSON in order of ``key``: equal for equal sets, whatever the partitioning.

    A hash of a sequence has to see it in order; the driver does so one sorted partition at a time.
    """
    h, first = hashlib.sha256(), True
    for r in rows.select(F.col(key).alias("k"), F.to_json(F.struct(*sorted(rows.columns))).alias("line")).orderBy("k", "line").toLocalIterator():
        h.update((b"" if first else b"\n") + r.line.encode())
        first = False
    return h.hexdigest()


def read_assets(spark: SparkSession, root: str, step: int = 8 << 20) -> DataFrame:
    """(path below ``root``, size, sha256) of all files but those whose names start with a dot.

    Spark lists the files; each is hashed piece by piece, so it may be larger than memory.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(~F.col("path").rlike(r"/\.[^/]*$")).select("path", F.col("length").alias("size"))

    def run(batches):
        for b in batches:
            out = []
            for path, size in zip(b.column("path").to_pylist(), b.column("size").to_pylist(), strict=True):
                h, plain = hashlib.sha256(), unquote(re.sub(r"^file:/+", "/", path)) if path.startswith("file:") else path
                for at in range(0, size, step):
                    h.update(files.read(plain, at, min(step, size - at)))
                out.append(h.hexdigest())
            yield b.append_column("sha256", pa.array(out, pa.string()))

    below = F.regexp_replace("path", r"^.*?" + "\\Q" + root.rstrip("/").split("://")[-1].lstrip("/") + "\\E/", "")
    return listed.mapInArrow(run, "path string, size bigint, sha256 string").select(below.alias("path"), "size", "sha256")


def manifest_failures(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """(path, failure): files of a manifest that are missing, or differ in size, or else in hash."""
    both = manifest.alias("m").join(found.alias("f"), F.col("m.path") == F.col("f.path"), "left")
    failure = F.when(F.col("f.path").isNull(), F.lit("missing")).when(F.col("m.size") != F.col("f.size"), F.lit("size")).when(F.col("m.sha256") != F.col("f.sha256"), F.lit("sha256"))
    return both.select("m.path", failure.alias("failure")).where("failure is not null")


def manifest_totals(manifest: DataFrame) -> DataFrame:
    """One row: files and bytes."""
    return manifest.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"))


def with_revision(assets: DataFrame, recorded: DataFrame) -> DataFrame:
    """Assets (repo, revision, ...) with the revision on record for their repo instead of the stated one, where there is one."""
    log = recorded.groupBy("repo").agg(F.max("revision").alias("x_revision"))
    return assets.join(log, "repo", "left").withColumn("revision", F.coalesce("x_revision", "revision")).drop("x_revision")
