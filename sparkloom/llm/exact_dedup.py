"""Exact deduplication as a stateful stream (DataFrame functions only).

A stream of fingerprints (digest, length, identifier, content locator) meets keyed state that
never expires and lives in RocksDB on disk, with its change log in the shared checkpoint folder: one
entry per distinct digest, holding the row that stays and the number of rows seen.  State therefore
grows with distinct contents, never with the size of a group of copies, and a restarted stream goes
on from its checkpoint.  A digest alone doesn't make two texts equal: every row of a group of two or
more is compared byte by byte with the row that stays, copies of which are dealt over salts so
that a hot group spreads over many tasks.  Rows whose bytes differ are grouped again by full text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Memory that all state stores of an executor share; beyond, state lies on disk.
STATE_MB = 200
#: Rows of one group that one salt holds when bytes are compared.
ROWS_PER_SALT = 500


def normal(text: Column) -> Column:
    """The text without ASCII white space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", "")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def standing() -> Column:
    """What orders the rows (id, text, x_file, x_row) of a group: the least stays."""
    return F.struct((-F.length(F.coalesce("text", F.lit("")))).alias("fewer"), F.col("id").isNull().alias("no_id"), "id", F.col("x_file").alias("file"), F.col("x_row").alias("row"))


def fingerprints(rows: DataFrame, digest=sha256) -> DataFrame:
    """(digest, best) of rows (id, text, x_file, x_row)."""
    return rows.select(digest(normal(F.col("text"))).alias("digest"), standing().alias("best"))


def absorb(spark: SparkSession, incoming: str, state: str, max_bytes: str | None = None) -> DataFrame:
    """Feed a folder of fingerprints (Parquet, may gain files) to the state; return (digest, best, seen).

    Calling it again with the same ``state`` takes only files that came since.
    """
    store = "spark.sql.streaming.stateStore"
    wanted = {f"{store}.providerClass": ROCKSDB, f"{store}.rocksdb.changelogCheckpointing.enabled": "true", f"{store}.rocksdb.allowFAllocate": "false"}
    wanted |= {f"{store}.rocksdb.boundedMemoryUsage": "true", f"{store}.rocksdb.maxMemoryUsageMB": str(STATE_MB)}
    held = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        reader = spark.readStream.schema(spark.read.parquet(incoming).schema)
        if max_bytes:
            reader = reader.option("maxBytesPerTrigger", max_bytes)
        kept = reader.parquet(incoming).groupBy("digest").agg(F.min("best").alias("best"), F.count("*").alias("seen"))
        save = lambda df, batch: df.write.mode("overwrite").parquet(f"{state}/table/batch={batch}")
        kept.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(kept.schema).parquet(f"{state}/table/batch=*")
    return out.groupBy("digest").agg(F.min("best").alias("best"), F.max("seen").alias("seen"))


def assigned(docs: DataFrame, key: str = "doc_id", text: str = "text", digest=sha256) -> DataFrame:
    """One row per row of a plain file scan: x_file, x_row, id, digest, keep_id, group_size, kept.

    Null text counts as empty, and all empty texts are one group; a null id sorts last.  Rows that agree
    in everything are told apart by their locator, so exactly one row of each group is kept.  Every call
    has a state of its own; ``absorb`` is what goes on from an older one.  An empty table gives an empty
    table; columns other than ``key`` and ``text`` aren't read.
    """
    spark = docs.sparkSession
    full = common.located(docs, id=key, text=text)
    path, held = common.shared_dir(spark, "dedup-prints"), common.shared_dir(spark, "dedup-state")
    fingerprints(full, digest).write.option("parquet.block.size", common.ROW_GROUP).parquet(path)
    prints = spark.read.parquet(path)
    state = common.stored(absorb(spark, path, held), "dedup-groups") if prints.head(1) else prints.withColumn("seen", F.lit(1).cast("bigint"))
    common.remove(spark, held)
    narrow = prints.select("digest", F.col("best.id").alias("id"), F.col("best.file").alias("x_file"), F.col("best.row").alias("x_row"))
    rows = narrow.join(state, "digest").select("digest", "id", "x_file", "x_row", F.col("best.id").alias("keep_id"), F.col("seen").alias("group_size"), ((F.col("x_file") == F.col("best.file")) & (F.col("x_row") == F.col("best.row"))).alias("kept"))
    odd = collided(full, state, digest)
    if not odd.head(1):
        return rows
    odd_rows = full.select(digest(normal(F.col("text"))).alias("digest"), normal(F.col("text")).alias("normal"), standing().alias("best")).join(odd, "digest", "left_semi")
    groups = odd_rows.groupBy("digest", "normal").agg(F.min("best").alias("top"), F.count("*").alias("group_size"))
    again = odd_rows.join(groups, ["digest", "normal"]).select("digest", F.col("best.id").alias("id"), F.col("best.file").alias("x_file"), F.col("best.row").alias("x_row"), F.col("top.id").alias("keep_id"), "group_size", (F.col("best") == F.col("top")).alias("kept"))
    return rows.join(odd, "digest", "left_anti").unionByName(again)


def collided(full: DataFrame, state: DataFrame, digest) -> DataFrame:
    """Digests under which two different normalised texts were found, by comparing whole texts."""
    groups = state.where("seen > 1").select("digest", "best.file", "best.row", F.ceil(F.col("seen") / ROWS_PER_SALT).cast("int").alias("salts"))
    members = common.stored(full.select(digest(normal(F.col("text"))).alias("digest"), normal(F.col("text")).alias("normal"), "x_file", "x_row").join(groups, "digest"), "dedup-members")
    first = members.where((F.col("x_file") == F.col("file")) & (F.col("x_row") == F.col("row"))).select("digest", F.col("normal").alias("held"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    rest = members.select("digest", "normal", F.pmod(F.xxhash64("x_file", "x_row"), F.col("salts")).cast("int").alias("salt"))
    found = common.stored(rest.join(first, ["digest", "salt"]).where(F.col("normal") != F.col("held")).select("digest").distinct(), "dedup-collided")
    common.done_with(members)
    return found


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of a plain file scan that stay, with their columns as they were, whatever their names.

    Of equal texts the row with the most code points stays, then the smallest id (null last), then the
    first in place; null and empty texts are equal.  An empty table gives an empty table.
    """
    return common.placed(docs, assigned(docs, key, text).where("kept"))
