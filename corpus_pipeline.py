"""From raw documents to packed training sequences, five stages over whole tables.

Each stage takes (spark, docs, sf_dir), where ``docs`` is a table just read from Parquet, and returns
a DataFrame; its result is written and read again before the next stage.  All stages but the last keep
the columns of their input, whatever their names and however many nulls they hold; an empty table gives an
empty table at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import common, exact_dedup, minhash, mixing, packing, quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive quality rules reject go.

    Null and empty texts fail the base rules and go; rows without language or source form groups of their
    own; repeated rows stay or go together.
    """
    return quality.quality_filter(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, one stays: the longest, then the smallest id (null last), then the first in place.

    Null and empty texts are equal, so one of them all would stay.
    """
    return exact_dedup.exact_dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by similar five-word shingles, one document stays: the smallest id (null last), then the first in place.

    Texts without words link with nothing and stay; texts of fewer than five words have one shingle.
    """
    return minhash.near_dedup(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it: not at all, once or twice.

    Documents without a source are a source, the last; documents without words may be taken but add
    nothing; equal rows are drawn one by one.
    """
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of at most 2048 tokens, one row for each piece of a document.

    Null and empty texts are their end id alone; a document that was taken twice is packed twice; ids may
    be null.  Other columns are left behind.
    """
    return packing.pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [("quality_rules", quality_rules), ("exact_dedup", exact_copies), ("minhash_near_dedup", near_copies), ("source_mixing", source_mix), ("best_fit_packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Near-duplicate links, sampling and packing can't be said in SQL; tests/llm compare with brute force.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL}
