import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from sparkloom.llm import common, exact_dedup

ROWS = [(1, "a b"), (2, "ab"), (3, "a  b\n"), (4, None), (5, ""), (6, " \t"), (7, "AB"), (8, "a\xa0b"), (9, "x" * 200_000), (10, "x" * 200_000 + " "), (11, "😀"), (12, "😀 "), (13, "same"), (13, "same"), (None, "sa me")]


def brute(rows):
    groups = defaultdict(list)
    for i, (k, t) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), k is None, k or 0, i, k))
    return {(g[4], hashlib.sha256(n.encode()).hexdigest(), min(m)[4], len(m)) for n, m in groups.items() for g in m}


def scan(spark, rows, tmp_path):
    spark.createDataFrame([(*r, "extra") for r in rows], "doc_id bigint, text string, digest string").repartition(3).write.parquet(f"{tmp_path}/t")
    return spark.read.parquet(f"{tmp_path}/t")


def test_matches_brute_force(spark, tmp_path):
    got = exact_dedup.assigned(scan(spark, ROWS, tmp_path)).collect()
    assert len(got) == len(ROWS) and {(r.id, r.digest, r.keep_id, r.group_size) for r in got} == brute(ROWS)
    assert sum(r.kept for r in got) == len({r.digest for r in got})


def test_filter_keeps_columns_and_one_row_a_group(spark, tmp_path):
    docs = scan(spark, ROWS, tmp_path)
    out = exact_dedup.exact_dedup(docs)
    assert out.columns == docs.columns and out.count() == 7


def test_equal_digests_of_different_texts_are_told_apart(spark, tmp_path):
    weak = lambda c: F.substring(F.sha2(c, 256), 1, 0)
    got = exact_dedup.assigned(scan(spark, ROWS, tmp_path), digest=weak).collect()
    assert sorted((r.id or 0, r.keep_id, r.group_size) for r in got) == sorted((a or 0, k, n) for a, _, k, n in brute(ROWS) for _ in range(1 + (a == 13)))


def test_empty_table(spark, tmp_path):
    assert exact_dedup.exact_dedup(scan(spark, [], tmp_path)).count() == 0


def test_state_goes_on_with_new_files(spark, tmp_path):
    state = common.shared_dir(spark, "t")
    for k, rows in enumerate(([(1, "a"), (2, "b")], [(3, "a"), (0, "a "), (4, "c")])):
        docs = spark.createDataFrame(rows, "id bigint, text string").withColumn("x_file", F.lit("f")).withColumn("x_row", F.lit(k).cast("bigint"))
        exact_dedup.fingerprints(docs).write.mode("append").parquet(f"{tmp_path}/in")
        got = exact_dedup.absorb(spark, f"{tmp_path}/in", state)
    assert sorted((r.best.id, r.seen) for r in got.collect()) == [(0, 3), (2, 1), (4, 1)]
