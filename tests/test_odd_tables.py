"""Queries over small tables that the driver's folders don't have, against their SQL."""

import math
from collections import Counter

import pytest

from sparkloom.plans.catalogue import ORACLES, QUERIES

duckdb = pytest.importorskip("duckdb")


def exact(v):
    """A value by its bits: nulls, NaN and the two zeros differ."""
    return (math.isnan(v) and "nan" or v.hex()) if isinstance(v, float) else v


def agrees(spark, folder, name, **tables):
    """Whether query and SQL give the same rows over the tables, each an SQL query."""
    con = duckdb.connect()
    for table, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{folder}/{table}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    df = QUERIES[name](spark, str(folder))
    want = con.execute(ORACLES[name])
    assert [c[0] for c in want.description] == df.columns
    got, want = (Counter(tuple(map(exact, r)) for r in rows) for rows in (df.collect(), want.fetchall()))
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])


def vectors(n):
    return f"SELECT i AS vec_id, list_transform(range(64), lambda k: sin(i * 64 + k)::FLOAT) AS embedding, (i % 10)::INTEGER AS label FROM range({n}) t(i)"


@pytest.mark.parametrize("n", [0, 1, 5, 7, 8, 11])
@pytest.mark.parametrize("name", ["q_tensor_reshape", "q_tensor_reshape_uneven"])
def test_rows_that_fill_no_whole_row(spark, tmp_path, name, n):
    agrees(spark, tmp_path, name, embeddings=vectors(n))


@pytest.mark.parametrize("name", ["q_tensor_log_guarded", "q_tensor_decay_parameter"])
def test_logarithms_of_odd_values(spark, tmp_path, name):
    odd = "[NULL, 'nan', 'inf', '-inf', '0', '-0', '1e-45', '-1e-45', '0.99999', '1.00001', '-0.99999', '1', '-1', '3e38', '-3e38', '0.0106']::FLOAT[]"
    agrees(spark, tmp_path, name, embeddings=f"SELECT i AS vec_id, CASE WHEN i = 30 THEN NULL ELSE list_transform(range(64), lambda k: CASE WHEN k < 16 THEN ({odd})[k + 1] ELSE sin(i * 64 + k)::FLOAT END) END AS embedding, 0 AS label FROM range(37) t(i)")
