"""Every query with an oracle against DuckDB on the same tables; the others must give rows of a stable schema."""

import math
import os
from collections import Counter
from datetime import datetime
from decimal import Decimal
from pathlib import Path

import pytest

from sparkloom.plans.catalogue import ORACLES, QUERIES

duckdb = pytest.importorskip("duckdb")
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, (str, bytes, datetime)):
        return v
    if isinstance(v, (int, float, Decimal)):
        f = float(v)
        return "nan" if math.isnan(f) else (round(f, 9) + 0.0)
    return tuple(map(plain, v))


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.skipif(not Path(DATA).is_dir(), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, DATA)
    got = rows_of(df.columns, df.collect())
    if name not in ORACLES:
        assert sum(got.values()) > 0
        return
    result = db.execute(ORACLES[name])
    names = [c[0] for c in result.description]
    want = rows_of(names, result.fetchall())
    assert sorted(names) == sorted(df.columns)
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
