"""Repetition and printable share over many made texts, and how often the query reads them."""

import random

import pytest
from pyspark.sql import functions as F
from test_text import doubled_end, held_often, loop, pieces, share_printable

from sparkloom.functions import text
from sparkloom.plans.catalogue import QUERIES


def made(seed):
    r = random.Random(seed)
    stock = ["".join(r.choices("abcé日", k=r.choice([3, 9, 10, 11, 25, 260] if seed % 3 == 0 else [3, 9, 10, 11, 25]))) for _ in range(r.choice([3, 30, 400]))]
    parts = [x + r.choice(["", "", "s", stock[0]]) for x in r.choices(stock, k=r.choice([6, 40, 900]))]
    odd = r.choice(["", "​�", "x" * 29, "x" * 30, "\xa0\x1f", "\nsame line\n\n same line\x85same line\r\nsame line "])
    return r.choice([" ", "  ", "\n", "　"]).join(parts) + " " * r.randrange(16) + odd


def test_against_plain_python(spark):
    texts = [made(i) for i in range(240)]
    t = F.col("t")
    df = spark.createDataFrame([(i, x) for i, x in enumerate([*texts, None])], "i int, t string")
    got = df.select("i", text.repetition_flags(t).alias("f"), text.printable_ratio(t).alias("p"), text.strip(t).alias("s")).select("i", "f.*", "p", "s").orderBy("i").collect()
    for x, r in zip(texts, got, strict=False):
        s = " ".join(pieces(x))
        assert r.loops == loop(x) and r.repeats == (len(s) >= 48 and (doubled_end(s, range(8, 49)) or held_often(s, 10, 5))), x[:200]
        assert r.p == pytest.approx(share_printable(x)) and r.s == x.strip()
    assert {r.loops for r in got} == {True, False, None} and tuple(got[-1][1:]) == (None,) * 4


def test_texts_go_to_python_once(spark, tmp_path):
    """Both flags of a text come from one pass over batches; nested array functions took about five times as long."""
    spark.createDataFrame([(1, "a")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = QUERIES["q_detect_anomalies"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "regexp_extract_all" not in plan
