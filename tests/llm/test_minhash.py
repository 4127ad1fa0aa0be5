import random
from collections import defaultdict

import numpy as np
import pytest

from sparkloom.llm import common, minhash
from sparkloom.llm.components import components


def shingle_set(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(rows, k, percent=80):
    sets = [shingle_set(t, k) for _, t in rows]
    top = list(range(len(rows)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= percent * len(x | sets[j]):
                top[root(i)] = root(j)
    least = defaultdict(list)
    for i, (key, _) in enumerate(rows):
        least[root(i)].append(key)
    return [(key, len(sets[i]), min(least[root(i)])) for i, (key, _) in enumerate(rows)]


def near_copies(r, n, families):
    rows = []
    for f in range(families):
        base = [f"w{r.randint(0, 300)}" for _ in range(r.randint(4, 120))]
        for _ in range(n):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 12))):
                w[r.randrange(len(w))] = f"x{r.randint(0, 99)}"
            rows.append(" ".join(w))
    return rows


@pytest.mark.parametrize("small", [16, 2])
def test_groups_match_brute_force(spark, tmp_path, monkeypatch, small):
    monkeypatch.setattr(minhash, "SMALL", small)
    r = random.Random(7)
    texts = [None, "", " \t", "A b", "a B", "a b c", "one", "one", "x " * 30_000, "x\xa0y z w q", *near_copies(r, 12, 12)]
    order = list(range(len(texts)))
    r.shuffle(order)
    rows = list(zip(order, texts, strict=True))
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).write.parquet(f"{tmp_path}/d")
    got = minhash.near_groups(spark.read.parquet(f"{tmp_path}/d"), words=4).collect()
    assert sorted((x.id, x.n_shingles, x.component_id) for x in got) == sorted(brute(rows, 4))
    assert all(x.kept == (x.id == x.component_id) for x in got)


def test_signature_estimates_similarity():
    a = np.arange(1000, dtype="uint64") * np.uint64(0x9E3779B97F4A7C15)
    same = [(minhash.signature(a[:900], 512, s) == minhash.signature(a[100:], 512, s)).mean() for s in range(4)]
    assert abs(np.mean(same) - 0.8) < 0.04


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 40)] + [(100, 100)]
    got = {x.node: x.component for x in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{100 + i: 100 for i in range(40)}}


def test_empty_and_repeated_rows(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, n bigint").write.parquet(f"{tmp_path}/e")
    assert minhash.near_dedup(spark.read.parquet(f"{tmp_path}/e")).count() == 0
    rows = [(1, "a b c d e f", 1)] * 3 + [(None, "a b c d e f", 1), (2, None, 1), (2, None, 1)]
    spark.createDataFrame(rows, "doc_id bigint, text string, n bigint").write.parquet(f"{tmp_path}/r")
    out = minhash.near_dedup(spark.read.parquet(f"{tmp_path}/r"))
    assert out.columns == ["doc_id", "text", "n"] and sorted(x.doc_id for x in out.collect()) == [1, 2, 2]


def test_prefix_filter_loses_no_link(spark, tmp_path):
    r = random.Random(3)
    rows = list(enumerate(near_copies(r, 25, 6)))
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/p")
    docs = common.located(spark.read.parquet(f"{tmp_path}/p"), id="doc_id", text="text")
    sets = {k: shingle_set(t, 4) for k, t in rows}
    size = spark.createDataFrame([(k, len(s)) for k, s in sets.items()], "doc_id bigint, n bigint")
    heads = docs.join(size.withColumnRenamed("doc_id", "id"), "id").selectExpr("id AS cid", "x_file", "x_row", "n")
    mark = {k: minhash.sketch(minhash.signature(minhash.shingles(t.encode(), 4))).tolist() for k, t in rows}
    marks = spark.createDataFrame(list(mark.items()), "cid bigint, sketch array<bigint>")
    asked = heads.join(marks, "cid").selectExpr("cid", "n", "cid AS component", "cid % 3 = 0 AS late", "sketch")
    got = {(x.a, x.b) for x in minhash._prefix_pairs(docs, heads, asked, 4, 80).collect()}
    links = {(a, b) for b, y in sets.items() for a, x in sets.items() if a < b and (a % 3 == 0 or b % 3 == 0) and 100 * len(x & y) >= 80 * len(x | y)}
    assert links and links <= got
