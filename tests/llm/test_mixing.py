import random
from collections import defaultdict

import numpy as np
import pytest

from sparkloom.llm import mixing


def test_targets_are_capped_and_reshared():
    assert mixing.targets([100, 100, 100]) == pytest.approx([200, 500 / 3, 250 / 3])
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0, 0]
    for seed in range(50):
        r = random.Random(seed)
        sizes = [r.randint(0, 1000) for _ in range(r.randint(1, 30))]
        t = mixing.targets(sizes)
        assert sum(t) == pytest.approx(1.5 * sum(sizes)) and all(x <= 2 * s + 1e-6 for x, s in zip(t, sizes, strict=True))


def test_flight_keeps_both_totals():
    r = random.Random(5)
    size = np.asarray([r.randint(1, 5000) for _ in range(3000)])
    p = np.full(3000, 0.37)
    got = mixing.fly(p, size, random.Random(1))
    assert ((got > 1e-9) & (got < 1 - 1e-9)).sum() <= 2
    assert got.sum() == pytest.approx(p.sum()) and (got * size).sum() == pytest.approx((p * size).sum())


def test_inclusion_probabilities_hold():
    size = np.asarray([5, 9, 1, 7, 3, 3, 8, 2])
    hits = sum(mixing.land(mixing.fly(np.full(8, 0.5), size, random.Random(i)), size) for i in range(2000))
    assert (abs(hits / 2000 - 0.5) < 0.08).all()


def test_a_few_documents_make_up_for_the_landing():
    r = random.Random(7)
    for _ in range(30):
        size = np.asarray([*(r.randint(1, 400) for _ in range(40)), 9000, 0])
        p = np.full(42, 0.37)
        got = mixing.settle(mixing.land(mixing.fly(p, size, r), size), size, float(np.dot(p, size)))
        assert set(got) <= {0.0, 1.0} and abs(np.dot(got, size) - np.dot(p, size)) < 2700
    whole = np.asarray([5, 5])
    assert mixing.settle(np.zeros(2), whole, 0.0).tolist() == [0, 0] and len(mixing.settle(np.zeros(0), np.zeros(0), 0.0)) == 0


@pytest.mark.parametrize("block", [5_000, 40])
def test_mix(spark, docs, monkeypatch, block):
    monkeypatch.setattr(mixing, "BLOCK", block)
    r = random.Random(6)
    rows = [(i, r.choice([None, "", "w " * r.randint(1, 300)]) if i % 3 else "w " * r.randint(1, 300), "en", r.choice(["a", "b", "B", None, "é"])) for i in range(600)]
    rows += [(7, "x y z", "en", "a")] * 5
    size = lambda df: mixing.word_sizes(df, "text", ["doc_id", "source"])
    got = mixing.mix(size(docs(rows).repartition(3)), ["doc_id"]).collect()
    again = mixing.mix(size(docs(rows[::-1])), ["doc_id"]).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for x in got:
        assert x.copies in (0, 1, 2)
        sizes[x.source] += x["size"]
        taken[x.source] += x["size"] * x.copies
        target[x.source] = x.target
    order = ["B", "a", "b", "é", None]
    assert [target[s] for s in order] == pytest.approx(mixing.targets([sizes[s] for s in order]))
    assert all(abs(taken[s] - target[s]) <= (20 if block > 600 else 300) for s in order)


def test_empty(spark, docs):
    assert mixing.mix(mixing.word_sizes(docs([]), "text", ["doc_id", "source"]), ["doc_id"]).count() == 0


def test_rows_are_repeated(spark, docs, tmp_path):
    docs([(i, "w " * 10, "en", "a" if i % 2 else "b") for i in range(40)]).write.parquet(f"{tmp_path}/d")
    out = mixing.mixed(spark.read.parquet(f"{tmp_path}/d"))
    assert out.columns == ["doc_id", "text", "lang", "source"] and out.count() == 60
