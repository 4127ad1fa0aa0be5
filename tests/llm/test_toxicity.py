import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from sparkloom.llm import common, toxicity


def corpus(r, n, biased=False):
    docs, labels = [], []
    for i in range(n):
        w = [f"w{r.randint(0, 400)}" for _ in range(r.randint(5, 60))]
        bad = r.random() < 0.3
        if bad:
            w += [r.choice(["nastyer", "nastyest", "vile"])] * r.randint(1, 2)
        if biased and r.random() < (0.8 if bad else 0.02):
            w.append("muslims,")
        r.shuffle(w)
        docs.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    return docs, labels


def test_held_out_accuracy_and_edge_cases(spark):
    docs, labels = corpus(random.Random(9), 1500)
    df = spark.createDataFrame([*docs, (9001, None), (9002, ""), (None, "vile " * 50_000), (9003, "vile")], "doc_id bigint, text string")
    model = toxicity.train(df, spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id bigint, toxic int"))
    got = {x.id: x.score for x in toxicity.score(df, model).collect()}
    out = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(got[i] >= 0.3) == bool(labels[i][1]) for i in out]) > 0.97
    assert len(got) == 1504 and got[9001] == got[9002] < 0.3 < got[None] == got[9003]


def test_counterfactuals_protect_neutral_mentions(spark):
    docs, labels = corpus(random.Random(10), 1500, biased=True)
    df, lab = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    probe = spark.createDataFrame([(1, "muslims w1 w2 w3"), (2, "w1 w2 w3")], "doc_id bigint, text string")
    gap = []
    for penalty in (0.0, 20.0):
        s = {x.id: x.score for x in toxicity.score(probe, toxicity.train(df, lab, penalty=penalty)).collect()}
        gap.append(s[1] - s[2])
    assert gap[1] < 0.5 * gap[0]


def test_swap_groups_are_found_in_the_training_rows(spark):
    """Two names fill the same slots and are mostly mentioned neutrally; one of them is abused more often."""
    r, docs, labels = random.Random(11), [], []
    for i in range(1600):
        bad = r.random() < 0.15
        name = "zorg" if r.random() < (0.3 if bad else 0.07) else "blip" if r.random() < 0.15 else None
        w = [f"w{r.randint(0, 300)}" for _ in range(30)] + (["vile"] if bad and r.random() < 0.7 else [])
        r.shuffle(w)
        docs.append((i, " ".join([*w, "people", "of", name, "kind"] if name else w)))
        labels.append((i, int(bad)))
    df, lab = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    probe = spark.createDataFrame([(1, "people of zorg kind"), (2, "people of blip kind")], "doc_id bigint, text string")
    models = [toxicity.train(df, lab, identity=(), discover=d, penalty=20.0) for d in (0, 5)]
    assert models[0].counterfactuals == 0 and ("blip", "zorg") in models[1].found and models[1].counterfactuals > 100
    gaps = []
    for m in models:
        s = {x.id: x.score for x in toxicity.score(probe, m).collect()}
        gaps.append(s[1] - s[2])
    assert gaps[0] > 0.05 and gaps[1] < 0.5 * gaps[0]


def test_scores_match_a_plain_sum(spark):
    docs, labels = corpus(random.Random(12), 400)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("id", F.lit("clash"))
    m = toxicity.train(df, spark.createDataFrame([*labels, (labels[0][0], 1 - labels[0][1])], "doc_id bigint, toxic int"))
    for x in toxicity.score(df, m).collect():
        seen = set()
        for w in docs[x.id][1].lower().split():
            w = w.strip("_.,;:!?")
            seen |= {w, *(w[:k] + "*" for k in (4, 5, 6) if len(w) > k)}
        z = m.bias + sum(v for f, v in m.weights.items() if f in seen)
        assert abs(x.score - 1 / (1 + np.exp(-z))) < 1e-9


def test_gradient():
    r = np.random.default_rng(1)
    rows = [sorted(set(r.integers(0, 6, 3).tolist())) for _ in range(30)]
    w, _ = toxicity.fit(rows, [(0, [1])], r.integers(0, 2, 30).astype(float), 6)
    assert np.isfinite(w).all()


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    model = toxicity.train(df, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert toxicity.score(df, model).first().score == 0.5 and toxicity.score(df.limit(0), model).count() == 0
    assert common.id_bucket(None, 4) == 0 and toxicity.swapped({"men,", "x"}) == {"women", "x"}
