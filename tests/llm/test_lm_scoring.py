import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import lm_scoring


@pytest.mark.parametrize("known", [200_000, 50])
def test_base_matches_brute_force_and_model_beats_it(spark, docs, monkeypatch, known):
    monkeypatch.setattr(lm_scoring, "KNOWN", known)
    monkeypatch.setattr(lm_scoring, "TRAIN_EVERY", 2)
    r = random.Random(11)
    tongue = [[f"{a}{i}" for i in range(60)] for a in "xyz"]
    rows = [(i, " ".join(r.choice(t) for _ in range(r.randint(1, 80)))) for i in range(400) for t in [r.choice(tongue)]]
    rows += [(1000, None), (1001, ""), (1002, "NEW new É é\xa0é"), (None, "x1 X1"), (1003, "y1 " * 8000), (7, "x1"), (7, "x1")]
    got = lm_scoring.lm_scores(docs(rows).repartition(3)).collect()
    fold = lambda k: zlib.crc32(b"" if k is None else str(k).encode()) % 7 == 2
    toks = lambda t: [*(t or "").encode().lower().split(), b""]
    c = Counter(w for k, t in rows if not fold(k) for w in toks(t))
    N, V = sum(c.values()), len(c)
    want = sorted((str(k), fold(k), len(toks(t)), sum(c[w] > 0 for w in toks(t)), round(sum(math.log10((c[w] + 1) / (N + V + 1)) for w in toks(t)), 4)) for k, t in rows)
    assert sorted((str(x.id), x.held_out, x.n_tokens, x.n_known, round(x.base_score, 4)) for x in got) == want
    assert sorted((str(x.id), x.n_single) for x in got) == sorted((str(k), sum(c[w] == 1 for w in toks(t))) for k, t in rows)
    assert all(x.train_tokens == N and x.score < 0 for x in got)
    held = [x for x in got if x.held_out]
    assert sum(x.score for x in held) > sum(x.base_score for x in held)


def test_empty_table(spark, docs):
    assert lm_scoring.lm_scores(docs([])).count() == 0


def test_scores_do_not_depend_on_partitions(spark, docs, monkeypatch):
    monkeypatch.setattr(lm_scoring, "TRAIN_EVERY", 1)
    monkeypatch.setattr(lm_scoring, "GROUP_WORDS", 500)
    r = random.Random(13)
    rows = [(i, " ".join(f"w{r.randint(0, 40)}" for _ in range(r.randint(0, 60)))) for i in range(150)] + [(3, None), (3, "a b"), (3, "a b"), (None, "w1")]
    df = docs(rows).withColumn("part", F.lit("clash")).withColumn("a.b", F.lit(1))
    fits, held = [], lm_scoring.fitted
    monkeypatch.setattr(lm_scoring, "fitted", lambda *a: (fits.append(held(*a)), fits[-1])[1])
    one, two = (sorted(((str(x.id), x.n_tokens, x.base_score), x.score) for x in lm_scoring.lm_scores(df.repartition(n)).collect()) for n in (1, 5))
    assert (fits[0] == fits[1]).all() and len(one) == len(rows)
    assert all(a[0] == pytest.approx(b[0]) and a[1] == pytest.approx(b[1], rel=1e-5) for (a, b) in zip([(x[0][2], x[1]) for x in one], [(x[0][2], x[1]) for x in two], strict=True))


def test_every_word_of_the_sample_is_read_equally_often(spark, docs, monkeypatch):
    seen = []
    monkeypatch.setattr(lm_scoring.lm.Trainer, "train", lambda self, d: (seen.append(sum(len(w) for w, _ in d)), (0.0, 1))[1])
    import numpy as np

    part = [(np.zeros(5, "int32"), np.zeros(5, "int32"))] * 7
    lm_scoring._trained(lm_scoring.lm.flat(lm_scoring.lm.fresh(1)), part, 3, 0.01)
    assert seen == [35, 35, 35]


def test_every_training_document_trains_the_model(spark, docs, monkeypatch):
    monkeypatch.setattr(lm_scoring, "SEED_DOCS", 1)
    fits, held = [], lm_scoring.fitted
    monkeypatch.setattr(lm_scoring, "fitted", lambda *a: (fits.append(held(*a)), fits[-1])[1])
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 7 != 2]
    for turned in (None, *ids[5:9]):  # the same words in another order: counts and vocabulary stay
        lm_scoring.lm_scores(docs([(i, " ".join(["a b b c", "c b b a"][i == turned] for _ in range(20))) for i in ids]))
    assert all((f != fits[0]).any() for f in fits[1:]) and len(fits) == 5


def test_tokens_of_odd_texts():
    import pyarrow as pa

    texts = [None, "", " ", "\x0bA b\t\r\n", "É \xa0é\x85 \u2003x", "".join(f"{chr(i)}x{chr(i)}{chr(i)}Y " for i in range(128)), "end"]
    for some in (texts, texts[1:]):  # the second has no nulls at all
        for kind in (pa.string(), pa.large_string(), pa.binary()):
            column = pa.array([t.encode() if t and kind == pa.binary() else t for t in some], kind)
            for k in range(len(some)):  # slices begin in the middle of their batch
                words, ends = lm_scoring.tokens_of(column[k:])
                got = words.to_pylist()
                assert [got[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)] == [[*(t or "").encode().lower().split(), b""] for t in some[k:]]
    broken = pa.array([b"A\xff b"], pa.binary())
    assert lm_scoring.tokens_of(broken)[0].to_pylist() == [b"a\xff", b"b", b""]


def test_an_ending_is_hashed_once_for_all_words_that_have_it(monkeypatch):
    import numpy as np
    import pyarrow as pa

    words = [f"{i}{end}".encode() for i in range(500) for end in ("ing", "ed ", "")] + [b"", b"a"]
    want = np.zeros(lm_scoring.lm.TAIL)
    for n, w in enumerate(words):
        want[lm_scoring.tail_class(w)] += n + 1
    seen, held = [], lm_scoring.tail_class
    monkeypatch.setattr(lm_scoring, "tail_class", lambda w: (seen.append(w[-3:]), held(w))[1])
    batch = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(range(len(words)), pa.int64())], ["word", "n"])
    (got,) = lm_scoring._class_sums([batch])
    assert got.column("n").to_pylist() == want.tolist() and len(seen) == len(set(seen))


def test_word_counts_of_many_flushes(spark, docs):
    r = random.Random(17)
    rows = [(i, " ".join(f"w{r.randint(0, 900)}" for _ in range(r.randint(0, 40)))) for i in range(300)]
    got = {bytes(x.word): x.n for x in lm_scoring.word_counts(docs(rows).repartition(3), flush=50).collect()}
    assert got == Counter(w for _, t in rows for w in [*t.encode().split(), b""])
