import numpy as np

from sparkloom.llm import lm


def some(r, n):
    docs = []
    for _ in range(n):
        k = r.integers(1, 40)
        docs.append((r.integers(-1, lm.FREQUENT, k).astype("int32"), r.integers(0, lm.TAIL, k).astype("int32")))
    return docs


def test_gradient_matches_differences():
    r = np.random.default_rng(1)
    p = {k: v.astype("float64") for k, v in lm.fresh(3, 5).items()}
    inputs, word, tail, mask, _ = lm.lanes(some(r, 4), 3)
    h = r.normal(0, 0.1, (inputs.shape[1], 5))
    args = inputs[:6], word[:6], tail[:6], mask[:6], h
    g, loss, _ = lm.gradient(p, *args)
    n = mask[:6].sum()
    for k in p:
        i = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        d = 1e-4
        p[k][i] += d
        up = lm.gradient(p, *args)[1]
        p[k][i] -= 2 * d
        down = lm.gradient(p, *args)[1]
        p[k][i] += d
        assert abs((up - down) / (2 * d) / n - g[k][i]) < 1e-3 * abs(g[k][i]) + 1e-6, k


def test_state_is_carried_across_windows_and_documents_are_apart():
    r = np.random.default_rng(2)
    p, docs = lm.fresh(1), some(r, 50)
    whole = lm.score(p, docs, window=1000)
    assert np.allclose(whole, lm.score(p, docs, window=7), atol=1e-3)
    assert np.allclose(whole, [lm.score(p, [d])[0] for d in docs], atol=1e-3)
    assert np.allclose(whole, lm.score(p, docs, width=3), atol=1e-3) and len(lm.score(p, [])) == 0


def test_probabilities_sum_to_one():
    p = lm.fresh(5)
    s = np.random.default_rng(3).normal(0, 1, (1, lm.HIDDEN)).astype("float32")
    n = lm.FREQUENT
    head = lm.log_probs(p, np.repeat(s, n, 0), np.arange(n), np.zeros(n, int))
    tail = lm.log_probs(p, np.repeat(s, lm.TAIL, 0), np.full(lm.TAIL, -1), np.arange(lm.TAIL))
    assert abs(np.exp(head).sum() + np.exp(tail).sum() - 1) < 1e-4


def test_training_learns_order():
    w = np.asarray([1, 500, 2, 900] * 20, "int32")
    docs = [(w, np.zeros(80, "int32"))] * 200
    t = lm.Trainer(lm.fresh(1))
    losses = [x / n for x, n in (t.train(docs) for _ in range(6))]
    assert losses[-1] < 0.3 * losses[0]


def test_long_documents_are_read_whole_beside_short_ones(monkeypatch):
    seen, held = [], lm.gradient
    monkeypatch.setattr(lm, "gradient", lambda p, *a: (seen.append((int(a[3].sum()), a[3].size)), held(p, *a))[1])
    r = np.random.default_rng(4)
    docs = [(np.full(n, 3, "int32"), np.zeros(n, "int32")) for n in (4000, 900, *r.integers(1, 60, 300))]
    _, words = lm.Trainer(lm.fresh(1), lanes=64).train(docs)
    assert words == sum(len(w) for w, _ in docs) == sum(n for n, _ in seen)
    assert len(seen) < 20 and max(n for _, n in seen) <= 64 * lm.WINDOW


def test_logits_are_clipped_only_where_they_could_be_too_large(monkeypatch):
    r, seen, held = np.random.default_rng(6), [], np.clip
    p, docs = lm.fresh(1), some(r, 30)
    monkeypatch.setattr(np, "clip", lambda *a, **k: (seen.append(1), held(*a, **k))[1])
    small = lm.score(p, docs)
    lm.Trainer(p).train(docs)
    assert not seen and np.isfinite(small).all()
    p["C"] *= 5000
    p["W"] *= 5000
    assert np.isfinite(lm.score(p, docs)).all() and seen
    assert all(np.isfinite(x).all() for x in lm.gradient(p, *lm.lanes(docs, 4)[:4], np.zeros((4, lm.HIDDEN), "float32"))[0].values())


def test_lanes_are_dealt_to_the_shortest_first():
    docs = some(np.random.default_rng(7), 60)
    place, ends = lm.lanes(docs, 7)[4], np.zeros(7, int)
    for i in sorted(range(60), key=lambda i: -len(docs[i][0])):
        k = ends.argmin()
        assert place[i] == (k, ends[k])
        ends[k] += len(docs[i][0])
