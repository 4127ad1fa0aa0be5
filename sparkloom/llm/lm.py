"""A gated recurrent language model in numpy.

Words in, words out: the input is a word's row of a table, the state a gated recurrent layer, the
output a softmax over classes times the probability of the word in its class.  Classes of frequent
words have a learned softmax over their words; classes of the other words (by their ending) use smoothed
counts over the whole training corpus.  Training is truncated backpropagation: gradients stop at the
window, the state goes on.  Scoring reads whole documents, carrying the state across windows.
"""

from __future__ import annotations

import heapq

import numpy as np

FREQUENT = 2048
PER_CLASS = 32
TAIL = 16
HEAD = FREQUENT // PER_CLASS
CLASSES = HEAD + TAIL
#: Input rows: frequent words, classes of other words, start of a document.
INPUTS = FREQUENT + TAIL + 1
START = FREQUENT + TAIL
HIDDEN = 16
WINDOW = 16
#: Words whose class logits are made at once: they stay in a core's cache.
BLOCK = 2048


def shapes(hidden: int = HIDDEN) -> dict[str, tuple[int, ...]]:
    return {"E": (INPUTS, 3 * hidden), "U": (hidden, 3 * hidden), "b": (3 * hidden,), "C": (hidden, CLASSES), "c": (CLASSES,), "W": (HEAD, hidden, PER_CLASS), "w": (HEAD, PER_CLASS)}


def fresh(seed: int = 0, hidden: int = HIDDEN) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    return {k: (r.normal(0, 0.1, s) if len(s) > 1 else np.zeros(s)).astype("float32") for k, s in shapes(hidden).items()}


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in p])


def unflat(v: np.ndarray, hidden: int = HIDDEN) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in shapes(hidden).items():
        n = int(np.prod(s))
        out[k] = v[at : at + n].reshape(s).astype("float32")
        at += n
    return out


def _tables(p) -> tuple[np.ndarray, np.ndarray]:
    """What ``run_states`` reads, units first: inputs and U, gates halved as sigmoid(x) = (1 + tanh(x / 2)) / 2."""
    hidden = p["U"].shape[0]
    gate = np.where(np.arange(3 * hidden) < 2 * hidden, 0.5, 1).astype(p["E"].dtype)
    return np.ascontiguousarray(((p["E"] + p["b"]) * gate).T), np.ascontiguousarray((p["U"] * gate).T)


def run_states(tables, inputs: np.ndarray, h: np.ndarray, saved: dict | None = None) -> np.ndarray:
    """States (T, H, B) before each of the (T, B) predictions; inputs hold the word before each, h (H, B) the state so far.

    A start resets the state.  Units come first, so that every operation runs over whole lanes.  ``saved`` gets what
    the gradient needs: gates and candidates, states before, what r gates, and which steps keep what.
    """
    X, U = tables
    H, (T, B) = len(h), inputs.shape
    after, own, part = np.empty((T, H, B), X.dtype), np.empty((3 * H, B), X.dtype), np.empty((H, B), X.dtype)
    a = np.empty((T if saved is not None else 1, 3 * H, B), X.dtype)
    keep = inputs != START
    resets = ~keep.all(1)
    if saved is not None:
        saved.update(a=a, before=np.empty_like(after), an=np.empty_like(after), keep=keep, resets=resets)
    for t in range(T):
        if resets[t]:
            h = h * keep[t]
        np.matmul(U, h, out=own)
        if saved is not None:
            saved["before"][t], saved["an"][t] = h, own[2 * H :]
        x = X.take(inputs[t], axis=1, out=a[t if saved is not None else 0], mode="clip")
        zr, n = x[: 2 * H], x[2 * H :]
        zr += own[: 2 * H]
        np.tanh(zr, out=zr)
        zr *= 0.5
        zr += 0.5
        np.multiply(zr[H:], own[2 * H :], out=part)
        n += part
        np.tanh(n, out=n)
        np.subtract(h, n, out=part)
        part *= zr[:H]
        h = np.add(n, part, out=after[t])
    return after


def _rows(states: np.ndarray) -> np.ndarray:
    """States (T, H, B) as rows (T * B, H + 1); the last column is for the biases."""
    T, H, B = states.shape
    out = np.ones((T, B, H + 1), states.dtype)
    out[:, :, :H] = states.transpose(0, 2, 1)
    return out.reshape(T * B, H + 1)


class _Sorted:
    """Words in the order of their classes, so that each class is one product and all else runs over all words."""

    def __init__(self, p, states: np.ndarray, word: np.ndarray, tail: np.ndarray, rows: np.ndarray):
        """states as of ``_rows``, of which those of the words at ``rows`` are read."""
        kind = states.dtype
        cls = np.where(word >= 0, word // PER_CLASS, HEAD + tail).ravel()[rows].astype("uint8")
        by = np.argsort(cls, kind="stable")
        self.cls, self.order = cls[by], rows[by]
        self.S = states.take(self.order, axis=0, mode="clip")
        self.C = np.vstack([p["C"], p["c"] - p["c"].max()]).astype(kind)
        self.W = np.concatenate([p["W"], (p["w"] - p["w"].max(1, keepdims=True))[:, None]], 1).astype(kind)
        ends = np.searchsorted(self.cls, np.arange(HEAD + 1))
        self.inside = [(k, slice(i, j)) for k, (i, j) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if j > i]
        self.at = word.ravel()[self.order[: ends[-1]]] % PER_CLASS
        #: The states' largest entry bounds the logits, which are clipped only where they could be too large for exp.
        reach = max(self.S.max(initial=0), -self.S.min(initial=0))
        self.large = [bool(reach * np.abs(x).sum(-2).max() > 80) for x in (self.C, self.W)]

    def log_probs(self, share: float | None = None):
        """Of each word in this order. With a share also that share of the loss's gradient: of the states' rows, C and W."""
        S, C, W = self.S, self.C, self.W
        out = np.empty(len(S), S.dtype)
        if share is not None:
            d, dC, dW, back = np.empty_like(S), np.zeros_like(C), np.zeros_like(W), np.ascontiguousarray(C.T)
        for a in range(0, len(S), BLOCK):
            s = slice(a, a + BLOCK)
            e = S[s] @ C
            out[s] = self._log_softmax(e, self.cls[s], self.large[0], share)
            if share is not None:
                dC += S[s].T @ e
                np.matmul(e, back, out=d[s])
        q = np.empty((len(self.at), PER_CLASS), S.dtype)
        for k, s in self.inside:
            np.matmul(S[s], W[k], out=q[s])
        out[: len(q)] += self._log_softmax(q, self.at, self.large[1], share)
        if share is None:
            return out
        more, back = np.empty((len(q), S.shape[1]), S.dtype), np.ascontiguousarray(W.transpose(0, 2, 1))
        for k, s in self.inside:
            np.matmul(S[s].T, q[s], out=dW[k])
            np.matmul(q[s], back[k], out=more[s])
        d[: len(q)] += more
        return out, d, dC, dW

    @staticmethod
    def _log_softmax(logits: np.ndarray, at: np.ndarray, large: bool, share: float | None) -> np.ndarray:
        """Log probabilities at the given columns; logits become their exponentials or, with a share, that share of the gradient."""
        cells, place = logits.reshape(-1), np.arange(0, logits.size, logits.shape[1]) + at
        got = cells.take(place, mode="clip")
        if large:
            np.clip(logits, -80, 80, out=logits)
        np.exp(logits, out=logits)
        total = logits @ np.ones(logits.shape[1], logits.dtype)
        got -= np.log(total)
        if share is not None:
            logits *= (share / total)[:, None]
            cells[place] -= share
        return got


def log_probs(p, states: np.ndarray, word: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """Natural log probabilities. word: frequent word, or -1, whose class is given by tail."""
    held = _Sorted(p, _rows(states.T[None]), word, tail, np.arange(len(word)))
    out = np.empty(len(word), states.dtype)
    out[held.order] = held.log_probs()
    return out


def gradient(p, inputs, word, tail, mask, h):
    """(gradients, loss sum, next state) of one window of shape (T, B), for the mean of the masked words."""
    H, (T, B) = h.shape[1], inputs.shape
    x: dict = {}
    after = run_states(_tables(p), inputs, np.ascontiguousarray(h.T), x)
    kind, rows = after.dtype, np.flatnonzero(mask)
    g = {k: np.zeros_like(v) for k, v in p.items()}
    held = _Sorted(p, _rows(after), word, tail, rows)
    got, of_states, of_C, of_W = held.log_probs(1 / max(1, len(rows)))
    loss = -got.sum(dtype="float64")
    g["C"], g["c"], g["W"], g["w"] = of_C[:H], of_C[H], of_W[:, :H], of_W[:, H]
    d = np.zeros((T * B, H + 1), kind)  # words that aren't masked have none
    d[held.order] = of_states
    dS = np.ascontiguousarray(d.reshape(T, B, H + 1)[:, :, :H].transpose(0, 2, 1))
    a, before = x["a"], x["before"]
    z, r, n = a[:, :H], a[:, H : 2 * H], a[:, 2 * H :]
    dn = (1 - z) * (1 - n * n)
    slope = np.empty((T, 3, H, B), kind)  # of what U gives, for each part of it
    slope[:, 0] = (before - n) * z * (1 - z)
    slope[:, 2] = dn * r
    slope[:, 1] = slope[:, 2] * x["an"] * (1 - r)
    U, dh, part = np.ascontiguousarray(p["U"]), np.zeros((H, B), kind), np.empty((H, B), kind)
    da = slope.reshape(T, 3 * H, B)
    for t in range(T - 1, -1, -1):
        d = dS[t]
        d += dh
        slope[t] *= d
        g["U"] += before[t] @ da[t].T
        np.matmul(U, da[t], out=dh)
        np.multiply(d, z[t], out=part)
        dh += part
        if x["resets"][t]:
            dh *= x["keep"][t]
    slope[:, 2] = dS * dn
    da = da.transpose(1, 0, 2).reshape(3 * H, T * B)
    ids = inputs.ravel().astype("uint16")
    by = np.argsort(ids, kind="stable")
    ids = ids[by]
    starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    g["E"][ids[starts]] = np.add.reduceat(da.take(by, axis=1, mode="clip"), starts, axis=1).T
    g["b"] = g["E"].sum(0)
    return g, float(loss), after[-1].T


class Trainer:
    """Adam on windows of a stream of documents; lanes run side by side."""

    def __init__(self, p, rate: float = 0.01, lanes: int = 64):
        self.p, self.rate, self.lanes, self.k = {k: v.copy() for k, v in p.items()}, rate, lanes, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    def train(self, docs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[float, int]:
        """docs: (words, tails) as for ``log_probs``. Returns the loss and the number of words."""
        total, seen = 0.0, 0
        inputs, word, tail, mask, place = lanes(docs, self.lanes)
        ends = np.zeros(inputs.shape[1], "int64")
        for (w, _), (k, a) in zip(docs, place, strict=True):
            ends[k] = max(ends[k], a + len(w))
        h = np.zeros((inputs.shape[1], self.p["U"].shape[0]), "float32")
        a, last = 0, int(ends.max())
        while a < last:
            live = np.flatnonzero(ends > a)
            b = a + max(WINDOW, WINDOW * self.lanes // len(live))  # few lanes have long windows: steps are of about equally many words
            s = np.s_[a:b, live]
            g, loss, h[live] = gradient(self.p, inputs[s], word[s], tail[s], mask[s], h[live])
            total, seen, a = total + loss, seen + int(mask[s].sum()), b
            self.step(g)
        return total, seen

    def step(self, g) -> None:
        self.k += 1
        norm = np.sqrt(sum(float(np.dot(x.ravel(), x.ravel())) for x in g.values()))
        scale = min(1.0, 1.0 / (norm + 1e-9))
        first, second = 1 - 0.9**self.k, np.sqrt(1 - 0.99**self.k)
        for k, x in g.items():
            m, v = self.m[k], self.v[k]
            x *= scale
            m *= 0.9
            m += 0.1 * x
            x *= x
            x *= 0.01
            v *= 0.99
            v += x
            np.sqrt(v, out=x)
            x += 1e-6 * second
            np.divide(m, x, out=x)
            x *= self.rate * second / first
            self.p[k] -= x


def lanes(docs, width: int):
    """Deal documents to lanes of about equal length: (inputs, word, tail, mask) of shape (T, B), and each document's (lane, start)."""
    width = max(1, min(width, len(docs)))
    ends = [(0, k) for k in range(width)]  # a heap
    place = [(0, 0)] * len(docs)
    for i in sorted(range(len(docs)), key=lambda i: -len(docs[i][0])):
        a, k = ends[0]
        place[i] = k, a
        heapq.heapreplace(ends, (a + len(docs[i][0]), k))
    T = max(ends)[0]
    inputs, word = np.full((T, width), START, "int32"), np.full((T, width), -1, "int32")
    tail, mask = np.zeros((T, width), "int32"), np.zeros((T, width), bool)
    for (w, t), (k, a) in zip(docs, place, strict=True):
        b = a + len(w)
        word[a:b, k], tail[a:b, k], mask[a:b, k] = w, t, True
        inputs[a + 1 : b, k] = np.where(w >= 0, w, FREQUENT + t)[:-1]
    return inputs, word, tail, mask, place


def score(p, docs: list[tuple[np.ndarray, np.ndarray]], width: int = 512, window: int = 32) -> np.ndarray:
    """Sum of natural log probabilities of each document, without the tail's share inside its class.

    Documents longer than a lane's fair share run beside each other, so that few steps have few lanes.
    """
    out = np.zeros(len(docs))
    sizes = np.asarray([len(w) for w, _ in docs])
    fair = max(256, sizes.sum() // width)
    for group in (np.flatnonzero(sizes > fair), np.flatnonzero(sizes <= fair)):
        if len(group):
            out[group] = _score(p, [docs[i] for i in group], width, window)
    return out


def _score(p, docs, width: int, window: int) -> np.ndarray:
    inputs, word, tail, mask, place = lanes(docs, width)
    h = np.zeros((p["U"].shape[0], inputs.shape[1]), "float32")
    lp = np.zeros(inputs.shape, "float32")
    tables = _tables(p)
    for a in range(0, len(inputs), window):
        s = slice(a, a + window)
        live = np.flatnonzero(mask[s].any(0))
        at = np.s_[s, live] if len(live) < len(h[0]) else np.s_[s]
        m = mask[at]
        states = run_states(tables, inputs[at], h[:, live])
        h[:, live] = states[-1]
        held = _Sorted(p, _rows(states), word[at], tail[at], np.flatnonzero(m))
        got = np.zeros(m.size, "float32")
        got[held.order] = held.log_probs()
        lp[at] = got.reshape(m.shape)
    out = np.zeros(len(docs))
    for i, ((w, _), (k, a)) in enumerate(zip(docs, place, strict=True)):
        out[i] = lp[a : a + len(w), k].sum(dtype="float64")
    return out
