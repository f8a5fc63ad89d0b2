"""The two learners against plain versions of what they compute."""

import numpy as np

from grove.llm import langid as L
from grove.llm import toxicity as X


def plain_states(net, side, data):
    """One gated recurrent layer, byte by byte, in doubles."""
    h, x, u = L.UNITS, net.p[f"x{side}"].astype(float), net.p[f"u{side}"].astype(float)
    state, out = np.zeros(h), []
    sigmoid = lambda a: 1 / (1 + np.exp(-a))
    for byte in data:
        a, r = x[byte], state @ u
        update, reset = sigmoid(a[:h] + r[:h]), sigmoid(a[h : 2 * h] + r[h : 2 * h])
        candidate = np.tanh(a[2 * h :] + reset * r[2 * h :])
        state = (1 - update) * candidate + update * state
        out.append(state)
    return np.array(out).reshape(-1, h)


def plain_predict(net, text):
    """The mean over all bytes, each within its span."""
    sums = np.zeros(len(net.languages))
    for at in range(0, len(text), L.SPAN):
        span = text[at : at + L.SPAN]
        both = np.concatenate([plain_states(net, "f", span), plain_states(net, "b", span[::-1])[::-1]], axis=1)
        logits = both @ net.p["o"].astype(float) + net.p["c"]
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        sums += (e / e.sum(axis=1, keepdims=True)).sum(axis=0)
    return sums / max(len(text), 1)


def test_predictions_are_a_plain_networks():
    net = L.Network(["de", "en", "fr"], seed=3)
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 256, n).astype(np.uint8) for n in (0, 1, 127, 128, 129, 300, 256, 5)]
    offsets = np.cumsum([0, *map(len, texts)])
    found = net.predict(np.concatenate(texts), offsets)
    assert np.allclose(found, [plain_predict(net, t) for t in texts], atol=1e-4)


def plain_risk(w, positive, unlabelled, prior):
    z = lambda bag: sum(w[i] for i in bag) + w[-1]
    plus = prior * np.mean([np.log1p(np.exp(-z(b))) for b in positive])
    minus = np.mean([np.log1p(np.exp(z(b))) for b in unlabelled]) - prior * np.mean([np.log1p(np.exp(z(b))) for b in positive])
    return plus, minus


def numeric(f, w):
    step = np.eye(len(w)) * 1e-6
    return np.array([(f(w + e) - f(w - e)) / 2e-6 for e in step])


def test_the_risk_and_its_gradient():
    """Of both kinds: the part on negatives above zero, and below it, where its gradient turns."""
    rng = np.random.default_rng(2)
    bag = lambda: np.sort(rng.choice(6, rng.integers(0, 5), replace=False)).astype(np.int64)
    kinds = set()
    for trial in range(40):
        positive, unlabelled = [bag() for _ in range(7)], [bag() for _ in range(9)]
        w, prior = rng.normal(0, 2, 7), (0.2, 0.9)[trial % 2]
        risk, g = X.corrected_risk(w, X._flat(positive), X._flat(unlabelled), prior)
        plus, minus = plain_risk(w, positive, unlabelled, prior)
        kinds.add(minus < 0)
        if minus < 0:
            want, at = plus, -numeric(lambda v: plain_risk(v, positive, unlabelled, prior)[1], w)
        else:
            want, at = plus + minus, numeric(lambda v: sum(plain_risk(v, positive, unlabelled, prior)), w)
        assert np.isclose(risk, want) and np.allclose(g, at, atol=1e-5)
    assert kinds == {True, False}


def test_nothing_is_rejected_where_nothing_is_known():
    for model in (X.train([], ["a", "b"], 0.9), X.train(["a"] * 5, [], 0.9), X.train(["same words"] * 5, ["same words"] * 9, 0.9)):
        assert model.scorer()("any text at all") < 1e-20
