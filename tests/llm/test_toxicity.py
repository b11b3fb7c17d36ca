"""The recurrent network against numeric gradients and against a plain loop over words."""

import numpy as np

from quillrank.llm import toxicity as T


def test_gradients_agree_with_differences():
    model, rng = T.initial(3), np.random.default_rng(0)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    xs, there = rng.standard_normal((5, 3, 6 * T.HIDDEN)), np.ones((5, 3), bool)
    there[3:, 1] = False
    want = rng.standard_normal(3)
    loss = lambda: float(model.forward(xs, there) @ want)
    _, saved = model.forward(xs, there, True)
    g, d_xs = model.backward(want, saved)

    def close(array, gradient):
        flat, got = array.reshape(-1), np.asarray(gradient, float).reshape(-1)
        for k in rng.choice(len(flat), min(12, len(flat)), replace=False):
            was, e = flat[k], 1e-6
            flat[k] = was + e
            up = loss()
            flat[k] = was - e
            down = loss()
            flat[k] = was
            assert abs((up - down) / (2 * e) - got[k]) < 1e-5

    for name in ("uf", "ub", "wa", "ba", "va", "o", "bo"):
        close(model.p[name], g[name])
    close(xs, d_xs)


def plain_logit(model, words):
    sig = lambda x: 1 / (1 + np.exp(-x))
    x = model.inputs(words)[1:].astype(float)
    x = np.concatenate([x, np.zeros((T.WIDTH - len(words), x.shape[1]))])

    def states(rows, w, u, b):
        h, out, n = np.zeros(T.HIDDEN), [], T.HIDDEN
        for row in rows:
            a = row @ w + b
            z, r = sig(a[:n] + h @ u[:, :n]), sig(a[n : 2 * n] + h @ u[:, n : 2 * n])
            c = np.tanh(a[2 * n :] + (r * h) @ u[:, 2 * n :])
            h = h + z * (c - h)
            out.append(h)
        return np.array(out)

    p = model.p
    h = np.concatenate([states(x, p["wf"], p["uf"], p["bf"]), states(x[::-1], p["wb"], p["ub"], p["bb"])[::-1]], axis=1)
    e = (np.tanh(h @ p["wa"] + p["ba"]) @ p["va"])[: len(words)]
    alpha = np.exp(e - e.max()) / np.exp(e - e.max()).sum()
    return float(alpha @ h[: len(words)] @ p["o"] + p["bo"][0])


def test_windows_against_a_plain_loop():
    rng = np.random.default_rng(2)
    model, vocabulary = T.initial(5), [f"wort{k}" for k in range(300)]
    texts = [" ".join(rng.choice(vocabulary, n)) for n in (1, 31, 32, 33, 48, 49, 500)] + ["", None, "!!! ..."]
    for text, got in zip(texts, T.Scorer(model).windows(texts), strict=True):
        words = T.tokens(text)
        starts = T.window_starts(len(words))
        assert {k for s in starts for k in range(s, min(s + T.WIDTH, len(words)))} == set(range(len(words)))
        assert np.allclose(got, [plain_logit(model, words[s : s + T.WIDTH]) for s in starts], atol=1e-4)


def test_training_windows_come_from_the_whole_text():
    text = " ".join(f"w{k}" for k in range(16_000))
    drawn = T.window_texts(text, 100)
    assert len(drawn) == 100 and drawn == T.window_texts(text, 100)
    firsts = sorted(int(w.split(" ")[0][1:]) for w in drawn)
    assert firsts[0] < 1000 and firsts[-1] > 15_000 and any(6000 < k < 10_000 for k in firsts)
    assert T.window_texts("a b", 100) == ["a b"] and T.window_texts(None, 5) == []
