import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from thalweg.llm import textkernel as tk
from thalweg.llm import toxicity as T


def test_gradients_against_differences():
    rng = np.random.default_rng(0)
    net = T.Network(np.arange(5, dtype=np.uint64), np.zeros(5, np.float32))
    net.p = {k: v.astype(np.float64) + 0.05 * rng.standard_normal(v.shape) for k, v in net.p.items()}
    x = rng.standard_normal((6, T.WORD_DIM + T.CHAR_DIM))
    kinds = rng.integers(0, 6, (4, 7))
    mask = np.arange(7) < np.array([7, 5, 3, 1])[:, None]
    label, weight = np.array([1.0, 0, 1, 0]), np.array([2.0, 1, 1, 1])

    def loss():
        z = net.forward(x, kinds, mask).astype(np.float64)
        return (weight * (np.logaddexp(0, z) - label * z)).sum() / 4

    grad, g_x = net.gradients(x, kinds, mask, label, weight)
    for k in ("Wf", "Ub", "bf", "v", "out", "bias", "Uf", "Wb"):
        at = tuple(rng.integers(0, s) for s in net.p[k].shape)
        own = net.p[k]
        own[at] += 1e-3
        up = loss()
        own[at] -= 2e-3
        down = loss()
        own[at] += 1e-3
        assert (up - down) / 2e-3 == pytest.approx(grad[k][at], abs=2e-3, rel=0.05), k
    x[2, 3] += 1e-3
    up = loss()
    x[2, 3] -= 2e-3
    down = loss()
    assert (up - down) / 2e-3 == pytest.approx(g_x[2, 3], abs=2e-3, rel=0.05)


def test_windows_cover_and_overlap():
    for n in (0, 1, 31, 32, 33, 48, 49, 100, 1000):
        owner, start = T.window_starts(np.array([n]))
        covered = {i for s in start for i in range(s, min(n, s + T.WINDOW))}
        assert covered == set(range(n))
        assert all(b - a <= T.STRIDE for a, b in zip(start, start[1:]))


def made(n, seed=2):
    rng = random.Random(seed)
    voc = [f"word{i}" for i in range(300)]
    bad = ["vile", "awful", "nasty", "rotten"]
    rows, labels = [], []
    for d in range(n):
        text = [rng.choice(voc) for _ in range(rng.randrange(5, 150))]
        toxic = int(rng.random() < 0.3)
        for _ in range(3 * toxic):
            text.insert(rng.randrange(len(text)), rng.choice(bad))
        rows.append((d, " ".join(text)))
        labels.append((d, 1, toxic))
    return rows, labels


def test_held_out_accuracy_and_edge_cases(spark):
    rows, labels = made(500)
    rows += [(9000, None), (9001, ""), (9002, " ,.! "), (None, "vile"), (9003, "word1 " * 40000 + "vile awful " + "word2 " * 5000), (0, rows[0][1])]
    docs = spark.createDataFrame([r + (r[0],) for r in rows], "doc_id long, text string, score long")
    marks = spark.createDataFrame(labels + [(1, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    out = T.score_documents(docs, marks).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    truth = {d: t for d, _, t in labels}
    held = [r for r in out if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert {r.doc_id for r in out if r.held_out} == {r.doc_id for r in held}
    known = [r for r in held if r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in known) >= 0.95 * len(known)
    by = {r.doc_id: r for r in out}
    assert by[9000].score == by[9001].score == by[9002].score == 0 and by[9003].predicted == 1
    assert T.score_documents(docs.limit(0), marks).count() == 0
    none = T.score_documents(docs, marks.limit(0)).collect()
    assert len(none) == len(rows) and not any(r.predicted for r in none)
    kept = T.drop_toxic(docs, marks)
    assert kept.columns == docs.columns and sorted((r.doc_id or -1) for r in kept.collect()) == sorted((r.doc_id or -1) for r in out if not r.predicted)


def test_scores_do_not_depend_on_the_batch():
    rows, labels = made(60, 5)
    net = T.train([t for _, t in rows], [x for _, _, x in labels], epochs=(1, 1))
    texts = pa.array([t for _, t in rows])
    together = T._document_scores(net, texts)
    data, offsets = tk.utf8(texts)
    alone = [net.scores(net.document_logits(data, offsets[i : i + 2]))[0] for i in range(len(rows))]
    assert np.allclose(together, alone, atol=1e-4)


def plain_logit(net, text):
    """The largest window logit, word by word and step by step in plain Python."""
    import math

    p = {k: v.astype(float).tolist() for k, v in net.p.items()}
    h = T.HIDDEN
    words = [w for w in re.split(r"[\s!-/:-@\[-`{-~]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)) if w]

    def vector(word):
        (key,) = tk.words(*tk.utf8(pa.array([word])))[0].tolist()
        known = np.flatnonzero(net.vocabulary == np.uint64(key))
        b = [1, *word.encode(), 2]
        grams = [((b[i] * 961 + b[i + 1]) * 1021 + b[i + 2]) * 2654435761 // 4096 % T.TRIGRAMS for i in range(len(b) - 2)]
        chars = [sum(p["char"][g][k] for g in grams) / len(grams) for k in range(T.CHAR_DIM)]
        return p["word"][known[0] if len(known) else -1] + chars

    def read(window, d):
        state, out = [0.0] * h, []
        for x in window:
            g = [sum(a * w for a, w in zip(x, column)) + b for column, b in zip(zip(*p[f"W{d}"]), p[f"b{d}"])]
            u = list(zip(*p[f"U{d}"]))
            dot = lambda v, column: sum(a * w for a, w in zip(v, column))
            z = [1 / (1 + math.exp(-g[k] - dot(state, u[k]))) for k in range(h)]
            r = [1 / (1 + math.exp(-g[h + k] - dot(state, u[h + k]))) for k in range(h)]
            gated = [a * b for a, b in zip(r, state)]
            n = [math.tanh(g[2 * h + k] + dot(gated, u[2 * h + k])) for k in range(h)]
            state = [(1 - z[k]) * n[k] + z[k] * state[k] for k in range(h)]
            out.append(state)
        return out

    best = -math.inf
    starts = sorted({min(s, max(0, len(words) - T.WINDOW)) for s in range(0, max(1, len(words) - T.WINDOW + T.STRIDE), T.STRIDE)})
    for s in starts if words else []:
        window = [vector(w) for w in words[s : s + T.WINDOW]]
        states = [a + b for a, b in zip(read(window, "f"), reversed(read(window[::-1], "b")))]
        weights = [math.exp(sum(a * v for a, v in zip(x, p["v"]))) for x in states]
        pooled = [sum(w * x[k] for w, x in zip(weights, states)) / sum(weights) for k in range(2 * h)]
        best = max(best, sum(a * b for a, b in zip(pooled, p["out"])) + p["bias"][0])
    return best


def test_scores_against_a_plain_network():
    rows, labels = made(80, 7)
    net = T.train([t for _, t in rows], [x for _, _, x in labels], epochs=(2, 2))
    texts = [rows[0][1], rows[1][1], "Vile, AWFUL word3!", "é unknown words über alles", "x", "", " ".join(f"word{i % 50}" for i in range(85))]
    data, offsets = tk.utf8(pa.array(texts))
    assert np.allclose(net.document_logits(data, offsets), [plain_logit(net, t) for t in texts], atol=2e-3)
