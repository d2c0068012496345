"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

Inputs of a word are a word vector (words known from training) and the mean of the vectors of its byte trigrams (all
words).  Two gated recurrent layers read a window of words forward and backward, attention pools their states to one
vector, and a logistic unit scores it.  All overlapping windows of a text are scored; the text's score is the calibrated
maximum.  Training sees a bounded sample of labelled documents, whole; windows take the label of their document first,
later passes keep, of a toxic document, only the windows that score highest.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thalweg.llm import textkernel as tk

#: Bounds of the training sample: documents of class 0 and 1, and characters of a document that may be in it.  Every fourth
#: document of either class is kept from training and calibrates the scores.
TRAIN_DOCS, TRAIN_CHARS = (1600, 800), 20_000
WINDOW, STRIDE = 32, 16
WORD_DIM, CHAR_DIM, HIDDEN = 8, 8, 8
VOCABULARY, TRIGRAMS = 16_384, 4096
#: What a document that was trained on counts in the calibration, beside 1 for a spared one.
SEEN = 0.1
#: Passes over the sample: at least the first number, and more, up to the second, while there were fewer steps than ``STEPS``.
EPOCHS, STEPS, BATCH, RATE = (4, 24), 400, 256, 0.01
U64 = np.uint64


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-x))


def _tanh(x):
    return 2.0 / (1.0 + np.exp(-2.0 * x)) - 1.0


class Words:
    """The distinct words of a batch of documents: ``kind`` of each word, ``before`` per document, hashes and trigrams per
    kind."""

    def __init__(self, data, offsets):
        hashes, self.before, start, end = tk.words(data, offsets, spans=True, space=tk.PUNCTUATION)
        self.hashes, first, self.kind = np.unique(hashes, return_index=True, return_inverse=True)
        base = int(offsets[0])
        s, n = start[first] + base, (end - start)[first]
        # each kind as <word>: length + 2 bytes, so length trigrams
        total = int(n.sum())
        self.tri_at = np.cumsum(n) - n
        inner = np.arange(total) - np.repeat(self.tri_at, n)
        at = np.repeat(s, n) + inner
        low = tk.LOWER[data]
        mid = low[at].astype(np.int64)
        left = np.where(inner > 0, low[np.maximum(at - 1, 0)], 1).astype(np.int64)
        right = np.where(inner < np.repeat(n, n) - 1, low[np.minimum(at + 1, len(data) - 1)], 2).astype(np.int64)
        self.tri = ((left * 961 + mid) * 1021 + right) * 2654435761 >> 12 & (TRIGRAMS - 1)
        self.tri_n = n


def window_starts(n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and first word (within the document) of every window; the last window ends with the document."""
    count = np.where(n_words > WINDOW, -(-(n_words - WINDOW) // STRIDE) + 1, (n_words > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(n_words)), count)
    k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return owner, np.minimum(k * STRIDE, np.maximum(0, n_words[owner] - WINDOW))


class Network:
    def __init__(self, vocabulary: np.ndarray, prior: np.ndarray, seed: int = 11):
        """``vocabulary``: sorted hashes; ``prior``: a first value for each word's first component."""
        rng = np.random.default_rng(seed)
        small = lambda *shape: (rng.standard_normal(shape) * 0.2).astype(np.float32)
        x, h = WORD_DIM + CHAR_DIM, HIDDEN
        self.vocabulary = vocabulary
        word = small(len(vocabulary) + 1, WORD_DIM) * 0.25
        word[:-1, 0] = prior
        word[-1] = 0
        self.p = {"word": word, "char": small(TRIGRAMS, CHAR_DIM), "v": small(2 * h), "out": small(2 * h), "bias": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": small(x, 3 * h), f"b{d}": np.zeros(3 * h, np.float32), f"U{d}": small(h, 3 * h)}
        self.a, self.c = 1.0, 0.0

    def rows(self, hashes):
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), max(0, len(self.vocabulary) - 1))
        known = self.vocabulary[at] == hashes if len(self.vocabulary) else np.zeros(len(hashes), bool)
        return np.where(known, at, len(self.vocabulary))

    def inputs(self, words: Words):
        if not len(words.hashes):
            return np.zeros((0, WORD_DIM + CHAR_DIM), np.float32)
        chars = np.add.reduceat(self.p["char"][words.tri], words.tri_at, axis=0) / words.tri_n[:, None]
        return np.concatenate([self.p["word"][self.rows(words.hashes)], chars.astype(np.float32)], axis=1)

    def forward(self, x, kinds, mask, keep=False):
        """Logits of windows: x inputs per kind, kinds (B, T), mask (B, T)."""
        p, h, (b, t) = self.p, HIDDEN, kinds.shape
        states, trail = np.empty((b, t, 2 * h), np.float32), {}
        full = bool(mask.all())
        for d, order in (("f", range(t)), ("b", range(t - 1, -1, -1))):
            gates = x @ p[f"W{d}"] + p[f"b{d}"]
            u_zr, u_n = p[f"U{d}"][:, : 2 * h], p[f"U{d}"][:, 2 * h :]
            state, steps = np.zeros((b, h), np.float32), []
            for k in order:
                g = gates[kinds[:, k]]
                zr = _sigmoid(g[:, : 2 * h] + state @ u_zr)
                z, r = zr[:, :h], zr[:, h:]
                n = _tanh(g[:, 2 * h :] + (r * state) @ u_n)
                new = n + z * (state - n)
                if not full:
                    new = np.where(mask[:, k, None], new, state)
                if keep:
                    steps.append((k, state, z, r, n))
                state = new
                states[:, k, :h] if d == "f" else states[:, k, h:]
                if d == "f":
                    states[:, k, :h] = state
                else:
                    states[:, k, h:] = state
            trail[d] = steps
        e = states @ p["v"]
        if not full:
            e = np.where(mask, e, np.float32(-1e9))
        w = np.exp(e - e.max(axis=1, keepdims=True))
        w /= w.sum(axis=1, keepdims=True)
        pooled = np.einsum("bt,bth->bh", w, states)
        logit = pooled @ p["out"] + p["bias"][0]
        return (logit, states, w, pooled, trail) if keep else logit

    def gradients(self, x, kinds, mask, label, weight):
        p, h = self.p, HIDDEN
        logit, states, w, pooled, trail = self.forward(x, kinds, mask, keep=True)
        g_logit = ((_sigmoid(logit) - label) * weight / len(label)).astype(np.float32)
        grad = {"out": pooled.T @ g_logit, "bias": g_logit.sum(keepdims=True)}
        g_pooled = g_logit[:, None] * p["out"]
        along = np.einsum("bth,bh->bt", states, g_pooled)
        g_e = w * (along - (w * along).sum(axis=1, keepdims=True))
        grad["v"] = np.einsum("bt,bth->h", g_e, states)
        g_states = w[:, :, None] * g_pooled[:, None, :] + g_e[:, :, None] * p["v"]
        g_x = np.zeros_like(x)
        by_kind = np.argsort(kinds.T, axis=None, kind="stable")  # steps and windows in the order of their words
        named = kinds.T.ravel()[by_kind]
        first = np.flatnonzero(np.r_[True, named[1:] != named[:-1]])
        for d, cut in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
            u_zr, u_n = p[f"U{d}"][:, : 2 * h], p[f"U{d}"][:, 2 * h :]
            g_u, g_gates = np.zeros_like(p[f"U{d}"]), np.zeros((len(x), 3 * h), np.float32)
            g_steps = np.empty((kinds.shape[1], len(kinds), 3 * h), np.float32)
            carry = np.zeros((len(kinds), h), np.float32)
            for k, state, z, r, n in reversed(trail[d]):
                total = g_states[:, k, cut] + carry
                on = mask[:, k, None]
                live = np.where(on, total, 0)
                g_n = live * (1 - z) * (1 - n * n)
                g_z = live * (state - n) * z * (1 - z)
                back_n = g_n @ u_n.T
                g_r = back_n * state * r * (1 - r)
                g_zr = np.concatenate([g_z, g_r], axis=1)
                g_u[:, : 2 * h] += state.T @ g_zr
                g_u[:, 2 * h :] += (r * state).T @ g_n
                g_steps[k, :, : 2 * h], g_steps[k, :, 2 * h :] = g_zr, g_n
                carry = np.where(on, live * z + back_n * r + g_zr @ u_zr.T, total)
            g_gates[named[first]] = np.add.reduceat(g_steps.reshape(-1, 3 * h)[by_kind], first, axis=0)
            grad |= {f"U{d}": g_u, f"W{d}": x.T @ g_gates, f"b{d}": g_gates.sum(axis=0)}
            g_x += g_gates @ p[f"W{d}"].T
        return grad, g_x

    def window_logits(self, words: Words, owner, start, batch=4096):
        x = self.inputs(words)
        n = np.diff(words.before)[owner]
        out = np.empty(len(owner), np.float32)
        for lo in range(0, len(owner), batch):
            kinds, mask = gather(words, owner[lo : lo + batch], start[lo : lo + batch], n[lo : lo + batch])
            out[lo : lo + batch] = self.forward(x, kinds, mask)
        return out

    def document_logits(self, data, offsets):
        """Largest window logit of each document; -inf for one without words."""
        words = Words(data, offsets)
        owner, start = window_starts(np.diff(words.before))
        best = np.full(len(offsets) - 1, -np.inf, np.float32)
        if len(owner):
            order = np.argsort(np.diff(words.before)[owner] < WINDOW, kind="stable")  # full windows need no masks
            np.maximum.at(best, owner[order], self.window_logits(words, owner[order], start[order]))
        return best

    def scores(self, logits):
        with np.errstate(over="ignore"):
            return np.where(np.isfinite(logits), _sigmoid(self.a * logits.astype(np.float64) + self.c), 0.0)


def gather(words: Words, owner, start, n):
    at = start[:, None] + np.arange(WINDOW)
    mask = at < n[:, None]
    at = np.where(mask, at, 0) + words.before[owner][:, None]
    return words.kind[at], mask


def train(texts, labels, share: float | None = None, epochs=EPOCHS, seed: int = 11) -> Network:
    """Network from whole texts and 0/1 labels.  ``share``: of label 1 among all rows, where the sample is dealt otherwise.
    With labels of one class only, every score is that of the class."""
    labels = np.asarray(labels, np.int64)
    spared = np.zeros(len(labels), bool)
    for c in (0, 1):
        spared[np.flatnonzero(labels == c)[3::4]] = True
    share = labels.mean() if share is None and len(labels) else share
    data, offsets = tk.utf8(pa.array(list(texts), pa.string()))
    words = Words(data, offsets)
    n_words = np.diff(words.before)
    doc = np.repeat(np.arange(len(labels)), n_words)
    pairs = np.unique(doc * (len(words.hashes) + 1) + words.kind)
    d_of, k_of = pairs // (len(words.hashes) + 1), pairs % (len(words.hashes) + 1)
    per = [np.bincount(k_of[(labels[d_of] == c) & ~spared[d_of]], minlength=len(words.hashes)) for c in (0, 1)]
    n = [max(1, int(((labels == c) & ~spared).sum())) for c in (0, 1)]
    odds = np.log((per[1] + 0.5) / (n[1] + 1.0)) - np.log((per[0] + 0.5) / (n[0] + 1.0))
    known = np.flatnonzero(per[0] + per[1] >= 2)
    known = np.sort(known[np.argsort(-(per[0] + per[1])[known] * np.abs(odds[known]), kind="stable")[:VOCABULARY]])
    net = Network(words.hashes[known], np.clip(odds[known] / 2, -2, 2).astype(np.float32), seed)
    if len(set(labels.tolist())) < 2 or not len(words.kind):
        net.a, net.c = 0.0, 6.0 if len(labels) and labels.all() else -6.0
        return net
    rng = np.random.default_rng(seed)
    owner, start = window_starts(n_words)
    whole = (start % (2 * STRIDE) == 0) | (n_words[owner] <= start + WINDOW)  # every other window covers the text
    whole &= ~spared[owner]
    owner, start = owner[whole], start[whole]
    label = labels[owner]
    active = np.ones(len(owner), bool)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    rows = net.rows(words.hashes)
    for epoch in range(epochs[1]):
        if epoch >= epochs[0] and step >= STEPS:
            break
        if epoch >= 1:
            logits = net.window_logits(words, owner, start)
            best = np.full(len(labels), -np.inf)
            np.maximum.at(best, owner, logits)
            active = (label == 0) | (logits >= best[owner] - 1.0)
        positive, negative = np.flatnonzero(active & (label == 1)), np.flatnonzero(active & (label == 0))
        most = max(2048, 3 * len(positive))
        if len(negative) > most:  # windows alike to thousands of others; all are scored again each epoch
            hard = negative[np.argsort(-logits[negative], kind="stable")[: most // 2]] if epoch else negative[:0]
            negative = np.union1d(hard, rng.choice(negative, most - len(hard), replace=False))
        chosen = rng.permutation(np.r_[positive, negative])
        lift = np.float32(max(1.0, min(4.0, len(negative) / max(1, len(positive)))))
        for lo in range(0, len(chosen), BATCH):
            own = chosen[lo : lo + BATCH]
            kinds, mask = gather(words, owner[own], start[own], n_words[owner[own]])
            used, inverse = np.unique(kinds, return_inverse=True)
            inverse = inverse.reshape(kinds.shape)
            tri_n = words.tri_n[used]
            tri_at = np.cumsum(tri_n) - tri_n
            tri = words.tri[np.repeat(words.tri_at[used] - tri_at, tri_n) + np.arange(tri_n.sum())]
            x = np.concatenate([net.p["word"][rows[used]], np.add.reduceat(net.p["char"][tri], tri_at, axis=0) / tri_n[:, None]], axis=1).astype(np.float32)
            grad, g_x = net.gradients(x, inverse, mask, label[own].astype(np.float32), np.where(label[own] == 1, lift, np.float32(1)))
            grad["word"], grad["char"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["char"])
            grad["word"][rows[used]] = g_x[:, :WORD_DIM]  # known words are met once among those used
            grad["word"][-1] = 0
            spread = np.repeat(g_x[:, WORD_DIM:] / tri_n[:, None], tri_n, axis=0)
            cell = tri[:, None] * CHAR_DIM + np.arange(CHAR_DIM)
            grad["char"] += np.bincount(cell.ravel(), spread.ravel(), TRIGRAMS * CHAR_DIM).reshape(TRIGRAMS, CHAR_DIM).astype(np.float32)
            step += 1
            for k, g in grad.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                net.p[k] -= (RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    best = np.full(len(labels), -np.inf)
    owner, start = window_starts(n_words)
    np.maximum.at(best, owner, net.window_logits(words, owner, start))
    told = np.isfinite(best)
    y, weight = labels[told], np.where(spared[told], 1.0, SEEN)
    of_class = np.array([weight[y == c].sum() for c in (0, 1)])
    weight = weight * np.where(y == 1, share, 1 - share) / np.maximum(1e-9, of_class[y.astype(int)]) * len(y)
    net.a, net.c = _calibrate(best[told], y, weight)
    return net


def _calibrate(x, y, weight, rounds=100):
    """Weighted logistic fit of labels to logits, lightly held to slope 1."""
    a, c = 1.0, 0.0
    for _ in range(rounds):
        p = _sigmoid(a * x + c)
        w = weight * p * (1 - p) + 1e-9
        g = np.array([(weight * (p - y) * x).sum() + 0.1 * (a - 1), (weight * (p - y)).sum() + 0.1 * c])
        hess = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum() + 0.1]])
        move = np.linalg.solve(hess, g)
        a, c = a - np.clip(move[0], -1, 1), c - np.clip(move[1], -2, 2)
    return max(float(a), 0.05), float(c)


def fit(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text") -> Network:
    """Network from labelled rows outside the held-out fifth, at most ``TRAIN_DOCS`` of each class, chosen by a hash of the
    id among texts of at most ``TRAIN_CHARS`` characters, never cut.  Rows with null ids, labels or texts are not used.  The bounded
    sample is learned in one task, which is repeated with the same result if it is lost."""
    marked = labels.where(F.col(id_col).isNotNull() & F.col("toxic").isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.max("toxic").alias("_toxic"))
    marked = marked.where(F.crc32(F.col("_id").cast("string").cast("binary")) % 5 != 0)
    n = dict(marked.groupBy("_toxic").count().collect())
    order = F.md5(F.concat(F.lit("toxic:"), F.col("_id").cast("string")).cast("binary"))
    few = [marked.where(F.col("_toxic") == c).orderBy(order, "_id").limit(2 * TRAIN_DOCS[c]) for c in (0, 1)]
    ids = F.broadcast(few[0].unionByName(few[1]))  # at most twice the sum of TRAIN_DOCS
    text = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).where(F.length("_text") <= TRAIN_CHARS)
    rows = text.join(ids, "_id").select(order.alias("_order"), "_text", "_toxic")
    chosen = [rows.where(F.col("_toxic") == c).orderBy("_order", "_text").limit(TRAIN_DOCS[c]) for c in (0, 1)]
    share = n.get(1, 0) / max(1, sum(n.values()))

    def learn(batches):
        held = sorted(r for b in batches for r in zip(*(b.column(k).to_pylist() for k in (2, 0, 1))))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train([r[2] for r in held], [r[0] for r in held], share))], pa.binary())], ["model"])

    sample = chosen[0].unionByName(chosen[1]).select("_order", "_text", F.col("_toxic").cast("int")).coalesce(1)
    learned = sample.mapInArrow(learn, "model binary").collect()
    return pickle.loads(learned[0][0]) if learned else train([], [], 0.0)


def _document_scores(net, column):
    data, offsets = tk.utf8(column)
    parts = [net.document_logits(data, offsets[lo : hi + 1]) for lo, hi in tk.chunks(offsets, 2 << 20)]
    return net.scores(np.concatenate(parts)) if parts else np.zeros(0)


def score_documents(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row.

    ``held_out``: crc32 of the id as text is divisible by 5 (null id: false).  Scores lie in 0 to 1; texts that are null or have
    no word score 0.  Repeated rows score alike.  With no labels at all, or one class, scores say that class or 0.  Other
    columns are ignored; an empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col))

    def run(batches):
        net = held.value
        for b in batches:
            s = _document_scores(net, b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    kind = dict(docs.dtypes)[id_col]
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double, predicted int")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """Rows that are not predicted toxic; columns as in ``docs``, whatever their names.

    Null texts and texts without words score 0 and stay.  Repeated rows stay or go alike, null ids are never learned from, and an empty table gives no rows."""
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col))
    at = docs.columns.index(text_col)

    def run(batches):
        net = held.value
        for b in batches:
            yield b.filter(pa.array(_document_scores(net, b.column(at)) < 0.5))

    return docs.mapInArrow(run, docs.schema)
