import math
import zlib

import numpy as np
import pyarrow as pa

from thalweg.llm import langid as L
from thalweg.llm import textkernel as tk


def plain_cost(texts, probe):
    """Code length of a probe by dictionaries, with the same pruning."""
    trees = [{}, {}, {}, {}]
    for t in texts:
        b = bytes(tk.LOWER[np.frombuffer(t.encode(), np.uint8)])
        for i in range(len(b)):
            for k in range(4):
                context = b[i - k : i] if i >= k else b"\0" * (k - i) + b[:i]
                trees[k].setdefault(context, {}).setdefault(b[i], 0)
                trees[k][context][b[i]] += 1
    b = bytes(tk.LOWER[np.frombuffer(probe.encode(), np.uint8)])
    seen = {x for n in trees[0].values() for x in n}
    fold = lambda s: bytes(x if x in seen else 0 for x in s)
    total = 0.0
    for i in range(len(b)):
        bits = 0.0
        for k in (3, 2, 1, 0):
            context = fold(b[i - k : i] if i >= k else b"\0" * (k - i) + b[:i])
            n = trees[k].get(context, {})
            if k and sum(n.values()) < L.LEAST_COUNT:
                continue
            if b[i] in n:
                total += bits + math.log2((sum(n.values()) + len(n)) / n[b[i]])
                break
            bits += math.log2((sum(n.values()) + len(n)) / len(n))
        else:
            total += bits + 8
    return total


def test_code_lengths_against_plain_trees():
    texts = {"x": ["the cat sat on the mat " * 3, "then there"], "y": ["der hund und die katze " * 4]}
    model = L.Trees(texts)
    probes = ["the hat", "", "und Ünd z9", "t", "ab", "the the the der"]
    data, offsets = tk.utf8(pa.array(probes))
    got = model.lengths(data, offsets)
    want = [[0.0] * 2 for _ in probes]
    for i, p in enumerate(probes):
        for j, lang in enumerate(model.langs):
            want[i][j] = plain_cost(texts[lang], p) if p else 0.0
    # bytes seen by the other language only cost 8 bits below all contexts in both forms
    assert np.allclose(got, want, atol=1e-3)


def test_blocks_do_not_matter(monkeypatch):
    model = L.Trees({"x": ["the cat sat on the mat " * 3], "y": ["der hund und die katze " * 4]})
    data, offsets = tk.utf8(pa.array(["the cat and the dog", "", "x", "die katze und der hund " * 9]))
    whole = model.lengths(data, offsets)
    monkeypatch.setattr(L, "_BLOCK", 7)
    assert np.allclose(whole, model.lengths(data, offsets))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = L.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in out if zlib.crc32(str(r.doc_id).encode()) % 3 == 1}
    assert sum(r.lang == r.lang_pred for r in held if r.lang_pred != "und") >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in out)


def test_edge_cases(spark):
    rows = [(1, "the cat", "en"), (2, None, "en"), (3, "", None), (4, "123 -- !", "en"), (None, "the hat", "en"), (5, "der hund", None), (6, "the " * 60000, "en"), (6, "the " * 60000, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in L.identify(docs).collect()}
    assert got == {1: "en", 2: "und", 3: "und", 4: "und", None: "en", 5: "en", 6: "en"}
    assert L.identify(docs.limit(0)).collect() == []
    untaught = docs.select("doc_id", "text").selectExpr("*", "cast(null as string) lang")
    assert {r.lang_pred for r in L.identify(untaught).collect()} == {"und"}


def test_thirty_languages_in_several_scripts():
    """No context is left out, however many languages and symbols there are."""
    rng = np.random.default_rng(5)
    letters = ["abcdefghijklmnop", "абвгдежзийклмноп", "กขคงจฉชซญฎฏฐฑฒณด", "αβγδεζηθικλμνξοπ", "あいうえおかきくけこさしすせそた"]
    texts = {}
    for k in range(30):
        own = list(letters[k % 5])
        words = ["".join(rng.choice(own, int(rng.integers(2, 6)))) for _ in range(40)]
        texts[f"l{k:02}"] = [" ".join(rng.choice(words, 120)) for _ in range(2)]
    model = L.Trees(texts)
    probes = [texts[k][0][:70] for k in list(texts)[::6]]
    got = model.lengths(*tk.utf8(pa.array(probes)))
    want = [[plain_cost(texts[lang], p) for lang in model.langs] for p in probes]
    assert np.allclose(got, want, atol=2e-3)
    assert model.nbytes() < 30 * 200_000
    data, offsets = tk.utf8(pa.array([t[1] for t in texts.values()]))
    assert (model.predict(data, offsets)[0] == np.arange(30)).all()


def test_little_room_changes_nothing(monkeypatch):
    model = L.Trees({"x": ["the cat sat on the mat " * 3], "y": ["der hund und die katze " * 4]})
    args = tk.utf8(pa.array(["the cat and the dog", "", "x", "die katze und der hund " * 9]))
    whole = model.lengths(*args)
    monkeypatch.setattr(L, "_REMEMBERED", 12)
    monkeypatch.setattr(L, "_BLOCK", 11)
    model.forget()
    assert np.allclose(whole, model.lengths(*args))


def test_a_language_of_copies_is_learned(spark):
    rows = [(k, "der hund und die katze " * 20, "de") for k in range(3000)] + [(5000 + k, f"the cat {k}", "en") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert L.fit(docs).langs == ["de", "en"]
