import random
import re

import numpy as np
import pytest

from thalweg.llm import decontaminate as D


def words(text):
    return [w for w in re.split(r"[\s!-/:-@\[-`{-~]+", text.lower()) if w]


def semi_global(item, doc):
    d = [0] * (len(doc) + 1)
    for i, x in enumerate(item, 1):
        e = [i]
        for j, y in enumerate(doc, 1):
            e.append(min(d[j] + 1, e[-1] + 1, d[j - 1] + (x != y)))
        d = e
    return min(d)


def test_edit_distance_against_plain_dp():
    rng = np.random.default_rng(3)
    items = [rng.integers(1, 6, int(rng.integers(1, 12))).astype(np.uint64) for _ in range(60)]
    regions = [rng.integers(1, 6, int(rng.integers(0, 20))).astype(np.uint64) for _ in range(60)]
    got, _ = D.edit_distances(items, regions)
    assert got.tolist() == [semi_global(a.tolist(), b.tolist()) for a, b in zip(items, regions)]


def corpus(seed=5):
    rng = random.Random(seed)
    voc = [f"w{i}" for i in range(900)]
    items = [(i, " ".join(rng.choice(voc) for _ in range(rng.randrange(12, 60)))) for i in range(30)]
    rows = []
    for d in range(220):
        body = [rng.choice(voc) for _ in range(rng.randrange(0, 200))]
        if d % 2:
            _, text = rng.choice(items)
            piece = text.split()
            for _ in range(rng.randrange(0, len(piece) * 26 // 100 + 1)):
                k = rng.randrange(len(piece))
                rng.choice([lambda: piece.__setitem__(k, "zz"), lambda: piece.insert(k, "yy"), lambda: piece.pop(k)])()
            at = rng.randrange(len(body) + 1)
            body[at:at] = piece
        rows.append((d, " ".join(body).title() + "."))
    return rows, items


def test_recall_and_exact_distances(spark):
    rows, items = corpus()
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in D.find_leaks(docs, bench).collect()}
    want = {}
    for d, t in rows:
        doc = words(t)
        for i, x in items:
            item = words(x)
            e = semi_global(item, doc)
            if e <= len(item) * 20 // 100:
                want[d, i] = e
    assert set(got) <= set(want)
    assert len(got) >= 0.97 * len(want)
    assert all(got[k] == want[k] for k in got)
    kept = {r.doc_id for r in D.drop_leaks(docs, bench).collect()}
    assert kept == {d for d, _ in rows} - {d for d, _ in got}


def test_items_of_every_length_with_spread_edits():
    """None is missed: exact copies of short items, and items with the most edits allowed, evenly spread."""
    rng = random.Random(8)
    texts, docs = [], []
    for n in [*range(1, 61)] * 5:
        piece = [f"v{rng.randrange(5000)}" for _ in range(n)]
        texts.append(" ".join(piece))
        edits = n * 20 // 100
        for k in range(edits):
            piece[(2 * k + 1) * n // (2 * edits)] = "zz"
        docs.append(" ".join([f"u{rng.randrange(5000)}" for _ in range(9)] + piece + ["end"] * 9))
    items = D.Items(texts)
    got = D.matches(*D._texts_words(docs), items, items.cells())
    missed = {len(t.split()) for k, t in enumerate(texts) if not ((got[0] == k) & (got[1] == k)).any()}
    assert missed == set()


def planted(n, kind, spread, rng, count=100):
    """Items of n words, each with the most edits allowed, planted in a document of its own."""
    texts, docs = [], []
    for _ in range(count):
        piece = [f"v{rng.randrange(50000)}" for _ in range(n)]
        texts.append(" ".join(piece))
        edits = n * 20 // 100
        for k in reversed(range(edits)):
            at = (2 * k + 1) * n // (2 * edits) if spread else rng.randrange(len(piece))
            op = rng.choice(["swap", "add", "cut"]) if kind == "mixed" else kind
            piece[at : at + (op != "add")] = [] if op == "cut" else [f"z{rng.randrange(50000)}"]
        docs.append(" ".join(["before"] * 9 + piece + ["after"] * 9))
    return texts, docs


@pytest.mark.parametrize("kind", ["swap", "add", "cut", "mixed"])
def test_walks_alone_reach_their_target(kind):
    """The walks are the only way to a candidate: items of every length within reach are found at the stated recall."""
    rng = random.Random(kind)
    for n in [*range(1, 13), 15, 20, 60]:
        for spread in (True, False):
            texts, docs = planted(n, kind, spread, rng)
            items = D.Items(texts)
            got = D.matches(*D._texts_words(docs), items, items.cells())
            found = set(zip(got[0].tolist(), got[1].tolist()))
            assert sum((k, k) in found for k in range(len(texts))) >= D.TARGET * len(texts), (n, spread)


def test_exact_copies_are_always_found():
    """Equal windows have equal embeddings: items of repeated words, at the begin and the end of a text, at any percent."""
    texts = ["la " * n for n in (1, 2, 4, 5, 7, 13)] + ["a b " * n for n in (1, 3, 8)] + ["x", "x y", "p q r s t"]
    docs = [side.format(t) for t in texts for side in ("{}", "q9 {}", "{} q9", "q8 q9 {} q9 q8")]
    for percent in (60, 80, 100):
        items = D.Items(texts, percent)
        got = D.matches(*D._texts_words(docs), items, items.cells(), percent)
        exact = set(zip(got[0][got[2] == 0].tolist(), got[1][got[2] == 0].tolist()))
        assert {(d, d // 4) for d in range(len(docs))} <= exact


def test_windows_are_as_large_as_their_item():
    items = D.Items([" ".join(f"w{i}" for i in range(n)) for n in range(1, 31)])
    assert [n for n, *_ in items.lengths] == list(D.LENGTHS)
    for n, family, tables, _ in items.lengths:
        own = np.diff(items.before)[items.item[np.concatenate([place for _, place in tables])]]
        assert own.min() == n and all(len(bits) == 2 * n for bits, _ in family)


def test_batches_of_candidates_change_nothing(monkeypatch):
    rows, texts = corpus(6)
    items, docs = D.Items([t for _, t in texts]), D._texts_words([t for _, t in rows])
    want = D.matches(*docs, items, items.cells())[:3]
    monkeypatch.setattr(D, "BATCH_PAIRS", 7)
    assert want.shape[1] and D.matches(*docs, items, items.cells())[:3].tolist() == want.tolist()


def test_edge_cases(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, item, 0), (3, item, 0), (None, "x " + item.upper() + "!", 0), (4, "w " * 50000 + item, 0)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(7, item), (8, item), (9, None), (10, " .")], "item_id long, text string")
    got = sorted((r.doc_id or 0, r.item_id, r.edits) for r in D.find_leaks(docs, bench).collect())
    assert got == sorted((d, i, 0) for d in (3, 3, 0, 4) for i in (7, 8))
    assert D.find_leaks(docs, bench.limit(0)).collect() == [] and D.find_leaks(docs.limit(0), bench).collect() == []
    assert sorted(r.doc_id for r in D.drop_leaks(docs, bench).collect()) == [1, 2]
    assert D.drop_leaks(docs, bench).columns == docs.columns


def test_ids_of_other_types_and_other_names(spark):
    docs = spark.createDataFrame([("a", "well yes, of course", 1), ("b", "no", 2)], "doc_id string, text string, item_id int")
    for kind, ids in (("short", (1, None)), ("double", (1.5, 2.5)), ("date", ("2024-01-02", None)), ("boolean", (True, False)), ("decimal(10,2)", ("1.25", "2.5"))):
        bench = spark.createDataFrame([(None if i is None else str(i), w) for i, w in zip(ids, ("yes", "of course"))], "k string, words string").selectExpr(f"cast(k as {kind}) as item", "words")
        got = D.find_leaks(docs, bench, item_col="item", item_text_col="words")
        assert dict(got.dtypes)["item_id"] == dict(bench.dtypes)["item"]
        assert {r.item_id for r in got.collect()} == {r.item for r in bench.collect()} and {r.doc_id for r in got.collect()} == {"a"}
    assert [r.doc_id for r in D.drop_leaks(docs, bench, item_col="item", item_text_col="words").collect()] == ["b"]
