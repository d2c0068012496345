import random
import re

import numpy as np
import pyarrow as pa
import pytest

from thalweg.llm import jaccard as J
from thalweg.llm import textkernel as tk


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows, percent=80):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    index = {}
    for i, s in enumerate(sets):
        near = {j for x in s for j in index.get(x, ())}
        for j in near:
            inter = len(s & sets[j])
            if 100 * inter >= percent * (len(s) + len(sets[j]) - inter):
                parent[root(i)] = root(j)
        for x in s:
            index.setdefault(x, []).append(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            r = root(i)
            least[r] = min(least.get(r, d), d)
    return sorted((d if d is not None else -1, len(s), least.get(root(i), -1)) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def run(spark, rows, **k):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = J.jaccard_components(df, **k).collect()
    f = lambda x: -1 if x is None else x
    return sorted((f(r.doc_id), r.n_shingles, f(r.component_id)) for r in out)


def varied(seed, n=160):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for size in [3, 5, 6, 8, 9, 12, 14, 17, 19, 20, 25, 33, 60, 120, 300, 1200] * (n // 40):
        base = [rng.choice(vocabulary) for _ in range(size)]
        for _ in range(3):
            copy = list(base)
            for _ in range(rng.randrange(0, max(1, size // 20) + 2)):
                k = rng.randrange(len(copy))
                rng.choice([lambda: copy.__setitem__(k, rng.choice(vocabulary)), lambda: copy.insert(k, "x"), lambda: copy.pop() if len(copy) > 2 else None, lambda: copy.append("y z q")])()
            rows.append((len(rows) + 10, " ".join(copy).upper() if rng.random() < 0.2 else " ".join(copy)))
    rng.shuffle(rows)
    return rows


def test_against_brute_force(spark):
    rows = varied(1)
    assert run(spark, rows) == brute(rows)


def test_real_rows_against_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert run(spark, rows) == brute(rows)


def test_edge_cases(spark):
    long = " ".join(f"a{i}" for i in range(30000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, long), (8, long + " end"), (8, long), (None, "one two"), (None, None), (9, "é é É é é"), (10, "É é É é é")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "x", 5), (2, "a b c d e f", "y", 6)], "doc_id long, text string, set_id string, a int")
    assert sorted(tuple(r) for r in J.jaccard_components(df).collect()) == [(1, 2, 1), (2, 2, 1)]
    assert J.keep_one(df).collect() == [(1, "a b c d e f", "x", 5)]


def test_large_groups_are_dealt_out(spark, monkeypatch):
    """Frequent signatures, hubs in many pairs and blocks of open pairs change no result."""
    monkeypatch.setattr(J, "_FREQUENT", 2)
    monkeypatch.setattr(J, "_LARGE_HUB", 3)
    monkeypatch.setattr(J, "_BLOCK", 2)
    rows = varied(4)
    rng = random.Random(2)
    base = [f"b{i}" for i in range(60)]
    for k in range(60):  # a family of texts that share most of their words, some of them near copies of each other
        text = list(base)
        for i in rng.sample(range(60), 3):
            text[i] = f"n{k % 20}-{i}"
        rows.append((1000 + k, " ".join(text)))
    assert run(spark, rows) == brute(rows)


def test_keep_one(spark):
    rows = [(3, "a b c d e f g"), (1, "a b c d e f g"), (1, "a b c d e f g"), (2, None), (2, None), (None, "q r"), (None, "q r"), (4, "other words here"), (None, "other words here"), (5, "v w x"), (5, "a b c d e f g"), (6, ""), (1, "p q")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted(((r.doc_id or 0), r.text or "") for r in J.keep_one(df).collect())
    assert out == [(0, "q r"), (1, "a b c d e f g"), (1, "p q"), (2, ""), (2, ""), (4, "other words here"), (5, "v w x"), (6, "")]
    assert J.keep_one(df.limit(0)).collect() == []


def test_keep_one_with_clashing_names(spark):
    odd = "row string, key int, _kept_id int, _text_key int, _filled int, component long, at int, any int, set_id long, n int, `a.b` int"
    more = ("r", 1, 2, 3, 4, 5, 6, 7, 8, 9, 10)
    for rows in ([(2, "a b c", *more), (1, "A b c", *more)], [(2, "a b c", *more), (1, "A b c", *more), (1, "A b c", *more), (None, None, *more)]):
        df = spark.createDataFrame(rows, f"doc_id long, text string, {odd}")
        got = J.keep_one(df)
        assert got.columns == df.columns
        assert sorted(map(tuple, got.collect()), key=str) == sorted({r for r in rows if r[0] != 2}, key=str)


@pytest.mark.parametrize("seed", range(6))
def test_signatures_are_complete(seed):
    """Every similar pair of sets shares a signature."""
    rng = np.random.default_rng(seed)
    for _ in range(60):
        n = int(rng.choice([4, 5, 7, 9, 10, 12, 14, 15, 16, 18, 19, 24, 30, 31, 50, 100, 400]))
        s = rng.integers(0, 1 << 63, n + 200, dtype=np.uint64)
        lost = int(rng.integers(0, n // 5 + 1))
        new = int(rng.integers(0, n // 4 + 1))
        a, b = np.unique(s[:n]), np.unique(np.r_[s[: n - lost], s[n : n + new]])
        inter = len(np.intersect1d(a, b))
        if inter * 180 < (len(a) + len(b)) * 80 or len(b) < 4:
            continue
        bounds = np.array([0, len(a), len(a) + len(b)])
        who, sig = J.signatures(np.r_[a, b], bounds, 80)
        assert set(sig[who == 0].tolist()) & set(sig[who == 1].tolist()) or np.array_equal(a, b), (len(a), len(b), inter)


def test_sketches_bound_differences():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 400, int(rng.integers(1, 300)), dtype=np.uint64)) for _ in range(40)]
    bounds = np.r_[0, np.cumsum([len(s) for s in sets])]
    marks = J.sketches(np.concatenate(sets), bounds)
    for i in range(40):
        for j in range(40):
            apart = int(np.bitwise_count((marks[i] ^ marks[j]).view(np.uint64)).sum())
            assert apart <= len(np.setxor1d(sets[i], sets[j])) and (i != j or apart == 0)


def test_wide_sketches_bound_differences():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 6000, int(rng.integers(400, 5000)), dtype=np.uint64)) for _ in range(20)]
    marks = J.wide_sketches(np.concatenate(sets), np.r_[0, np.cumsum([len(s) for s in sets])])
    for i in range(20):
        assert (marks[i] is None) == (len(sets[i]) <= J.SKETCH)
        for j in range(20):
            if marks[i] is not None and marks[j] is not None:
                assert J._apart(marks[i], marks[j]) <= len(np.setxor1d(sets[i], sets[j])) and (i != j or J._apart(marks[i], marks[j]) == 0)
    a = sets[0]
    other = np.unique(rng.integers(10_000, 90_000, len(a), dtype=np.uint64))
    p, q = J.wide_sketches(np.r_[a, other], np.array([0, len(a), len(a) + len(other)]))
    assert J._apart(p, q) * 180 > (len(a) + len(other)) * 20  # sets with nothing in common are told apart


def test_words_match_plain_split():
    texts = ["", "a", " a  b\tc\n", "é x y", "  ", None, "x" * 100 + " y", "A a"]
    data, offsets = tk.utf8(pa.array(texts))
    hashes, before, s, e = tk.words(data, offsets, spans=True)
    raw = bytes(data)
    got = [[raw[a:b].decode() for a, b in zip(s[before[i] : before[i + 1]], e[before[i] : before[i + 1]])] for i in range(len(texts))]
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    assert hashes[before[7]] == hashes[before[7] + 1]
