import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from thalweg.llm import runs as R


def plain_runs(w, least, times):
    """Stretches of words equal to the one a period before, with the smallest period of each."""
    out = {}
    for p in range(1, len(w) // times + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, times * p):
                out.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted(((s, e - s, p) for (s, e), p in out.items()), key=lambda r: (r[0], r[2]))


def made_text(rng, letters):
    w = []
    for _ in range(rng.randint(0, 12)):
        if w and rng.random() < 0.5:
            a = rng.randrange(len(w))
            w += w[a : a + rng.randint(1, 6)] * rng.randint(1, 6)
        else:
            w += [rng.randrange(letters)]
    return w


@pytest.mark.parametrize("least, times", [(6, 4), (2, 2), (4, 2), (3, 3)])
def test_batches_against_plain_runs(least, times):
    rng = random.Random(least)
    for _ in range(300):
        texts = [made_text(rng, rng.choice([1, 2, 3, 5])) for _ in range(rng.randint(1, 4))]
        sizes = np.array([len(t) for t in texts])
        begins = np.cumsum(sizes) - sizes
        letters = np.array([10 * i + x for i, t in enumerate(texts) for x in t], np.int64)
        got = R.runs(letters, np.repeat(begins + sizes, sizes), least, times).tolist()
        assert got == [[s + b, s + b + n, p] for b, t in zip(begins.tolist(), texts) for s, n, p in plain_runs(t, least, times)]


def test_previous_factors_and_blocks():
    rng = random.Random(3)
    for _ in range(100):
        w = made_text(rng, 3) or [0]
        longest, source = R.previous_factors(R.ranks(np.array(w, np.int64), np.full(len(w), len(w))))
        for i in range(len(w)):
            fits = lambda j: next((k for k in range(len(w) - i) if w[i + k] != w[j + k]), len(w) - i)  # noqa: E731, B023
            assert longest[i] == max((fits(j) for j in range(i)), default=0)
            assert not longest[i] or source[i] < i and fits(source[i]) >= longest[i]
        starts = R.blocks(longest)
        assert starts[0] == 0 and all(b - a == max(1, longest[a]) for a, b in zip(starts, [*starts[1:], len(w)]))


def test_rows_of_all_kinds(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a " * 7), (4, "a " * 7), (None, "x y x y x y x y z"), (5, "a b " * 6), (6, "b " + "c d e " * 4000), (7, "A a A a A a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'z' as runs", "0 as n_words", "1 as start")
    got = {r.doc_id: (r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in R.find_runs(docs).collect()}
    assert got[1] == got[2] == got[3] == (0, [], "")
    assert got[4] == (7, [(0, 7, 1)], "a")
    assert got[None] == (9, [(0, 8, 2)], "x y z")
    assert got[5] == (6, [(0, 6, 1)], "a b")
    assert got[6] == (12001, [(1, 12000, 3)], "b c d e")
    assert got[7] == (6, [], "A a A a A a")
    assert R.find_runs(docs).count() == 9
    assert R.find_runs(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        R.find_runs(docs, times=1)


def test_digests_against_plain_words(spark):
    rng = random.Random(8)
    rows = [(k, " ".join(f"w{x}" for x in made_text(rng, 4) * rng.randint(1, 3))) for k in range(400)] + [(900, None), (901, "lone"), (902, " tail  of\tblanks \n")]
    got = {r.doc_id: r for r in R.run_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    planted = 0
    for doc_id, text in rows:
        w, h = (text or "").split(), zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and w:
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
            planted += 1
        found = plain_runs(w, 6, 4)
        gone = {i for s, n, p in found for i in range(s + p, s + n)}
        r = got[doc_id]
        assert r.n_runs == len(found)
        best = min(found, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None, None, None))
        assert (r.start, r.length, r.period) == best
        assert r.exponent_milli == (best[1] * 1000 // best[2] if found else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()
    assert planted > 20
