from collections import namedtuple

import numpy as np
import pyarrow as pa
import pytest

from thalweg.llm import dense as D

Cell = namedtuple("Cell", "n low high")


def made(rng, n, width=6, spread=3):
    """Small whole numbers, so that many scores tie."""
    return [(int(i), rng.integers(-spread, spread + 1, width).astype(float).tolist(), int(rng.integers(0, 3))) for i in range(n)]


def dot(a, b):
    return sum(int(x) * int(y) for x, y in zip(a, b))


def plain_negatives(rows, anchors, positives=5, negatives=10):
    out = []
    for a, va, la in anchors:
        ranked = sorted(((-dot(va, v), i, lab) for i, v, lab in rows if i != a))
        for k, (ps, p, _) in enumerate([r for r in ranked if r[2] == la][:positives]):
            inside = [(i, -s) for s, i, lab in ranked if lab != la and 30 * -ps <= 100 * -s <= 90 * -ps][:negatives]
            out += [(a, p, r + 1, i, -ps, s) for r, (i, s) in enumerate(inside)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, vec array<double>, label int").repartition(3)


@pytest.mark.parametrize("limit", [D.ANCHOR_BYTES, 400])
def test_negatives_against_all_pairs(spark, limit):
    rows = made(np.random.default_rng(4), 240)
    df = frame(spark, rows).withColumnRenamed("x", "y")
    got = D.hard_negatives(df.selectExpr("*", "0 as score", "1 as k"), df.where("vec_id % 10 = 0"), limit=limit)
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows, [r for r in rows if r[0] % 10 == 0])


def test_negatives_of_odd_rows(spark):
    rows = [(0, [1.0, 2.0], 1), (0, [1.0, 1.0], 2), (1, [3.0, 3.0], 1), (1, [3.0, 3.0], 1), (2, [2.0, 1.0], 0), (3, [1.0], 0), (4, [], 0), (5, None, 0), (6, [9.0, 9.0], None), (None, [1.0, 1.0], 1)]
    df = frame(spark, rows)
    usable = [(0, [1.0, 2.0], 1), (1, [3.0, 3.0], 1), (1, [3.0, 3.0], 1), (2, [2.0, 1.0], 0), (3, [1.0], 0), (4, [], 0)]
    got = sorted(map(tuple, D.hard_negatives(df, df.where("vec_id = 0")).collect()))
    assert got == plain_negatives(usable, [usable[0]])  # the other row of id 0 takes no part for it
    assert D.hard_negatives(df, df.where("vec_id = 99")).collect() == []
    assert D.hard_negatives(df.limit(0), df.limit(0)).collect() == []


def plain_top(rows, queries, k):
    out = []
    for q, vq in queries:
        ranked = sorted((-dot(vq, v), i) for i, v in rows if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(ranked)]
    return sorted(out)


@pytest.mark.parametrize("group, slice_bytes, pivots", [(512, 4 << 20, 64), (7, 1, 5), (1000, 1, 1)])
def test_search_against_all_pairs(spark, group, slice_bytes, pivots):
    rows = [r[:2] for r in made(np.random.default_rng(9), 1500)]
    df = spark.createDataFrame(rows, "vec_id long, vec array<double>")
    got = D.voronoi_join(df, df.where("vec_id % 20 = 0"), 4, pivots, group, slice_bytes)
    assert sorted(map(tuple, got.collect())) == plain_top(rows, [r for r in rows if r[0] % 20 == 0], 4)


def test_search_in_clusters(spark):
    """Groups of near vectors with a third of all rows in one of them, and queries of very different lengths."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16)) * 1000
    rows = [(i, np.floor(centres[0 if i % 3 == 0 else i % 12] + rng.normal(size=16) * 5).tolist()) for i in range(3000)]
    rows += [(3000 + i, np.floor(rng.normal(size=16) * 10 ** (i % 4)).tolist()) for i in range(40)] + [(4000, [0.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, vec array<double>")
    near = rows[:3000:25]
    for queries in (near, rows[3000:]):
        got = D.voronoi_join(df, spark.createDataFrame(queries, "vec_id long, vec array<double>"), 5, 24, 20)
        assert sorted(map(tuple, got.collect())) == plain_top(rows, queries, 5)


def test_bounds_leave_rows_out():
    """Vectors in narrow groups: most groups are of no use to a query's group."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 8)) * 100
    rows = np.repeat(centres, 30, axis=0) + rng.normal(size=(600, 8))
    sphere = D.Sphere(centres, float((rows**2).sum(axis=1).max()))
    cell, gap = sphere.nearest(sphere.raised(rows))
    have = {c: Cell(int((cell == c).sum()), gap[cell == c].min(), gap[cell == c].max()) for c in set(cell.tolist())}
    closest = [(c, g) for c in have for g in np.sort(gap[cell == c])[:6]]
    homes, windows = D._useful(sphere.apart, have, have, closest, 5, 30, 1000, 1e-6)
    assert {h[1] for h in homes} == set(have)
    taken = sum(have[c].n for _, c, *_ in windows)
    assert len(rows) <= taken < 0.3 * len(rows) * len({h[0] for h in homes})
    # of a query in each cell, the five nearest rows are among those taken for its group
    group_of = {c: g for g, c, *_ in homes}
    for q in range(0, 600, 7):
        apart = ((sphere.raised(rows) - sphere.raised(rows[q : q + 1])) ** 2).sum(axis=1)
        apart[q] = np.inf
        for n in np.argsort(apart)[:5]:
            assert any(g == group_of[cell[q]] and c == cell[n] and lo <= gap[n] <= hi for g, c, lo, hi, *_ in windows)
    assert D._groups({0: 5, 1: 3, 2: 9}, np.array([[0, 1, 2], [1, 0, 3], [2, 3, 0]]), 8) == [[2], [0, 1]]


def test_search_of_odd_rows(spark):
    rows = [(1, [1.0, 2.0]), (1, [2.0, 2.0]), (2, [3.0]), (3, []), (3, []), (4, None), (None, [5.0, 5.0]), (5, [3.0, 0.0, 7.0])]
    df = spark.createDataFrame(rows, "vec_id long, vec array<double>").selectExpr("*", "0 as rank", "'x' as cell")
    pad = [(i, [*v, 0.0, 0.0, 0.0][:3]) for i, v in rows if i and v is not None]
    got = D.voronoi_join(df, df.where("vec_id in (1, 3, 5)"), 3)
    assert sorted(map(tuple, got.collect())) == plain_top(pad, [(1, [2.0, 2.0, 0.0]), (3, [0.0] * 3), (5, [3.0, 0.0, 7.0])], 3)
    assert D.voronoi_join(df, df.where("vec_id = 99")).collect() == []
    assert D.voronoi_join(df.limit(0), df.limit(0)).collect() == []
    lone = df.where("vec_id = 2")
    assert D.voronoi_join(lone, lone).collect() == []


def test_whole_vectors(spark):
    rows = [(1, [0.5, -0.001]), (2, [None, 1.0]), (3, [float("nan")]), (4, [float("inf"), 0.0]), (5, None), (6, []), (7, [-float("inf")])]
    df = D.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 256.0)
    assert {r.vec_id: r.vec for r in df.collect()} == {1: [128.0, -1.0], 6: []}


def test_products_beyond_doubles():
    a, b = np.array([[2.0**40, 1.0]]), np.array([[2.0**20, 1.0], [2.0**60, 0.0]])
    assert D.products(a, b).tolist() == [[2**60 + 1, 2**63 - 1]]
    assert D.matrix(pa.array([[1.0], [], [1.0, 2.0, 3.0]]), 2).tolist() == [[1, 0], [0, 0], [1, 2]]
