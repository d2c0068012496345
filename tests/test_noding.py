"""Lines cut square by square against lines cut pair by pair."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from thalweg.operators import noding, quadtree
from thalweg.operators import spatial as S

LINES = "line_id long, geom array<struct<x:double,y:double>>"


def plain_places(segs):
    """Of every segment the places (0 to 1) where others meet it, and where it ends."""
    out = {k: {0.0, 1.0} for k in segs}
    for a, b in itertools.permutations(segs, 2):
        (x1, y1, x2, y2), (u1, v1, u2, v2) = segs[a], segs[b]
        dx, dy, ex, ey = x2 - x1, y2 - y1, u2 - u1, v2 - v1
        d, own, other = dx * ey - dy * ex, dx * dx + dy * dy, ex * ex + ey * ey
        if abs(d) > 1e-12 * own:
            t, u = ((u1 - x1) * ey - (v1 - y1) * ex) / d, ((u1 - x1) * dy - (v1 - y1) * dx) / d
            found = [t] if -1e-9 <= u <= 1 + 1e-9 else []
        else:
            off = abs((u1 - x1) * dy - (v1 - y1) * dx) / own**0.5
            found = [((u - x1) * dx + (v - y1) * dy) / own for u, v in ((u1, v1), (u2, v2))] if off < 1e-9 else []
        out[a] |= {0.0 if t <= 1e-9 else 1.0 if t >= 1 - 1e-9 else round(t, 12) for t in found if -1e-9 <= t <= 1 + 1e-9}
    return {k: sorted(v) for k, v in out.items()}


def plain_pieces(segs):
    first, places = {}, plain_places(segs)
    for k in sorted(segs):
        x1, y1, x2, y2 = segs[k]
        t = places[k]
        spot = [(x1, y1) if v == 0 else (x2, y2) if v == 1 else (x1 + v * (x2 - x1), y1 + v * (y2 - y1)) for v in t]
        spot = [tuple(round(c, 6) + 0.0 for c in p) for p in spot]
        for n, (p, q) in enumerate(zip(spot, spot[1:])):
            first.setdefault(min((p, q), (q, p)), (*k, n, *p, *q))
    return sorted(first.values())


def test_rounds_as_spark_does(spark):
    rng = np.random.default_rng(1)
    v = np.r_[rng.uniform(-1000, 1000, 3000), np.round(rng.uniform(-9, 9, 2000), 6) + 5e-7, [0.0000005, -0.0000005, 2.5, 1e15 + 0.3, 123456789012.3456785, np.inf, -0.0]]
    df = spark.createDataFrame([(float(x),) for x in v], "v double").select("v", F.round("v", 6).alias("r"))
    rows = df.collect()
    got = noding.rounded(np.array([r.v for r in rows]), 6)
    assert got.tolist() == [r.r for r in rows]
    assert np.isnan(noding.rounded(np.array([np.nan, 1.0]), 6)).tolist() == [True, False]


@pytest.mark.parametrize("capacity", [16, 4096])
def test_segments_on_a_grid_and_off(spark, monkeypatch, capacity):
    """Ends on one another, overlaps and copies, cut in one square or in many, whose slices hold a few segments each."""
    grow = quadtree.grow
    monkeypatch.setattr(quadtree, "grow", lambda a, b, reach: grow(a, b, reach, capacity=capacity))
    monkeypatch.setattr(noding, "HELD", 50)
    monkeypatch.setattr(noding, "AT_ONCE", 40)
    r = random.Random(capacity)
    on = lambda: float(r.randrange(9))
    segs = {}
    for k in range(150):
        g = [on(), on(), on(), on()] if k % 3 else [r.uniform(0, 8) for _ in range(4)]
        g = list(segs[(k - 5, 0)]) if k % 20 == 5 else g
        if g[:2] != g[2:]:
            segs[(k, 0)] = tuple(g)
    df = spark.createDataFrame([(*k, *g) for k, g in segs.items()], "line_id long, seg int, x1 double, y1 double, x2 double, y2 double")
    got = sorted(tuple(x) for x in S.node_segments(df, "line_id").select("line_id", "seg", "piece", "x1", "y1", "x2", "y2").collect())
    want = plain_pieces(segs)
    assert len(got) == len(want) > 1500
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3:] for g in got], [w[3:] for w in want], atol=2e-6)


def test_pieces_are_not_shuffled(spark, monkeypatch):
    """Of crossing lines only what is near the ends of lines or borders of squares meets other pieces by a shuffle."""
    rng = np.random.default_rng(3)
    p = rng.uniform(0, 100, (400, 2, 2))
    lines = spark.createDataFrame([(k, [tuple(map(float, v)) for v in g]) for k, g in enumerate(p)], LINES)
    made, real = [], noding.pieces
    monkeypatch.setattr(noding, "pieces", lambda *a, **b: made.append(real(*a, **b)) or made[-1])
    whole = S.node_lines(lines, "line_id").count()
    single, shared = (df.count() for df in made[0])
    assert whole == single + shared > 10_000 and shared < whole / 10


def test_odd_lines(spark):
    """Lines without a key, with a null vertex or no number in it, and a line over many batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        comb = [(float(k), float(k % 2)) for k in range(200)]
        rows = [(1, comb), (2, [(-1.0, 0.5), (300.0, 0.5)]), (None, [(0.0, 0.0), (0.0, 0.0), (9.0, 9.0)]), (4, [(500.0, None), (501.0, 1.0)]), (5, [(600.0, float("nan")), (601.0, 1.0), (601.0, 1.0)]), (6, [(7.0, 7.0)]), (7, None)]
        got = S.node_lines(spark.createDataFrame(rows, LINES), "line_id").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    of = lambda k: sorted((r.piece, [tuple(p) for p in r.geom]) for r in got if r.line_id == k)
    assert [p for p, _ in of(1)] == list(range(200)) == [p for p, _ in of(2)]
    assert of(1)[0] == (0, [(0.0, 0.0), (0.5, 0.5)]) and of(1)[1] == (1, [(0.5, 0.5), (1.0, 1.0), (1.5, 0.5)])
    assert of(None) == [(0, [(0.0, 0.0), (9.0, 9.0)])] and of(4) == [(0, [(500.0, None), (501.0, 1.0)])]
    assert len(of(5)) == 1 and np.isnan(of(5)[0][1][0][1]) and of(5)[0][1][1] == (601.0, 1.0) and not of(6) and not of(7)
