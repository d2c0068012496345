"""Structures to the nearest place on a line, and lines cut there."""

import math
import random

import numpy as np

from thalweg.functions import kernels as K
from thalweg.operators import spatial as S

LINE = "line_id long, geom array<struct<x:double,y:double>>"


def made_lines(rng, n):
    out = []
    for i in range(n):
        v = [(rng.uniform(0, 1000), rng.uniform(0, 1000))]
        for _ in range(rng.randrange(1, 5)):
            v.append((v[-1][0] + rng.uniform(-30, 30), v[-1][1] + rng.uniform(-30, 30)))
        out.append((i, v))
    return out


def test_nearest_place_however_far(spark):
    rng = random.Random(4)
    lines = [*made_lines(rng, 60), (90, [(0.0, 0.0), (0.0, 10.0)]), (91, [(0.0, 10.0), (0.0, 20.0)])]
    points = [(i, rng.uniform(0, 1000), rng.uniform(0, 1000)) for i in range(150)] + [(500, 90_000.0, -70_000.0), (501, -4.0, 10.0), (501, -4.0, 10.0), (502, float("nan"), 0.0), (503, None, 1.0)]
    segs = S.segments(spark.createDataFrame(lines, LINE), "line_id")
    df = spark.createDataFrame(points, "structure_id long, x double, y double")
    got = {r.structure_id: r for r in S.nearest_places(df, segs, "structure_id").collect()}
    assert set(got) == {p[0] for p in points if p[0] < 502}
    for i, x, y in points[:-2]:
        gaps = {}
        for k, v in lines:
            for s, (a, b) in enumerate(zip(v, v[1:])):
                gaps[k, s] = math.sqrt(K._foot(*[np.array([c]) for c in (x, y, *a, *b)])[1][0])
        r = got[i]
        assert abs(r.distance - min(gaps.values())) < 1e-9 and abs(gaps[r.line_id, r.seg] - r.distance) < 1e-9
        assert abs(math.hypot(r.x - x, r.y - y) - r.distance) < 1e-9
    assert got[501].line_id == 90
    assert S.nearest_places(df, segs.limit(0), "structure_id").collect() == S.nearest_places(df.limit(0), segs, "structure_id").collect() == []


def plain_split(v, places):
    """Pieces of one line, by walking along it."""
    cuts = sorted({(s + 1, 0.0) if t >= 1 else (s, t) for s, t in places})
    cuts = [c for c in cuts if (0, 0.0) < c < (len(v) - 1, 0.0)]
    out, piece = [], [v[0]]
    for s in range(len(v) - 1):
        for c, t in cuts:
            if c == s and not (t == 0 and s == 0):
                p = (v[s][0] + t * (v[s + 1][0] - v[s][0]), v[s][1] + t * (v[s + 1][1] - v[s][1]))
                out.append(piece if piece[-1] == p else [*piece, p])
                piece = [p]
        piece.append(v[s + 1])
    return [*out, piece]


def test_many_cuts_on_one_line(spark):
    rng = random.Random(7)
    lines = made_lines(rng, 20)
    places = [(rng.choice([3, 3, 3, rng.randrange(20)]), 0, rng.choice([0.0, 1.0, 0.25, rng.random()])) for _ in range(400)]
    places += [(k, len(v) - 2, t) for k, v in lines for t in (1.0, 0.5)] + [(77, 0, 0.5), (3, 50, 0.5), (3, 0, 0.25)]
    df = spark.createDataFrame([*lines, (40, [(1.0, 1.0), (1.0, 1.0)]), (41, []), (42, [(0.0, 0.0), (0.0, 0.0), (5.0, 5.0)])], LINE)
    got = {}
    for r in S.split_lines(df, spark.createDataFrame(places, "line_id long, seg int, t double")).collect():
        got[r.line_id, r.piece] = [tuple(p) for p in r.geom]
    want = {(42, 0): [(0.0, 0.0), (5.0, 5.0)]}
    for k, v in lines:
        for n, piece in enumerate(plain_split(v, [(s, t) for i, s, t in places if i == k and s < len(v) - 1])):
            want[k, n] = piece
    assert got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k]) for k in want)
