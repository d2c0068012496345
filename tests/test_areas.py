import random

import numpy as np
import pytest

from thalweg.functions import kernels as K
from thalweg.operators import areas as A
from thalweg.operators import spatial as S

RINGS = "area_id long, rings array<array<struct<x:double,y:double>>>"


def odd(x, y, rings):
    """Inside, or on an edge, by all edges."""
    inside = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            if (bx - ax) * (y - ay) == (by - ay) * (x - ax) and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
                return True
            if (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay):
                inside = not inside
    return inside


def star(rng, x, y, r, n):
    turns = sorted(rng.uniform(0, 6.28) for _ in range(n))
    return [(x + rng.uniform(0.3, 1) * r * float(np.cos(t)), y + rng.uniform(0.3, 1) * r * float(np.sin(t))) for t in turns]


def found(spark, points, areas):
    p = spark.createDataFrame(points, "point_id long, x double, y double")
    a = spark.createDataFrame([(i, rings) for i, rings in areas], RINGS)
    rows = [tuple(r) for r in A.points_in_areas(p, a).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_areas_of_all_sizes(spark):
    """Stars of very different sizes, with holes, parts in holes and parts apart, some far over others."""
    rng = random.Random(6)
    areas = []
    for k in range(14):
        x, y, r = rng.uniform(-50, 50), rng.uniform(-50, 50), rng.choice([0.5, 3, 20, 90])
        areas.append((k, [star(rng, x, y, r, rng.choice([3, 5, 40])), star(rng, x, y, r / 4, 7), star(rng, x + 2 * r, y, r / 3, 5)]))
    areas.append((50, [star(rng, 0, 0, 60, 900)]))
    points = [(i, rng.uniform(-100, 100), rng.uniform(-100, 100)) for i in range(1500)] + [(2000 + i, rng.gauss(0, 5), rng.gauss(0, 5)) for i in range(500)]
    assert found(spark, points, areas) == {(p, k) for p, x, y in points for k, rings in areas if odd(x, y, rings)}


def test_places_on_lines_of_cells(spark):
    """Corners, edges along the lines between cells, and places on both."""
    square = [(0.0, 0.0), (8.0, 0.0), (8.0, 8.0), (0.0, 8.0), (0.0, 0.0)]
    hole = [(2.0, 2.0), (2.0, 6.0), (6.0, 6.0), (6.0, 2.0)]
    steps = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (8.0, 4.0), (8.0, 8.0), (-4.0, 8.0), (-4.0, 4.0), (0.0, 4.0)]
    slant = [(0.0, 0.0), (8.0, 8.0), (0.0, 16.0), (-8.0, 8.0)]
    areas = [(1, [square, hole]), (2, [steps]), (3, [slant]), (4, [[(1.0, 1.0), (1.0, 1.0)]]), (5, []), (6, [hole[::-1], [(0.0, 0.0)]])]
    points = [(100 * i + j, i / 2 - 10.0, j / 2 - 2.0) for i in range(42) for j in range(40)]
    assert found(spark, points, areas) == {(p, k) for p, x, y in points for k, rings in areas if odd(x, y, [r for r in rings if len(r) > 2])}


def test_odd_rows(spark):
    nan = float("nan")
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    points = [(1, 0.5, 0.5), (1, 0.5, 0.5), (2, nan, 0.5), (3, None, 0.5), (None, 0.5, 0.5), (4, float("inf"), 0.5), (5, 7.0, 7.0)]
    assert found(spark, points, [(9, [square]), (None, [square]), (8, None), (7, [[(nan, 0.0), (1.0, nan)]])]) == {(1, 9)}
    assert found(spark, points, []) == found(spark, [], [(9, [square])]) == set()


def test_pairs_are_not_shuffled(spark, monkeypatch):
    """Points of one cell in several slices, edges of one area in several batches and blocks; no shuffle but that of points and cells."""
    rng = random.Random(3)
    areas = [(k, [star(rng, 0, 0, 10, rng.choice([40, 300])), star(rng, 1, 1, 3, 9)]) for k in range(9)]
    points = [(i, rng.gauss(0, 4), rng.gauss(0, 4)) for i in range(900)]
    monkeypatch.setattr(A, "SLICE", 8, raising=False)
    monkeypatch.setattr(A, "BLOCK", 20, raising=False)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        assert found(spark, points, areas) == {(p, k) for p, x, y in points for k, rings in areas if odd(x, y, rings)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    pairs = A.points_in_areas(spark.createDataFrame(points, "point_id long, x double, y double"), spark.createDataFrame(areas, RINGS))
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert not any(word in plan.split("MapInArrow")[0] for word in ("Join", "Aggregate", "Repartition"))


def test_a_million_times_larger_and_far_away(spark):
    rng = random.Random(1)
    ring = star(rng, 4.5e6, -2.25e6, 3e5, 60)
    points = [(i, 4.5e6 + rng.uniform(-4e5, 4e5), -2.25e6 + rng.uniform(-4e5, 4e5)) for i in range(800)]
    assert found(spark, points, [(1, [ring])]) == {(p, 1) for p, x, y in points if odd(x, y, [ring])}


@pytest.mark.parametrize("within", [0.0, 4.0])
def test_lines_near_areas(spark, within):
    rng = random.Random(9)
    areas = [(k, [star(rng, rng.uniform(0, 100), rng.uniform(0, 100), rng.uniform(3, 30), 9)]) for k in range(8)]
    areas.append((20, [[(0.0, 0.0), (100.0, 0.0), (100.0, 100.0), (0.0, 100.0)], [(20.0, 20.0), (80.0, 20.0), (80.0, 80.0), (20.0, 80.0)]]))
    lines = [(i, [(rng.uniform(-20, 120), rng.uniform(-20, 120))]) for i in range(120)]
    lines = [(i, [*v, *[(v[0][0] + rng.uniform(-6, 6), v[0][1] + rng.uniform(-6, 6)) for _ in range(2)]]) for i, v in lines]
    df = spark.createDataFrame(lines, "line_id long, geom array<struct<x:double,y:double>>")
    got = {tuple(r) for r in A.lines_in_areas(S.segments(df, "line_id"), spark.createDataFrame(areas, RINGS), within).collect()}
    want = set()
    for i, v in lines:
        for k, rings in areas:
            gaps = [K.segment_gap(*[np.array([c]) for c in (*p, *q, *a, *b)])[0][0] for p, q in zip(v, v[1:]) for r in rings for a, b in zip(r, r[1:] + r[:1])]
            if odd(*v[0], rings) or min(gaps) <= within**2:
                want.add((i, k))
    assert got == want


def test_equal_areas_are_compared_once(spark):
    """Many areas with the same rings are one for the comparison; areas of several rows, without a key or without rings are not mixed up with them."""
    rng = random.Random(5)
    shapes = [[star(rng, rng.uniform(0, 60), rng.uniform(0, 60), 12, 9)] for _ in range(4)]
    areas = [(k, shapes[k % 4]) for k in range(40)] + [(100, shapes[0]), (100, shapes[1]), (101, shapes[0]), (101, shapes[1]), (102, None), (103, None), (None, shapes[2])]
    df = spark.createDataFrame(areas, RINGS)
    own, members = A.shapes(df)
    assert own.where("rings is not null").count() == 4 + 4 and members.count() == 44
    lines = [(i, [(x := rng.uniform(0, 60), y := rng.uniform(0, 60)), (x + 3, y + 1), (x + 3, y + 4)]) for i in range(60)]
    segs = S.segments(spark.createDataFrame(lines, "line_id long, geom array<struct<x:double,y:double>>"), "line_id")
    rows = [tuple(r) for r in A.lines_in_areas(segs, df, 2.0).collect()]
    want = set()
    for i, v in lines:
        near = lambda ring: min(K.segment_gap(*[np.array([c]) for c in (*p, *q, *a, *b)])[0][0] for p, q in zip(v, v[1:]) for a, b in zip(ring, ring[1:] + ring[:1])) <= 4.0  # noqa: B023, E731
        inside = lambda rings: sum(odd(*v[0], [r]) for r in rings) % 2 == 1  # noqa: B023, E731
        of = {k: [r for key, rings in areas if key == k and rings for r in rings] for k, _ in areas if k is not None}
        want |= {(i, k) for k, rings in of.items() if rings and (inside(rings) or any(map(near, rings)))}
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_nearness_of_segments():
    """The same pairs as by their distance."""
    rng = np.random.default_rng(4)
    ends = [np.where(rng.random(4000) < 0.5, rng.integers(0, 6, 4000), rng.uniform(0, 6, 4000)).astype(float) for _ in range(8)]
    for reach in (0.0, 0.5, 1.0):
        assert (K.within(*ends, reach) == (K.segment_gap(*ends)[0] <= reach * reach)).all()
