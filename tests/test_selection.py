import math
import random

import pytest
from pyspark.sql import functions as F

from thalweg.operators import selection as M


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, v double").repartition(3)


def made(rng):
    out = []
    for k in ("a", "b", None, "null", "c"):
        kind = rng.choice(["wide", "ties", "close"])
        for _ in range(rng.randrange(1, 60)):
            v = {"wide": lambda: rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300), "ties": lambda: float(rng.randrange(3)), "close": lambda: 1e9 + rng.random() * 1e-6}[kind]()
            out.append((k, v))
    return out


def middle(values):
    s = sorted(values, key=lambda v: (math.isnan(v), v))
    a, b = s[(len(s) - 1) // 2], s[len(s) // 2]
    return a if a == b else a / 2 + b / 2


def test_medians_of_groups(spark):
    rng = random.Random(3)
    for few in (M.FEW, 0):
        M.FEW, kept = few, M.FEW
        rows = made(rng)
        got = {r.k: (r.median, r.n) for r in M.median(frame(spark, rows), "v", ("k",)).collect()}
        M.FEW = kept
        want = {k: [v for g, v in rows if g == k] for k, _ in rows}
        assert got == {k: (middle(v), len(v)) for k, v in want.items()}


def test_odd_values(spark):
    nan, inf = float("nan"), float("inf")
    cases = [[nan], [1.0, nan], [-inf, -inf, 5.0], [inf, inf, nan], [None, 4.0], [-1.7e308, 1.7e308], [-inf, inf], [0.0, 5e-324, 1e-323], [2.0, 2.0, 2.0]]
    rows = [(str(i), v) for i, c in enumerate(cases) for v in c] + [("none", None)]
    got = {r.k: r.median for r in M.median(frame(spark, rows), "v", ("k",)).collect()}
    for i, c in enumerate(cases):
        want = middle([v for v in c if v is not None])
        assert got.pop(str(i)) == pytest.approx(want, nan_ok=True, abs=0)
    assert not got
    assert M.median(frame(spark, []), "v").collect() == M.median(frame(spark, [("x", None)]), "v").collect() == []


def test_every_rank(spark):
    rows = [("a", float(v)) for v in (5, 1, 1, 9, 7, 7, 7, 2)]
    for k, want in enumerate(sorted(v for _, v in rows)):
        assert [r.value for r in M.order_statistic(frame(spark, rows), "v", F.lit(k)).collect()] == [want]
    assert M.order_statistic(frame(spark, rows), "v", F.col("n")).collect() == []


def test_against_the_built_in(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    want = {r.l_returnflag: r.m for r in li.groupBy("l_returnflag").agg(F.median("l_extendedprice").alias("m")).collect()}
    assert {r.l_returnflag: r.median for r in M.median(li, "l_extendedprice", ("l_returnflag",)).collect()} == want
