"""Connected components of an edge table by alternating large-star and small-star steps.

Each round is two grouped minima and a join; no adjacency list is ever collected, and the rows of a node with very many
neighbours are dealt to many tasks.  Rounds are cut by tables in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thalweg.operators.skew import salted_join
from thalweg.storage import forget, materialize_told

def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count_if(F.col("b") > F.col("a")).alias("n")).where("n > 0")
    return salted_join(both.where("b > a"), least, "a", total, "b").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    moved = salted_join(down, least.where("n > 1"), "a", total, "b").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a table, and what tells it from another: rows and a sum of hashes."""
    out, told = materialize_told(edges, "components", rows=F.count(F.lit(1)), total=F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    return out, (told.get("rows", 0), told.get("total"))


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` to ``(node, component)``, component being the smallest node reachable.  Self-loops name their node;
    null ends are dropped; an empty table gives no rows."""
    edges = edges.where("a is not null and b is not null")
    loops = edges.where("a = b").select(F.col("a").alias("node")).distinct()
    stars, stamp = _written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(most_rounds):
        if not stamp[0]:
            break
        following, told = _written(_small_star(_large_star(stars, 2 * stamp[0]), stamp[0]))
        forget(stars)
        stars, stamp, before = following, told, stamp
        if stamp == before:
            break
    else:
        raise RuntimeError(f"components not stable after {most_rounds} rounds")
    inner = stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = stars.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    alone = loops.join(inner.select("node").unionByName(roots.select("node")), "node", "left_anti").withColumn("component", F.col("node"))
    return inner.unionByName(roots).unionByName(alone)
