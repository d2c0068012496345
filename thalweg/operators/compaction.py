"""How often the lines of a layout cross, and layouts without empty space."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from thalweg.operators import quadtree
from thalweg.operators.components import connected_components
from thalweg.storage import forget, materialize, materialize_told

#: Nodes that one task walks in order.
SLICE = 200_000


def crossings(segs: DataFrame, key: str = "edge_id") -> DataFrame:
    """``key, crossings``: how many segments of other lines each line of a segment table crosses, for lines that cross any.  Segments cross where each
    parts the ends of the other; touching ends and lines on top of each other are no crossing.  Pairs are counted in
    numpy where they are found and never become rows."""
    own = segs.select(key, "x1", "y1", "x2", "y2")
    rows, tree = quadtree.meet(own, own, 0.0, capacity=1024)

    def counted(keys: pa.Array, n: np.ndarray) -> pa.RecordBatch:
        some = np.flatnonzero(n)
        return pa.RecordBatch.from_arrays([keys.take(pa.array(some)), pa.array(n[some])], [key, "n"])

    def work(square, b):
        ends, keys, others = [b.column(f"o_{c}").to_numpy() for c in ("x1", "y1", "x2", "y2")], square.rows.column(key), b.column(f"o_{key}")
        mine, theirs = np.zeros(len(keys), np.int64), np.zeros(len(others), np.int64)
        for i, j in quadtree.near_boxes(square.ends, ends, tree.slack):
            first = pc.less(keys.take(pa.array(i)), others.take(pa.array(j))).fill_null(False).to_numpy(zero_copy_only=False)
            i, j = i[first], j[first]
            x1, y1, x2, y2 = (e[i] for e in square.ends)
            u1, v1, u2, v2 = (e[j] for e in ends)
            dx, dy, ex, ey = x2 - x1, y2 - y1, u2 - u1, v2 - v1
            a, c = ex * (y1 - v1) - ey * (x1 - u1), ex * (y2 - v1) - ey * (x2 - u1)
            met = (a * c < 0) & ((dx * (v1 - y1) - dy * (u1 - x1)) * (dx * (v2 - y1) - dy * (u2 - x1)) < 0)
            # a pair may share many squares; it counts in the one where the lines cross
            i, j, t = i[met], j[met], (a[met] / (a[met] - c[met]))
            here = tree.holds(square.leaf, x1[met] + t * dx[met], y1[met] + t * dy[met])
            mine += np.bincount(i[here], minlength=len(mine))
            theirs += np.bincount(j[here], minlength=len(theirs))
        square.notes["n"] = square.notes.get("n", 0) + mine
        yield counted(others, theirs)

    def close(square):
        yield counted(square.rows.column(key), square.notes["n"])

    names = list(own.columns)
    found = rows.mapInArrow(lambda batches: quadtree.by_square(batches, names, work, close), StructType([own.schema[key]]).add("n", "long"))
    return found.groupBy(key).agg(F.sum("n").alias("crossings"))


def _folded(batches):
    """Rows ``slice, grp, line, top`` sorted by slice, those without a group first: how far each line is taken before the slice.  Gives
    ``slice, grp, line, rank`` of each group (no line) and of what is last on each line after the slice (no group)."""
    names = ["slice", "grp", "line", "rank"]
    part, group, lines, tops = None, None, set(), {}
    out: list[tuple] = []

    def close():
        nonlocal group
        if group is not None:
            rank = max(tops.get(c, -1) for c in lines) + 1
            tops.update(dict.fromkeys(lines, rank))
            out.append((part, group, None, rank))
        group = None
        lines.clear()

    def batch():
        columns = list(zip(*out)) or [()] * 4
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.float64(), pa.int64()))], names)
        out.clear()
        return made

    for b in batches:
        for slice_, grp, line, top in zip(*(b.column(c).to_pylist() for c in ("slice", "grp", "line", "top"))):
            line = None if line != line else line  # not a number is one line
            if slice_ != part:
                close()
                out.extend((part, None, c, r) for c, r in tops.items())
                part, tops = slice_, {}
            if grp is None:
                tops[line] = top
                continue
            if grp != group:
                close()
                group = grp
            lines.add(line)
        yield batch()
    close()
    out.extend((part, None, c, r) for c, r in tops.items())
    yield batch()


def _ranked(nodes: DataFrame, links: DataFrame, along: str, across: str, name: str, size: int) -> DataFrame:
    """Adds the least whole place of each node on one axis that keeps the order of the nodes beside each other, and linked nodes with equal
    places on equal ones: the longest path of the graph of who stands before whom.

    In the order of places and groups all that stands before a group comes before it, so one pass in that order finds the ranks.  The order is
    dealt into slices of ``size`` nodes, walked at once; how far each line is taken before a slice comes from the walks of the slices before, so
    after as many rounds as there are slices, at most, nothing changes.  A slice's task holds a number for each line in it."""
    place = lambda k: nodes.select(F.col("node_id").alias(k), F.col(along).alias(f"at_{k}"))
    tied = links.join(place("u"), "u").join(place("v"), "v").where("at_u = at_v").select(F.col("u").alias("a"), F.col("v").alias("b"))
    group = connected_components(tied).select(F.col("node").alias("node_id"), "component")
    held = materialize(nodes.join(group, "node_id", "left").withColumn("grp", F.coalesce("component", "node_id")).drop("component"), "groups")
    slices = max(1, -(-held.count() // size))
    rows = held.select(F.col(along).alias("at"), "grp", F.col(across).cast("double").alias("line"))
    rows = rows.repartitionByRange(slices, "at", "grp").withColumn("slice", F.spark_partition_id()) if slices > 1 else rows.withColumn("slice", F.lit(0))
    rows = materialize(rows, "slices")

    def walked(tops: DataFrame | None) -> DataFrame:
        every = rows.withColumn("top", F.lit(None).cast("long"))
        if tops is not None:
            before = Window.partitionBy("line").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
            every = every.unionByName(tops.withColumn("top", F.max("rank").over(before)).where("top is not null").select("line", "slice", "top"), allowMissingColumns=True)
        sorted_ = every.repartition(slices, "slice").sortWithinPartitions("slice", F.col("grp").isNotNull(), "at", "grp")
        return sorted_.select("slice", "grp", "line", "top").mapInArrow(_folded, "slice int, grp long, line double, rank long")

    ends, told = None, None
    for _ in range(slices - 1):
        following, now = materialize_told(walked(ends).where("grp is null"), "ends", total=F.sum("rank"))
        if ends is not None:
            forget(ends)
        ends = following
        if told == now.get("total"):
            break
        told = now.get("total")
    ranks = walked(ends).where("grp is not null").select("grp", F.col("rank").alias(name))
    return held.join(ranks, "grp").drop("grp")


def compacted(places: DataFrame, links: DataFrame, x: str = "schematic_x", y: str = "schematic_y", size: int = SLICE) -> DataFrame:
    """``node_id, column, row``: places on the smallest whole grid where nodes of one row keep their order from left to right, nodes of one of the
    new columns theirs from bottom to top, and nodes linked by an upright or level line stay on one.  ``links(u, v)``.  Nodes at different
    places stay apart; so do nodes at one place that no such line holds together.  Nodes with a null place are left out.

    Columns first, then rows; as many rounds each as there are slices of ``size`` nodes, at most."""
    nodes = places.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select("node_id", F.col(x).alias("x"), F.col(y).alias("y"))
    links = links.where("u <> v").select("u", "v")
    wide = materialize(_ranked(nodes, links, "x", "y", "column", size), "columns")
    return _ranked(wide, links, "y", "column", "row", size).select("node_id", "column", "row")
