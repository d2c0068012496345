"""Schematic layout: nodes on a grid along a spanning tree of each component, edges as straight or elbow routes."""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thalweg.functions import geometry as G
from thalweg.functions.text import size_class
from thalweg.operators.network import labelled_nodes
from thalweg.operators.selection import median
from thalweg.storage import materialize


def grid_unit(edges: DataFrame) -> DataFrame:
    """One row, ``grid``: the exact median of the edge lengths, loops included; 1 where it isn't positive."""
    m = F.max("median")
    return median(edges, "length_m").agg(F.when(F.coalesce(F.nanvl(m, F.lit(0.0)), F.lit(0.0)) > 0, m).otherwise(1.0).alias("grid"))


class _Component:
    """Nodes of one component in the order of their ids and, as numbers of nodes, the neighbours of each in the order in which they are placed."""

    def __init__(self, grid: float):
        self.grid, self.parts, self.ids, self.near = grid, [], None, array("i")

    def add_nodes(self, *columns: np.ndarray) -> None:
        self.parts.append(columns)

    def _gather(self) -> None:
        if self.ids is not None:
            return
        ids, x, y = map(np.concatenate, zip(*self.parts)) if self.parts else np.zeros((3, 0))
        first = np.ones(len(ids), bool)
        first[1:] = ids[1:] != ids[:-1]
        self.parts, self.ids, self.x, self.y = [], ids[first].astype(np.int64), x[first], y[first]
        self.degree = np.zeros(len(self.ids), np.int64)

        # ids that lie close together are looked up, others searched for
        wide = int(self.ids[-1]) - int(self.ids[0]) + 1 if len(self.ids) else 0
        self.known = None
        if 0 < wide <= 4 * len(self.ids) + 1_000_000:
            self.known = np.full(wide, -1, np.int32)
            self.known[self.ids - self.ids[0]] = np.arange(len(self.ids), dtype=np.int32)

    def add_neighbours(self, at: np.ndarray, many: np.ndarray, to: np.ndarray) -> None:
        """Neighbours of nodes, one after another: ``many`` of each."""
        self._gather()
        np.add.at(self.degree, self._numbers(at), many)
        self.near.frombytes(self._numbers(to).tobytes())

    def _numbers(self, ids: np.ndarray) -> np.ndarray:
        if self.known is not None:
            k = ids - self.ids[0]
            found = self.known[np.clip(k, 0, len(self.known) - 1)]
            wrong = (k < 0) | (k >= len(self.known)) | (found < 0)
        else:
            found = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
            wrong = self.ids[found] != ids
        if wrong.any():
            raise KeyError("an edge ends at a node without a row")
        return found.astype(np.int32)

    def places(self) -> pa.RecordBatch:
        """Grid places.  From the root, the northernmost node, neighbours are placed when first met, main and long edges first; the
        next node to leave from is always the last placed."""
        self._gather()
        x, y, grid = self.x, self.y, self.grid
        if not (np.isfinite(x).all() and np.isfinite(y).all()):
            raise ValueError("a node without a place")
        near, ends = np.frombuffer(self.near, np.int32) if self.near else np.zeros(0, np.int32), np.cumsum(self.degree)
        starts = ends - self.degree
        px, py, unmet = np.zeros(len(x)), np.zeros(len(x)), np.ones(len(x), bool)
        waiting = [int(np.argmax(y))]
        unmet[waiting] = False
        while waiting:
            n = waiting.pop()
            met = near[starts[n] : ends[n]]
            met = met[unmet[met]]
            if not len(met):
                continue
            met = met[np.sort(np.unique(met, return_index=True)[1])]
            dx, dy = x[met] - x[n], y[met] - y[n]
            along = np.abs(dx) >= np.abs(dy)
            d = np.where(along, dx, dy)
            steps = np.maximum(1.0, np.rint(np.abs(d) / grid)) * np.where(d >= 0, 1.0, -1.0)
            px[met], py[met] = px[n] + steps * along, py[n] + steps * ~along
            unmet[met] = False
            waiting.extend(met.tolist())
        ox, oy = (round(float(c.mean()) / grid) for c in (x, y))
        met = ~unmet
        return pa.RecordBatch.from_arrays([pa.array(self.ids[met]), pa.array((ox + px[met]) * grid), pa.array((oy + py[met]) * grid)], ["node_id", "schematic_x", "schematic_y"])


#: Places of small components that are handed on together.
TOGETHER = 10_000


def _lists(batches):
    """Rows ``component, at, to`` in the order of the walk to ``component, at, k, to``: lists of neighbours, numbered in their order.  Of a neighbour
    that is met again the first is enough; a list that goes on in the next batch is another one."""
    k = 0
    for b in batches:
        if not len(b):
            continue
        component, at, to = (b.column(c).to_numpy() for c in ("component", "at", "to"))
        starts = np.flatnonzero(np.r_[True, (component[1:] != component[:-1]) | (at[1:] != at[:-1])])
        run = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(at)]))
        order = np.lexsort((to, run))
        again = (run[order][1:] == run[order][:-1]) & (to[order][1:] == to[order][:-1])
        kept = np.sort(order[np.r_[True, ~again]])
        offsets = np.r_[0, np.cumsum(np.bincount(run[kept], minlength=len(starts)))]
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(to[kept]))
        yield pa.RecordBatch.from_arrays([pa.array(component[starts]), pa.array(at[starts]), pa.array(np.arange(k, k + len(starts))), lists], ["component", "at", "k", "to"])
        k += len(starts)


def _walk(batches):
    """Rows ``component, grid, at, x, y, to``, sorted by component, nodes (``to`` is null) before neighbours, one or a list a row, to places."""
    part, held, done, rows = None, None, [], 0
    for b in batches:
        component, at, x, y = (b.column(c).to_numpy(zero_copy_only=False) for c in ("component", "at", "x", "y"))
        node, to = b.column("to").is_null().to_numpy(zero_copy_only=False), b.column("to")
        listed = pa.types.is_list(to.type)
        many = pc.fill_null(pc.list_value_length(to), 0).to_numpy().astype(np.int64) if listed else (~node).astype(np.int64)
        ends, to = np.r_[0, np.cumsum(many)], (to.flatten() if listed else to.drop_null()).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(component)) + 1).tolist(), len(component)]
        for s, e in zip(cuts, cuts[1:]) if len(component) else ():
            if held is None or component[s] != part:
                if held is not None:
                    done.append(held.places())
                    rows += len(done[-1])
                part, held = component[s], _Component(b.column("grid")[s].as_py())
            m = s + int(node[s:e].sum())
            if m > s:
                held.add_nodes(at[s:m], x[s:m], y[s:m])
            if e > m:
                held.add_neighbours(at[m:e], many[m:e], to[ends[m] : ends[e]])
        if rows >= TOGETHER:
            yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
            done, rows = [], 0
    if held is not None:
        done.append(held.places())
    yield from done


def layout(nodes: DataFrame, edges: DataFrame, whole: bool = False) -> DataFrame:
    """``node_id, schematic_x, schematic_y`` for ``nodes(node_id, x, y)``.  The walk is sequential within a component; components are
    independent and run in parallel.  ``whole``: they are one component, as of :func:`thalweg.operators.network.trunk`, and none is looked for.

    Many tasks put the neighbours of each node in the order of the walk, each neighbour once.  The task of a component reads one list a
    node, sorted by Spark; it holds a number for each neighbour, and id and place of each node."""
    labels = None if whole else materialize(labelled_nodes(edges, nodes), "parts")
    left = nodes.select("node_id", "x", "y").withColumn("component", F.lit(0).cast("long")) if whole else nodes.select("node_id", "x", "y").join(labels, "node_id")
    left = left.crossJoin(F.broadcast(grid_unit(edges)))
    none = F.lit(None).cast("long")
    left = left.select("component", "grid", F.col("node_id").alias("at"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), none.alias("k"), F.lit(None).cast("array<long>").alias("to"))
    main = (size_class(F.col("tag")) != "main").alias("main")
    both = F.explode(F.array(F.struct(F.col("u").alias("at"), F.col("v").alias("to")), F.struct(F.col("v").alias("at"), F.col("u").alias("to")))).alias("e")
    right = edges.where("u <> v").select("edge_id", "u", (-F.col("length_m")).cast("double").alias("neg"), main, both)
    right = right.withColumn("component", F.lit(0).cast("long")) if whole else right.join(labels.withColumnRenamed("node_id", "u"), "u")
    right = right.select("component", F.col("e.at").cast("long").alias("at"), F.col("e.to").cast("long").alias("to"), "main", "neg", "edge_id")
    # few bytes make much work here, so the number of tasks is not left to bytes
    spark = edges.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    right = right.repartition(tasks, "component", "at").sortWithinPartitions("component", "at", "main", "neg", "edge_id").select("component", "at", "to")
    lists = right.mapInArrow(_lists, "component long, at long, k long, to array<long>")
    nothing = F.lit(None).cast("double")
    rows = left.unionByName(lists.select("component", nothing.alias("grid"), "at", nothing.alias("x"), nothing.alias("y"), "k", "to"))
    rows = rows.withColumn("edge", F.col("to").isNotNull()).repartition("component").sortWithinPartitions("component", "edge", "at", "k").select("component", "grid", "at", "x", "y", "to")
    return rows.mapInArrow(_walk, "node_id long, schematic_x double, schematic_y double")


def route(edges: DataFrame, nodes: DataFrame, places: DataFrame) -> DataFrame:
    """Edges with their route between placed nodes: ``kind`` (zero, straight, elbow), ends and bend.  The first leg of an elbow follows the
    real direction of the edge."""
    at = nodes.select("node_id", "x", "y").join(places, "node_id")
    end = lambda k: at.select(F.col("node_id").alias(k), *[F.col(c).alias(f"{k}_{n}") for c, n in (("x", "rx"), ("y", "ry"), ("schematic_x", "x"), ("schematic_y", "y"))])
    e = edges.join(end("u"), "u").join(end("v"), "v")
    horizontal = F.abs(F.col("v_rx") - F.col("u_rx")) >= F.abs(F.col("v_ry") - F.col("u_ry"))
    r = G.elbow(F.col("u_x"), F.col("u_y"), F.col("v_x"), F.col("v_y"), horizontal)
    return e.withColumns(r).select(*edges.columns, size_class(F.col("tag")).alias("waterway_size"), "kind", F.col("u_x").alias("x1"), F.col("u_y").alias("y1"), F.col("v_x").alias("x2"), F.col("v_y").alias("y2"), "bend_x", "bend_y")


def to_screen(points: DataFrame, canvas: float = 2400.0, margin: int = 40, x: str = "x", y: str = "y") -> DataFrame:
    """Adds whole pixels ``sx, sy``: one scale for both axes, y downward, rounded half to even."""
    bounds = points.agg(F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min(y).alias("_y0"), F.max(y).alias("_y1"))
    return apply_screen(points.crossJoin(F.broadcast(bounds)), x, y, "sx", "sy", canvas, margin).drop("_x0", "_x1", "_y0", "_y1")


def apply_screen(df: DataFrame, x: str, y: str, sx: str, sy: str, canvas: float = 2400.0, margin: int = 40) -> DataFrame:
    extent = lambda a, b: F.when(F.col(b) == F.col(a), 1.0).otherwise(F.col(b) - F.col(a))
    scale = F.lit(canvas) / F.greatest(extent("_x0", "_x1"), extent("_y0", "_y1"))
    return df.withColumns({sx: (F.bround((F.col(x) - F.col("_x0")) * scale) + margin).cast("long"), sy: (F.bround((F.col("_y1") - F.col(y)) * scale) + margin).cast("long")})


def elements(routed: DataFrame, places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Display nodes ``node_key, pos_x, pos_y`` and edges with their bends in pixels; loops are left out."""
    box = places.agg(F.min("schematic_x").alias("_x0"), F.max("schematic_x").alias("_x1"), F.min("schematic_y").alias("_y0"), F.max("schematic_y").alias("_y1"))
    n = apply_screen(places.crossJoin(F.broadcast(box)), "schematic_x", "schematic_y", "pos_x", "pos_y")
    nodes = n.select(F.concat(F.lit("n"), "node_id").alias("node_key"), F.lit("").alias("label"), F.lit(0).alias("rotation"), F.lit("h").alias("dir"), "pos_x", "pos_y")
    e = routed.where("u <> v").crossJoin(F.broadcast(box))
    for k in ("1", "2"):
        e = apply_screen(e, f"x{k}", f"y{k}", f"sx{k}", f"sy{k}")
    e = apply_screen(e, "bend_x", "bend_y", "bx", "by")
    bent = F.coalesce((F.col("kind") == "elbow") & ~((F.col("bx") == F.col("sx1")) & (F.col("by") == F.col("sy1"))) & ~((F.col("bx") == F.col("sx2")) & (F.col("by") == F.col("sy2"))), F.lit(False))
    dist, weight = G.bend_offset(*(F.col(c).cast("double") for c in ("bx", "by", "sx1", "sy1", "sx2", "sy2")))
    edges = e.withColumn("engine_bend", bent).select(
        F.concat(F.lit("e"), "edge_id").alias("edge_key"), F.concat(F.lit("n"), "u").alias("source_node_key"), F.concat(F.lit("n"), "v").alias("target_node_key"), F.coalesce("name", F.lit("")).alias("label"),
        F.col("waterway_size").alias("edge_type"), (~F.col("engine_bend")).alias("engine_straight"), "engine_bend", F.when(F.col("engine_bend"), F.round(dist, 2)).alias("seg_dist"), F.when(F.col("engine_bend"), F.round(weight, 4)).alias("seg_weight"),
    )
    return nodes, edges
