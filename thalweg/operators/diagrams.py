"""Published diagrams: versions, display rules and edit operations."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sources a version may come from.
SOURCES = ("engine", "community")
# Structures that can be broken (planned ones can't), the status that says so, and the words of the legend.
BREAKABLE = ("gate", "weir", "reservoir", "telemetry", "pump")
BROKEN_STATUS = "ชำรุด"
LEGEND = {
    "gate": "ประตูระบายน้ำ/ปตร. (ปัจจุบัน)",
    "gate_plan": "ประตูระบายน้ำ/ปตร. (แผน)",
    "weir": "ฝาย (ปัจจุบัน)",
    "weir_plan": "ฝาย (แผน)",
    "reservoir": "อ่างเก็บน้ำ (ปัจจุบัน)",
    "reservoir_plan": "อ่างเก็บน้ำ (แผน)",
    "telemetry": "สถานีโทรมาตร",
    "pump": "สถานีสูบน้ำ",
    "waterbody": "แหล่งน้ำ (หนอง/บึง/สระน้ำ)",
}
BROKEN_LEGEND = {
    "gate_broken": "ประตูระบายน้ำ/ปตร. (ชำรุด)",
    "weir_broken": "ฝาย (ชำรุด)",
    "reservoir_broken": "อ่างเก็บน้ำ (ชำรุด)",
    "telemetry_broken": "สถานีโทรมาตร (ชำรุด)",
    "pump_broken": "สถานีสูบน้ำ (ชำรุด)",
}
EDGE_LEGEND = {"main": "ลำน้ำหลัก", "branch": "ลำน้ำสาขา"}
# Shape, width and height of a symbol drawn along the flow.
SHAPES = {
    "gate": ("diamond", 18, 18), "gate_plan": ("diamond", 18, 18), "weir": ("bar", 32, 12), "weir_plan": ("bar", 32, 12), "reservoir": ("triangle", 22, 22), "reservoir_plan": ("triangle", 22, 22),
    "telemetry": ("ring", 18, 18), "pump": ("circle", 22, 22), "waterbody": ("bar", 44, 26),
}
OTHER = ("dot", 7, 7)
TURNS_OVER = ("weir", "weir_plan", "waterbody")


def current_versions(versions: DataFrame, area: str = "tambon_id") -> DataFrame:
    """Versions with ``is_current`` set for the latest of each area; only known sources count."""
    w = Window.partitionBy(area).orderBy(F.desc("created_at"), F.desc("version_id"))
    return versions.where(F.col("source").isin(*SOURCES)).withColumn("is_current", F.row_number().over(w) == 1)


def difference(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """``key, change, fields`` of the keys that differ: ``added``, ``removed`` or ``changed``, and then the columns that did, by name; a column
    that one side lacks counts as null there.  Keys that are null take no part; rows that share a key are compared as a set of rows, and then
    ``fields`` is empty where only their combination changed.  Rows are compared by 64-bit hashes of each column, summed a key, in one full
    outer join; no row is moved."""
    names = sorted((set(before.columns) | set(after.columns)) - {key})

    def told(df: DataFrame, side: str) -> DataFrame:
        own = df.where(F.col(key).isNotNull()).select(key, *[F.to_json(F.struct(F.col(c).alias("v"))).alias(c) if c in df.columns else F.lit("{}").alias(c) for c in names])
        total = lambda *c: F.sum(F.xxhash64(*c).cast("decimal(20,0)"))
        return own.groupBy(key).agg(*[total(c).alias(f"{side}{i}") for i, c in enumerate(names)], (total(*names) if names else F.count("*").cast("decimal(30,0)")).alias(f"{side}_row"))

    both = told(before, "a").join(told(after, "b"), key, "full_outer")
    change = F.when(F.col("a_row").isNull(), "added").when(F.col("b_row").isNull(), "removed").when(F.col("a_row") != F.col("b_row"), "changed")
    differs = F.array_compact(F.array(*[F.when(F.col(f"a{i}") != F.col(f"b{i}"), F.lit(c)) for i, c in enumerate(names)])) if names else F.array().cast("array<string>")
    fields = F.when(F.col("a_row").isNotNull() & F.col("b_row").isNotNull(), differs).otherwise(F.array().cast("array<string>"))
    return both.select(key, change.alias("change"), fields.alias("fields")).where("change is not null")


def orphans(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that name a node their version lacks."""
    key = nodes.select("version_id", "node_key")
    gone = lambda c: edges.join(key.withColumnRenamed("node_key", c), ["version_id", c], "left_anti").select("version_id", "edge_key")
    return gone("source_node_key").unionByName(gone("target_node_key")).distinct()


def is_broken(node_type: Column, status: Column) -> Column:
    return F.coalesce((status == BROKEN_STATUS) & node_type.isin(*BREAKABLE), F.lit(False))


def _lookup(table: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(v) for kv in table.items() for v in kv]), key)


def draw_list(nodes: DataFrame) -> DataFrame:
    """Nodes with shape, size (swapped for upright bars), fill and caption.  A text box is its text and no symbol; a node of another kind
    is a grey dot, without a caption if it is a generic one; a water body shows what it refers to under its label."""
    kind, label = F.coalesce("node_type", F.lit("")), F.coalesce("label", F.lit(""))
    upright = (F.col("dir") == "v") & kind.isin(*TURNS_OVER)
    shape, w, h = (F.coalesce(_lookup({k: v[i] for k, v in SHAPES.items()}, kind), F.lit(OTHER[i])) for i in (0, 1, 2))
    text = kind == "text_box"
    white = kind.endswith("_plan") | kind.isin("telemetry", "pump")
    fill = F.when(text, "none").when(~kind.isin(*SHAPES), "grey").when(is_broken(kind, F.col("status")), "hatched").when(kind == "waterbody", "water").when(white, "white").otherwise("black")
    ref = F.coalesce(F.col("source_ref").cast("string"), F.lit(""))
    told = F.when(ref == "", label).when(label == "", F.concat(F.lit("["), ref, F.lit("]"))).otherwise(F.concat(label, F.lit("\n[sp"), ref, F.lit("]")))
    caption = F.when(kind == "waterbody", told).when(kind == "generic_node", "").otherwise(label)
    size = lambda a, b: F.when(~text, F.when(upright, b).otherwise(a))
    return nodes.select("node_key", "pos_x", "pos_y", F.when(text, "text").otherwise(shape).alias("shape"), size(w, h).alias("width"), size(h, w).alias("height"), fill.alias("fill"), caption.alias("caption"))


def legend(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``part, key, label`` of the symbols in use, edge classes first, in order."""
    lines = edges.select(F.when(F.col("edge_type") == "main", "main").otherwise("branch").alias("key")).distinct().select(F.lit(0).alias("part"), "key", _lookup(EDGE_LEGEND, F.col("key")).alias("label"))
    used = nodes.select(F.col("node_type").alias("key")).distinct().select(F.lit(1).alias("part"), "key", _lookup(LEGEND, F.col("key")).alias("label")).where("label is not null")
    bad = nodes.where(is_broken(F.col("node_type"), F.col("status"))).select(F.concat("node_type", F.lit("_broken")).alias("key")).distinct().select(F.lit(2).alias("part"), "key", _lookup(BROKEN_LEGEND, F.col("key")).alias("label"))
    return lines.unionByName(used).unionByName(bad).orderBy("part", F.when(F.col("part") == 0, F.when(F.col("key") == "main", "0").otherwise("1")).otherwise(F.col("key")))


def drawn_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the places of both ends; those that lack an end are dropped."""
    end = lambda k, n: nodes.select(F.col("node_key").alias(k), F.col("pos_x").alias(f"x{n}"), F.col("pos_y").alias(f"y{n}"))
    return edges.join(end("source_node_key", 1), "source_node_key").join(end("target_node_key", 2), "target_node_key")


def delete_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the nodes ``gone(node_key)`` and the edges at them."""
    left = nodes.join(gone, "node_key", "left_anti")
    e = edges.join(gone.withColumnRenamed("node_key", "source_node_key"), "source_node_key", "left_anti")
    return left, e.join(gone.withColumnRenamed("node_key", "target_node_key"), "target_node_key", "left_anti").select(*edges.columns)


def split_edges(nodes: DataFrame, edges: DataFrame, cuts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Puts a node ``cuts(edge_key, node_key, pos_x, pos_y)`` on an edge: the first half keeps the label, the second has none."""
    cut = edges.join(cuts.select("edge_key", F.col("node_key").alias("_mid")), "edge_key")
    rest = [c for c in edges.columns if c not in ("edge_key", "source_node_key", "target_node_key", "label")]
    a = cut.select(F.concat("edge_key", F.lit("a")).alias("edge_key"), "source_node_key", F.col("_mid").alias("target_node_key"), "label", *rest)
    b = cut.select(F.concat("edge_key", F.lit("b")).alias("edge_key"), F.col("_mid").alias("source_node_key"), "target_node_key", F.lit("").alias("label"), *rest)
    kept = edges.join(cuts.select("edge_key"), "edge_key", "left_anti").select(*a.columns)
    return nodes.unionByName(cuts.drop("edge_key"), allowMissingColumns=True), kept.unionByName(a).unionByName(b)


def rotate(node_type: Column, rotation: Column, direction: Column) -> tuple[Column, Column]:
    """Rotation and direction after a turn: bars swap direction, others turn by 90 degrees."""
    bar = F.coalesce(node_type.isin(*TURNS_OVER), F.lit(False))
    return F.when(bar, 0).otherwise(F.pmod(rotation + 90, F.lit(360))), F.when(bar, F.when(direction == "h", "v").otherwise("h")).otherwise(direction)


def edited_label(text: Column) -> Column:
    return F.replace(text, F.lit("\\n"), F.lit("\n"))


# Labels of new nodes by kind, and of a new edge.
NEW_LABELS = {
    "gate": "ปตร.", "weir": "ฝาย", "reservoir": "อ่างฯ", "telemetry": "โทรมาตร", "pump": "",
    "gate_plan": "ปตร.(แผน)", "weir_plan": "ฝาย(แผน)", "generic_node": "", "waterbody": "ชื่อแหล่งน้ำ\n(ความจุ)",
}
NEW_EDGE = "คลองใหม่"


def insert_nodes(nodes: DataFrame, fresh: DataFrame) -> DataFrame:
    """Adds nodes ``fresh(node_key, node_type, pos_x, pos_y[, label])`` with the label of their kind, or a text box with its text; a text
    box without text is not added."""
    given = F.col("label") if "label" in fresh.columns else F.lit(None).cast("string")
    text = F.col("node_type") == "text_box"
    rows = fresh.withColumn("label", F.when(text, given).otherwise(_lookup(NEW_LABELS, F.col("node_type")))).where(~text | (F.coalesce("label", F.lit("")) != ""))
    return nodes.unionByName(rows.withColumns({"rotation": F.lit(0), "dir": F.lit("h")}), allowMissingColumns=True)


def draw_edges(edges: DataFrame, nodes: DataFrame, fresh: DataFrame) -> DataFrame:
    """Adds edges ``fresh(edge_key, source_node_key, target_node_key, edge_type)`` between two different nodes that exist."""
    known = lambda k: nodes.select(F.col("node_key").alias(k))
    rows = fresh.where("source_node_key <> target_node_key").join(known("source_node_key"), "source_node_key", "left_semi").join(known("target_node_key"), "target_node_key", "left_semi")
    return edges.unionByName(rows.select(*fresh.columns).withColumn("label", F.lit(NEW_EDGE)), allowMissingColumns=True)


def move_nodes(nodes: DataFrame, moves: DataFrame) -> DataFrame:
    """Nodes at their last place of ``moves(node_key, seq, pos_x, pos_y)``; moves of unknown nodes do nothing."""
    last = moves.groupBy("node_key").agg(F.max(F.struct("seq", "pos_x", "pos_y")).alias("_to"))
    at = lambda c: F.coalesce(F.col(f"_to.{c}").cast(dict(nodes.dtypes)[c]), F.col(c)).alias(c)
    return nodes.join(last, "node_key", "left").select(*[at(c) if c in ("pos_x", "pos_y") else c for c in nodes.columns])


def export_elements(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``value``: one JSON element per node and edge, nodes first, as :func:`thalweg.sources.documents.split_elements` reads them."""
    of = lambda df, names: [F.col(c).alias(a) for c, a in names.items() if c in df.columns]
    node = of(nodes, {"node_key": "id", "label": "label", "node_type": "type", "rotation": "rotation", "dir": "dir"})
    edge = of(edges, {"edge_key": "id", "source_node_key": "source", "target_node_key": "target", "label": "label", "edge_type": "type", "engine_straight": "engineStraight", "engine_bend": "engineBend", "seg_dist": "segDist", "seg_weight": "segWeight"})
    place = F.struct(F.col("pos_x").cast("double").alias("x"), F.col("pos_y").cast("double").alias("y"))
    a = nodes.select(F.lit(0).alias("part"), F.to_json(F.struct(F.struct(*node).alias("data"), place.alias("position"))).alias("value"))
    return a.unionByName(edges.select(F.lit(1).alias("part"), F.to_json(F.struct(F.struct(*edge).alias("data"))).alias("value")))


def linked(nodes: DataFrame) -> DataFrame:
    """One row: ``nodes``, and ``linked``, how many of them refer to a reading."""
    return nodes.agg(F.count("*").alias("nodes"), F.count_if(F.coalesce(F.col("source_ref").cast("string"), F.lit("")) != "").alias("linked"))
