"""Network-shaped views of the sample tables, the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("seq"), (F.col("embedding")[0].cast("double") * 1000).alias("x"), (F.col("embedding")[1].cast("double") * 1000).alias("y"), "label")


def short_lines(spark, sf_dir) -> DataFrame:
    """A line of three vertices for each embedding."""
    e = table(spark, sf_dir, "embeddings")
    at = lambda k, f: F.col("embedding")[k].cast("double") * f
    x, y = [at(0, 1000)], [at(1, 1000)]
    for k in (2, 4):
        x.append(x[-1] + at(k, 100))
        y.append(y[-1] + at(k + 1, 100))
    geom = F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in zip(x, y)])
    return e.select(F.col("vec_id").alias("line_id"), F.when(F.col("label") % 2 == 0, "primary").otherwise("supplement").alias("source"), F.col("label").alias("tag"), geom.alias("geom"))


def tracks(spark, sf_dir) -> DataFrame:
    """Vertices of one line per user, in the order of time: ``user_id, k, x, y``; hours since the start of 2024 and the value."""
    e = table(spark, sf_dir, "events")
    hours = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)") / F.lit(3.6e9)
    return e.select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts")).alias("k"), hours.alias("x"), F.col("value").alias("y"))


#: All columns of a row, in the order in which the edges of the whole network are numbered.
ROW = ["l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def net(spark, sf_dir, u="l_partkey", v="1000000 + l_suppkey", ids=True) -> DataFrame:
    """An edge for each row of lineitem; ``ids``: numbered in the order of the whole row."""
    from thalweg.operators.spatial import dense_ids

    li = table(spark, sf_dir, "lineitem")
    edges = [F.expr(u).alias("u"), F.expr(v).alias("v"), F.col("l_extendedprice").alias("length_m"), F.when(F.col("l_returnflag") == "R", "primary").otherwise("supplement").alias("source"), F.when(F.col("l_linestatus") == "F", "river").otherwise("canal").alias("tag"), F.concat(F.lit("e"), "l_orderkey").alias("name"), F.col("l_discount").alias("discount")]
    return dense_ids(li.select(*ROW), ROW, "edge_id", then=edges) if ids else li.select(*edges)  # what edges are made of is shuffled once


#: Rings of an area for each supplier, around its centre: the outer one, a hole (of two thirds of the areas) and a part beside it (of every other).
OUTER = ((1.0, 0.2), (0.3, 0.9), (-0.8, 0.6), (-0.9, -0.5), (0.1, -1.0), (0.7, -0.6))
HOLE = ((0.3, 0.1), (-0.2, 0.3), (0.0, -0.4))
BESIDE = ((1.5, 0.0), (2.1, 0.1), (1.9, 0.7))


def supplier_areas(spark, sf_dir) -> DataFrame:
    """``area_id, rings``: areas of several parts with holes."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("area_id"), (F.col("s_suppkey") * 37 % 800 - 400).alias("x"), (F.col("s_suppkey") * 91 % 800 - 400).alias("y"), (F.lit(20) + F.col("s_suppkey") % 7 * 15).alias("r"))
    ring = lambda places: F.array(*[F.struct((F.col("x") + F.col("r") * a).alias("x"), (F.col("y") + F.col("r") * b).alias("y")) for a, b in places])
    rings = [F.array(ring(OUTER)), F.when(F.col("area_id") % 3 > 0, F.array(ring(HOLE))).otherwise(F.array().cast("array<array<struct<x:double,y:double>>>")), F.when(F.col("area_id") % 2 == 0, F.array(ring(BESIDE))).otherwise(F.array().cast("array<array<struct<x:double,y:double>>>"))]
    return s.select("area_id", F.concat(*rings).alias("rings"))


_SIDES = ", ".join(f"({k}, {a}::double, {b}::double, {c}::double, {e}::double)" for k, places in enumerate((OUTER, HOLE, BESIDE)) for (a, b), (c, e) in zip(places, places[1:] + places[:1]))
AREAS_SQL = f"""shape(part, ax, ay, bx, by_) as (values {_SIDES}),
  sup as (select s_suppkey as area_id, s_suppkey * 37 % 800 - 400 as x, s_suppkey * 91 % 800 - 400 as y, 20 + s_suppkey % 7 * 15 as r from supplier),
  sides as (select area_id, x + r * ax as ax, y + r * ay as ay, x + r * bx as bx, y + r * by_ as by_ from sup join shape on part = 0 or (part = 1 and area_id % 3 > 0) or (part = 2 and area_id % 2 = 0))"""
PTS_SQL = "pts as (select vec_id as seq, embedding[1]::double * 1000 as x, embedding[2]::double * 1000 as y, label from embeddings)"
SEGS_SQL = """v as (select vec_id as line_id, case when label % 2 = 0 then 'primary' else 'supplement' end as source, label as tag, embedding[1]::double * 1000 as ax, embedding[2]::double * 1000 as ay,
    embedding[3]::double * 100 as p, embedding[4]::double * 100 as q, embedding[5]::double * 100 as r, embedding[6]::double * 100 as s from embeddings),
  segs as (select line_id, source, tag, 0 as seg, ax as x1, ay as y1, ax + p as x2, ay + q as y2 from v union all select line_id, source, tag, 1, ax + p, ay + q, ax + p + r, ay + q + s from v)"""
TRACKS_SQL = "tracks as (select user_id, row_number() over (partition by user_id order by ts) as k, date_diff('microsecond', timestamp '2024-01-01', ts) / 3.6e9::double as x, value as y from events)"
NET_SQL = """net as (select l_partkey as u, 1000000 + l_suppkey as v, l_extendedprice as length_m, case when l_returnflag = 'R' then 'primary' else 'supplement' end as source,
    case when l_linestatus = 'F' then 'river' else 'canal' end as tag, 'e' || l_orderkey as name, l_discount as discount,
    row_number() over (order by %s) - 1 as edge_id from lineitem)""" % ", ".join(ROW)


#: Components of net by the least node: label(node, comp).
COMPONENTS_SQL = """links as (select u as a, v as b from net union select v, u from net),
  cc(node, comp) using key (node) as (select a, a from (select distinct a from links)
    union select l.b, min(c.comp) from cc c join links l on l.a = c.node join recurring.cc r on r.node = l.b where c.comp < r.comp group by l.b)"""
