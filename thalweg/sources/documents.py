"""Readers and writers of the wire formats: GeoJSON, GraphML, script-wrapped JSON, tag-filtered map responses, place hierarchies."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAIR = "array<double>"


def read_geojson(spark: SparkSession, path: str, properties: str, geometry: str = "LineString") -> DataFrame:
    """Features of a collection: the named properties (a DDL list), ``geom`` as vertices, and ``srid`` (4326 where the file names none)."""
    coords = {"Point": PAIR, "LineString": f"array<{PAIR}>", "Polygon": f"array<array<{PAIR}>>"}[geometry]
    schema = f"crs struct<properties:struct<name:string>>, features array<struct<properties:struct<{properties}>,geometry:struct<type:string,coordinates:{coords}>>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    rows = raw.select(F.coalesce(F.nullif(F.regexp_extract("crs.properties.name", "(\\d+)$", 1), F.lit("")).cast("int"), F.lit(4326)).alias("srid"), F.explode("features").alias("f"))
    c = F.col("f.geometry.coordinates")
    ring = {"Point": F.array(c), "LineString": c, "Polygon": F.element_at(c, 1) if geometry == "Polygon" else c}[geometry]
    geom = F.transform(ring, lambda p: F.struct(F.element_at(p, 1).alias("x"), F.element_at(p, 2).alias("y")))
    return rows.select("f.properties.*", geom.alias("geom"), "srid")


def geojson_lines(df: DataFrame, geom: str = "geom") -> DataFrame:
    """One line of text per feature: ``{"type": "Feature", ...}``; the writer puts them into a collection."""
    properties = F.struct(*[c for c in df.columns if c not in (geom, "srid")])
    coords = F.transform(geom, lambda p: F.array(p.x, p.y))
    shape = F.struct(F.when(F.size(geom) == 1, "Point").otherwise("LineString").alias("type"), F.when(F.size(geom) > 1, F.to_json(coords)).otherwise(F.to_json(F.element_at(coords, 1))).alias("coordinates"))
    head = F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties")), {"ignoreNullFields": "false"})
    tail = F.concat(F.lit(',"geometry":{"type":"'), shape["type"], F.lit('","coordinates":'), shape["coordinates"], F.lit("}}"))
    return df.select(F.concat(F.expr("''"), F.substring(head, F.lit(1), F.length(head) - 1), tail).alias("value"))


def write_geojson(df: DataFrame, path: str, srid: int = 32647, geom: str = "geom") -> None:
    """A folder of one collection per partition, each a whole document."""
    crs = f'{{"type":"name","properties":{{"name":"urn:ogc:def:crs:EPSG::{srid}"}}}}'

    def frame(batches):
        import pyarrow as pa

        yield pa.RecordBatch.from_arrays([pa.array([f'{{"type":"FeatureCollection","crs":{crs},"features":['])], ["value"])
        first = True
        for b in batches:
            rows = b.column(0).to_pylist()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(([rows[0]] if first else ["," + rows[0]]) + ["," + r for r in rows[1:]])], ["value"])
                first = False
        yield pa.RecordBatch.from_arrays([pa.array(["]}"])], ["value"])

    geojson_lines(df, geom).mapInArrow(frame, "value string").write.text(path)


def _xml(x: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(raw), F.lit(safe))
    return x


# The keys of the graph file.
NODE_KEYS = (("d0", "x", "double"), ("d1", "y", "double"))
EDGE_KEYS = (("d2", "edge_id", "long"), ("d3", "length_m", "double"), ("d4", "source", "string"), ("d5", "waterway_tag", "string"), ("d6", "name", "string"))


def graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The graph as ordered lines ``(part, value)`` with nulls as empty text and without geometry."""
    spark = nodes.sparkSession
    keys = [f'<key id="{k}" for="node" attr.name="{n}" attr.type="{t}"/>' for k, n, t in NODE_KEYS] + [f'<key id="{k}" for="edge" attr.name="{n}" attr.type="{t}"/>' for k, n, t in EDGE_KEYS]
    head = ['<?xml version="1.0" encoding="utf-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', *keys, '<graph edgedefault="undirected">']
    data = lambda keys, df: F.concat(*[F.concat(F.lit(f'<data key="{k}">'), _xml(F.coalesce(F.col(n).cast("string"), F.lit(""))), F.lit("</data>")) for k, n, _ in keys])
    n = nodes.select(F.lit(1).alias("part"), F.concat(F.lit('<node id="'), F.col("node_id").cast("string"), F.lit('">'), data(NODE_KEYS, nodes), F.lit("</node>")).alias("value"))
    e = edges.select(F.lit(2).alias("part"), F.concat(F.lit('<edge source="'), F.col("u").cast("string"), F.lit('" target="'), F.col("v").cast("string"), F.lit('">'), data(EDGE_KEYS, edges), F.lit("</edge>")).alias("value"))
    frame = lambda part, lines: spark.createDataFrame([(part, x) for x in lines], "part int, value string")
    return frame(0, ["\n".join(head)]).unionByName(n).unionByName(e).unionByName(frame(3, ["</graph>\n</graphml>"]))


def parse_graphml_edges(lines: DataFrame) -> DataFrame:
    """Edges of graph lines (one element a line)."""
    at = lambda k: F.nullif(F.regexp_extract("value", f'<data key="{k}">(.*?)</data>', 1), F.lit(""))
    plain = lambda x: F.replace(F.replace(F.replace(F.replace(x, F.lit("&quot;"), F.lit('"')), F.lit("&gt;"), F.lit(">")), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))
    rows = lines.where(F.col("value").contains("<edge "))
    ends = [F.regexp_extract("value", f'{k}="(.*?)"', 1).cast("long").alias(a) for k, a in (("source", "u"), ("target", "v"))]
    return rows.select(*ends, *[plain(at(k)).cast({"long": "bigint"}.get(t, t)).alias(n) for k, n, t in EDGE_KEYS])


def unwrap_script(text: Column) -> Column:
    """The array assigned in a script file, as JSON text; null where there is none."""
    return F.nullif(F.regexp_extract(text, "(?s)=\\s*(\\[.*\\])\\s*;\\s*$", 1), F.lit(""))


def write_script(path: str, variable: str, items: list[dict], comment: str = "generated") -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write(f"// {comment}\nconst {variable} = {json.dumps(items, ensure_ascii=False, indent=2)}\n;\n")


#: Characters of one script file, but for a longer element: a reader holds a whole file, and its elements, at once.
SCRIPT = 1 << 22


def write_scripts(elements: DataFrame, path: str, variable: str, comment: str = "generated", column: str = "value", compression: str | None = None) -> None:
    """A folder of script files, each a whole one, from JSON elements; no element is held on the driver.  A partition gives as many files of
    ``SCRIPT`` characters as it needs, so that files don't grow with the input.  Files appear when all are written."""
    most = SCRIPT

    def frame(batches):
        import pyarrow as pa

        def script():
            return pa.RecordBatch.from_arrays([pa.array(["\n".join([f"// {comment}", f"const {variable} = [", *([",\n".join(held)] if held else []), "]", ";"])])], ["value"])

        held, size, written = [], 0, False
        for b in batches:
            for row in b.column(0).to_pylist():
                if row is None:
                    continue
                if held and size + len(row) > most:
                    yield script()
                    held, size, written = [], 0, True
                held.append(row)
                size += len(row) + 2
        if held or not written:
            yield script()

    scripts = elements.select(F.col(column).cast("string").alias("value")).mapInArrow(frame, "value string")
    scripts.write.option("maxRecordsPerFile", 1).text(path, compression=compression)  # a record is a file


def read_scripts(spark: SparkSession, path: str) -> DataFrame:
    """``elements``: the array of each script file, as JSON text."""
    return spark.read.text(path, wholetext=True).select(unwrap_script(F.col("value")).alias("elements"))


ELEMENT = (
    "struct<data:struct<id:string,source:string,target:string,label:string,type:string,rotation:int,dir:string,engineStraight:boolean,engineBend:boolean,segDist:double,segWeight:double>,"
    "position:struct<x:double,y:double>>"
)


def split_elements(df: DataFrame, column: str = "elements") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of element arrays given as JSON text: what has a source and a target is an edge."""
    e = df.select(F.explode(F.from_json(column, f"array<{ELEMENT}>")).alias("e")).select("e.data.*", "e.position")
    is_edge = F.col("source").isNotNull() & F.col("target").isNotNull()
    text, yes = (lambda c: F.coalesce(F.col(c), F.lit(""))), (lambda c: F.coalesce(F.col(c), F.lit(False)))
    nodes = e.where(~is_edge).select(F.col("id").alias("node_key"), text("label").alias("label"), F.col("type").alias("node_type"), F.coalesce("rotation", F.lit(0)).alias("rotation"), F.coalesce("dir", F.lit("h")).alias("dir"), F.col("position.x").alias("pos_x"), F.col("position.y").alias("pos_y"))
    edges = e.where(is_edge).select(
        F.col("id").alias("edge_key"), F.col("source").alias("source_node_key"), F.col("target").alias("target_node_key"), text("label").alias("label"), F.col("type").alias("edge_type"),
        yes("engineStraight").alias("engine_straight"), yes("engineBend").alias("engine_bend"), F.col("segDist").alias("seg_dist"), F.col("segWeight").alias("seg_weight"),
    )
    return nodes, edges


RESPONSE = "elements array<struct<type:string,id:bigint,tags:map<string,string>,geometry:array<struct<lat:double,lon:double>>>>"
WATER_TAGS = ("river", "canal", "stream", "drain")


def flatten_response(df: DataFrame, column: str = "value", tags=WATER_TAGS, tag_key: str = "waterway", bbox: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Ways of landed responses with one of the tags and two points or more: ``waterway, osm_id, name, geom``; with ``bbox`` (south, west, north,
    east) those with a point in it."""
    e = df.select(F.explode(F.from_json(column, f"struct<{RESPONSE}>")["elements"]).alias("e")).where("e.type = 'way'").where(F.size("e.geometry") >= 2)
    tag = F.element_at("e.tags", F.lit(tag_key))
    geom = F.transform("e.geometry", lambda p: F.struct(p.lon.alias("x"), p.lat.alias("y")))
    out = e.select(tag.alias("waterway"), F.col("e.id").alias("osm_id"), F.element_at("e.tags", F.lit("name")).alias("name"), geom.alias("geom")).where(F.col("waterway").rlike(f"^({'|'.join(tags)})$"))
    if bbox:
        s, w, n, east = bbox
        out = out.where(F.exists("geom", lambda p: p.y.between(s, n) & p.x.between(w, east)))
    return out


def response_query(bbox: tuple[float, float, float, float], tags=WATER_TAGS, timeout: int = 60) -> str:
    s, w, n, e = bbox
    return f'[out:json][timeout:{timeout}];way["waterway"~"^({"|".join(tags)})$"]({s},{w},{n},{e});out geom;'


#: What requests call themselves.
AGENT = "thalweg"


def fetch_first(query: str, endpoints: list[str], timeout: int = 90, post=None) -> str:
    """The first endpoint's answer; an error that names all failures if none answers.  ``post(url, data, timeout)`` may stand in for
    the network."""
    if post is None:
        import urllib.request

        post = lambda url, data, t: urllib.request.urlopen(urllib.request.Request(url, data=data, headers={"User-Agent": AGENT}), timeout=t).read().decode()
    failures = []
    for url in endpoints:
        try:
            return post(url, query.encode(), timeout)
        except Exception as e:  # any failure leads to the next endpoint
            failures.append(f"{url}: {e}")
    raise ConnectionError("; ".join(failures) or "no endpoints")


def first_available(*sources, empty: DataFrame) -> DataFrame:
    """The first of several ways to get a table that works, or the empty table."""
    for source in sources:
        try:
            return source()
        except Exception:  # a source that is away
            continue
    return empty


def folder_table(spark: SparkSession, path: str) -> DataFrame:
    """``code, slug`` of the folders named code_slug."""
    names = [n for n in sorted(os.listdir(path)) if "_" in n and os.path.isdir(os.path.join(path, n))]
    return spark.createDataFrame([tuple(n.split("_", 1)) for n in names], "code string, slug string")


def one_area(boundaries: DataFrame, l1: str, l2: str, l3: str) -> DataFrame:
    """The one boundary of three names; an error when there is none or there are several.  The filters reach the scan."""
    found = boundaries.where((F.col("area_l1") == l1) & (F.col("area_l2") == l2) & (F.col("area_l3") == l3))
    n = found.limit(2).count()
    if n != 1:
        raise ValueError(f"{'no' if n == 0 else 'more than one'} area named {l3}, {l2}, {l1}")
    return found


def explode_hierarchy(df: DataFrame, column: str = "value") -> DataFrame:
    """``l1, l2, l3`` of a map of maps of arrays given as JSON text."""
    a = df.select(F.explode(F.from_json(column, "map<string,map<string,array<string>>>")).alias("l1", "m"))
    return a.select("l1", F.explode("m").alias("l2", "names")).select("l1", "l2", F.explode("names").alias("l3"))


def sample_raster(points: DataFrame, cells: DataFrame, west: float, north: float, res_x: float, res_y: float, nodata: float | None = None, x: str = "x", y: str = "y") -> DataFrame:
    """Points with the value of the raster cell they lie in; null outside, for no-data and for NaN."""
    at = points.withColumns({"_col": F.floor((F.col(x) - F.lit(west)) / F.lit(res_x)).cast("int"), "_row": F.floor((F.lit(north) - F.col(y)) / F.lit(res_y)).cast("int")})
    value = F.when(~F.isnan("elev") & ((F.col("elev") != nodata) if nodata is not None else F.lit(True)), F.col("elev"))
    c = cells.select(F.col("row").alias("_row"), F.col("col").alias("_col"), value.alias("elevation_m"))
    return at.join(c, ["_row", "_col"], "left").drop("_row", "_col")


REMOTE = "array<struct<feature_type:string,geom_geojson:string,source_attrs:map<string,string>>>"


def remote_rows(df: DataFrame, column: str = "value") -> DataFrame:
    """Answers of the bounding-box procedures, JSON text, to ``layer, attrs, geom``; shapes of one part only have a ``geom``.  Rows of a
    layer other than the two line layers are dropped; bodies come without a layer."""
    shape = "struct<type:string,coordinates:string>"
    r = df.select(F.explode(F.from_json(column, REMOTE)).alias("r")).select("r.*").withColumn("g", F.from_json("geom_geojson", shape))
    line, lines = F.from_json("g.coordinates", f"array<{PAIR}>"), F.from_json("g.coordinates", f"array<array<{PAIR}>>")
    areas = F.from_json("g.coordinates", f"array<array<array<{PAIR}>>>")
    one = lambda parts: F.when(F.size(parts) == 1, parts[0])
    ring = F.when(F.col("g.type") == "LineString", line).when(F.col("g.type") == "MultiLineString", one(lines)).when(F.col("g.type") == "Polygon", lines[0]).when(F.col("g.type") == "MultiPolygon", one(areas)[0])
    out = r.select(F.coalesce("feature_type", F.lit("water_body")).alias("layer"), F.col("source_attrs").alias("attrs"), F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))).alias("geom"))
    return out.where(F.col("layer").isin("major_river", "minor_stream", "water_body"))


def fetch_in_bbox(spark: SparkSession, names: list[str], bbox: tuple[float, float, float, float], post) -> DataFrame:
    """Rows of remote bounding-box procedures for (south, west, north, east); ``post(name, body)`` gives the answer's text.  Errors go up, so
    that :func:`first_available` can turn to files."""
    body = json.dumps(dict(zip(("p_south", "p_west", "p_north", "p_east"), bbox)))
    return remote_rows(spark.createDataFrame([(post(n, body),) for n in names], "value string"))


def bbox_of(lines: DataFrame, lon: str = "x", lat: str = "y", margin: float = 0.0) -> tuple[float, float, float, float]:
    """South, west, north, east of the vertices, with a margin."""
    p = lines.select(F.explode("geom").alias("p")).agg(F.min(f"p.{lat}"), F.min(f"p.{lon}"), F.max(f"p.{lat}"), F.max(f"p.{lon}")).first()
    return p[0] - margin, p[1] - margin, p[2] + margin, p[3] + margin


def unmatched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of left whose key is not in right, for a report."""
    return left.join(right.select(key), key, "left_anti").select(*left.columns)


def dump_features(df: DataFrame, path: str) -> int:
    """Writes features as lines of JSON and returns their number; none is worth a warning, not an error."""
    import warnings

    from thalweg.storage import materialize_told

    rows, told = materialize_told(geojson_lines(df), "features", n=F.count(F.lit(1)))
    rows.write.text(path)
    if not told.get("n"):
        warnings.warn(f"no features written to {path}", stacklevel=2)
    return told.get("n", 0)
