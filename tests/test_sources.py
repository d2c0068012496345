"""Shapefiles, rasters, remote rows, edits, publishing and the run for one area, on made files."""

import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from thalweg.functions import geometry as G
from thalweg.operators import diagrams as D
from thalweg.plans import pipeline as P
from thalweg.sources import documents as W
from thalweg.sources import rasters, shapes, versions


def write_shapes(base, rows, fields, kind=3, encoding="utf-8", prj=None):
    """rows: (attributes, parts)."""
    records = []
    for _, parts in rows:
        points = [p for part in parts for p in part]
        starts = [sum(len(x) for x in parts[:k]) for k in range(len(parts))]
        xs, ys = [p[0] for p in points], [p[1] for p in points]
        records.append(struct.pack("<i4d2i", kind, min(xs), min(ys), max(xs), max(ys), len(parts), len(points)) + struct.pack(f"<{len(parts)}i", *starts) + struct.pack(f"<{2 * len(points)}d", *[v for p in points for v in p]))
    head = lambda n: struct.pack(">i5i i", 9994, 0, 0, 0, 0, 0, n // 2) + struct.pack("<2i8d", 1000, kind, *[0.0] * 8)
    body, index, at = b"", b"", 100
    for k, r in enumerate(records):
        body += struct.pack(">2i", k + 1, len(r) // 2) + r
        index += struct.pack(">2i", at // 2, len(r) // 2)
        at += 8 + len(r)
    (base.parent / (base.name + ".shp")).write_bytes(head(100 + len(body)) + body)
    (base.parent / (base.name + ".shx")).write_bytes(head(100 + len(index)) + index)
    size = 1 + sum(n for _, n in fields)
    table = struct.pack("<4BIHH20x", 3, 126, 1, 1, len(rows), 33 + 32 * len(fields), size)
    for name, n in fields:
        table += name.encode().ljust(11, b"\0") + b"C" + bytes(4) + bytes((n, 0)) + bytes(14)
    table += b"\r" + b"".join(b" " + b"".join(v.encode(encoding).ljust(n) for v, (_, n) in zip(values, fields)) for values, _ in rows)
    (base.parent / (base.name + ".dbf")).write_bytes(table)
    if prj:
        (base.parent / (base.name + ".prj")).write_text(prj)
    return str(base) + ".shp"


def test_shapefile(spark, tmp_path, monkeypatch):
    rows = [(("ก", f"t{k}"), [[(k, 0.0), (k, 1.0), (k + 0.5, 2.0)]] if k != 3 else [[(0.0, 0.0), (1.0, 1.0)], [(2.0, 2.0), (3.0, 3.0)]]) for k in range(7)]
    monkeypatch.setattr(shapes, "SLICE", 2)
    path = write_shapes(tmp_path / "lines", rows, [("P_NAME_T", 12), ("T_NAME_T", 8)])
    df = shapes.read_shapes(spark, path)
    got = {r.T_NAME_T: r for r in df.collect()}
    assert len(got) == 7 and {r.srid for r in got.values()} == {4326} and {r.P_NAME_T for r in got.values()} == {"ก"}
    assert [(p.x, p.y) for p in got["t2"].geom] == [(2.0, 0.0), (2.0, 1.0), (2.5, 2.0)] and got["t3"].geom is None and len(got["t3"].parts) == 2
    one = df.where((F.col("P_NAME_T") == "ก") & (F.col("T_NAME_T") == "t5"))
    assert [r.T_NAME_T for r in one.collect()] == ["t5"]
    reader = shapes.Shapes({"path": path}).reader(None)
    from pyspark.sql.datasource import EqualTo

    list(reader.pushFilters([EqualTo(("T_NAME_T",), "t5")]))
    assert [r[1] for p in reader.partitions() for r in reader.read(p)] == ["t5"]
    thai = write_shapes(tmp_path / "area", [(("น้ำ",), [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]])], [("N", 9)], kind=5, encoding="cp874", prj='PROJCS["WGS_1984_UTM_Zone_47N"]')
    (row,) = shapes.read_shapes(spark, thai, encoding="cp874").collect()
    assert row.N == "น้ำ" and row.srid == 32647 and len(row.geom) == 4


def write_raster(path, cells, west, north, res, epsg=4326, nodata=None, packed=False):
    body = b"".join(struct.pack(f"<{len(r)}f", *r) for r in cells)
    body = zlib.compress(body) if packed else body
    extra = struct.pack("<3d", res, res, 0.0) + struct.pack("<6d", 0, 0, 0, west, north, 0) + struct.pack("<8H", 1, 1, 0, 1, 2048 if epsg == 4326 else 3072, 0, 1, epsg)
    at = 8 + len(body)
    tags = [(256, 4, 1, len(cells[0])), (257, 4, 1, len(cells)), (258, 3, 1, 32), (259, 3, 1, 8 if packed else 1), (273, 4, 1, 8), (278, 4, 1, len(cells)), (279, 4, 1, len(body)), (339, 3, 1, 3), (33550, 12, 3, at), (33922, 12, 6, at + 24), (34735, 3, 8, at + 72)]
    if nodata is not None:
        text = str(nodata).encode() + b"\0"
        tags.append((42113, 2, len(text), at + 88))
        extra += text
    entries = b"".join(struct.pack("<HHI", t, k, n) + (struct.pack("<HH", v, 0) if k == 3 and n == 1 else struct.pack("<I", v)) for t, k, n, v in tags)
    path.write_bytes(struct.pack("<2sHI", b"II", 42, at + len(extra)) + body + extra + struct.pack("<H", len(tags)) + entries + bytes(4))


def test_rasters(spark, tmp_path):
    (tmp_path / "deg").mkdir()
    write_raster(tmp_path / "deg/a.tif", [[1.0, 2.0], [3.0, -9999.0]], 100.0, 17.0, 0.1, nodata=-9999)
    write_raster(tmp_path / "deg/b.tif", [[5.0, float("nan")]], 100.2, 17.0, 0.1, nodata=-9999, packed=True)
    places = {1: (100.05, 16.95), 2: (100.15, 16.95), 3: (100.05, 16.85), 4: (100.15, 16.85), 5: (100.25, 16.99), 6: (100.35, 16.99), 7: (99.9, 16.95)}
    east, north = G.project(F.col("lon"), F.col("lat"))
    nodes = spark.createDataFrame([(k, *p) for k, p in places.items()], "node_id long, lon double, lat double").select("node_id", east.alias("x"), north.alias("y"))
    blocks = rasters.read_rasters(spark, str(tmp_path / "deg/*.tif"))
    got = {r.node_id: r.elevation_m for r in rasters.sample_elevation(nodes, blocks).collect()}
    assert got == {1: 1.0, 2: 2.0, 3: 3.0, 4: None, 5: 5.0, 6: None, 7: None}
    write_raster(tmp_path / "m.tif", [[7.0, 8.0]], 600000.0, 1800000.0, 100.0, epsg=32647)
    flat = spark.createDataFrame([(1, 600050.0, 1799950.0), (2, 600150.0, 1799950.0), (3, 600250.0, 1799950.0)], "node_id long, x double, y double")
    assert {r.node_id: r.elevation_m for r in rasters.sample_elevation(flat, rasters.read_rasters(spark, str(tmp_path / "m.tif"))).collect()} == {1: 7.0, 2: 8.0, 3: None}
    assert {r.elevation_m for r in rasters.sample_elevation(flat, blocks.limit(0)).collect()} == {None}


def test_tiles_zones_and_overlaps(spark, tmp_path):
    """Two files share a row of cells, one has another resolution, one another zone, and one is of no known system."""
    (tmp_path / "m").mkdir()
    write_raster(tmp_path / "m/a.tif", [[1.0, 2.0], [3.0, -9999.0]], 600000.0, 1800000.0, 100.0, epsg=32647, nodata=-9999)
    write_raster(tmp_path / "m/b.tif", [[30.0, 40.0], [50.0, 60.0]], 600000.0, 1799900.0, 100.0, epsg=32647)
    write_raster(tmp_path / "m/c.tif", [[70.0] * 10] * 10, 600200.0, 1800000.0, 10.0, epsg=32647, packed=True)
    east, north = G.project(F.lit(103.0), F.lit(15.0), 32648)
    other = spark.range(1).select(east.alias("x"), north.alias("y")).first()
    write_raster(tmp_path / "m/d.tif", [[5.0]], other.x - 50, other.y + 50, 100.0, epsg=32648)
    far = spark.range(1).select(*[c.alias(n) for n, c in zip("xy", G.project(F.lit(103.0), F.lit(15.0), 32647))]).first()
    places = {1: (600050.0, 1799950.0), 2: (600050.0, 1799850.0), 3: (600150.0, 1799850.0), 4: (600250.0, 1799950.0), 5: (600150.0, 1799750.0), 6: (far.x, far.y), 7: (0.0, 0.0)}
    nodes = spark.createDataFrame([(k, *p) for k, p in places.items()] + [(8, None, 1.0)], "node_id long, x double, y double")
    blocks = rasters.read_rasters(spark, str(tmp_path / "m/*.tif"))
    got = [tuple(r) for r in rasters.sample_elevation(nodes, blocks).collect()]
    assert sorted(got) == [(1, 1.0), (2, 3.0), (3, 40.0), (4, 70.0), (5, 60.0), (6, 5.0), (7, None), (8, None)]
    write_raster(tmp_path / "m/e.tif", [[1.0]], 0.0, 0.0, 1.0, epsg=24047)
    with pytest.raises(ValueError):
        rasters.sample_elevation(nodes, rasters.read_rasters(spark, str(tmp_path / "m/*.tif")))


def test_few_blocks_of_a_large_raster_are_unpacked(spark, tmp_path, monkeypatch):
    """A raster of tiles with a few points: only their tiles are unpacked."""
    side, tile = 1000, 100
    tiles = [zlib.compress(b"".join(struct.pack("<100h", *[r * tile + k] + [1] * 99) for r in range(tile))) for k in range(100)]
    body, places = b"", []
    for t in tiles:
        places.append(8 + len(body))
        body += t
    extra = struct.pack("<100I", *places) + struct.pack("<100I", *map(len, tiles)) + struct.pack("<3d", 1, 1, 0) + struct.pack("<6d", 0, 0, 0, 0, 0, 0) + struct.pack("<8H", 1, 1, 0, 1, 3072, 0, 1, 32647)
    at = 8 + len(body)
    tags = [(256, 4, 1, side), (257, 4, 1, side), (258, 3, 1, 16), (259, 3, 1, 8), (317, 3, 1, 2), (322, 4, 1, tile), (323, 4, 1, tile), (324, 4, 100, at), (325, 4, 100, at + 400), (339, 3, 1, 2), (33550, 12, 3, at + 800), (33922, 12, 6, at + 824), (34735, 3, 8, at + 872)]
    entries = b"".join(struct.pack("<HHI", t, k, n) + (struct.pack("<HH", v, 0) if k == 3 and n == 1 else struct.pack("<I", v)) for t, k, n, v in tags)
    (tmp_path / "t.tif").write_bytes(struct.pack("<2sHI", b"II", 42, at + len(extra)) + body + extra + struct.pack("<H", len(tags)) + entries + bytes(4))
    blocks = rasters.read_rasters(spark, str(tmp_path / "t.tif"))
    assert blocks.count() == 100
    spots = [(0.5, -0.5), (150.5, -250.5), (999.5, -999.5), (151.5, -250.5)]
    seen = []
    monkeypatch.setattr(rasters, "cells_of", lambda b, f=rasters.cells_of: (seen.append(b.count()), f(b))[1])
    got = sorted(tuple(r) for r in rasters.sample_elevation(spark.createDataFrame([(i, *p) for i, p in enumerate(spots)], "node_id long, x double, y double"), blocks).collect())
    value = lambda x, y: (int(-y) % tile) * tile + (int(-y) // tile) * 10 + int(x) // tile + int(x) % tile
    assert seen == [3] and got == [(i, float(value(*p))) for i, p in enumerate(spots)]


def test_lines_of_other_systems_and_several_parts(spark):
    point = lambda c: F.struct(*[v.alias(n) for n, v in zip("xy", c)])
    row = spark.range(1).select(F.array(point(G.project(F.lit(102.0), F.lit(14.0), 32648)), point(G.project(F.lit(102.1), F.lit(14.1), 32648))).alias("geom"), F.array(point(G.project(F.lit(102.0), F.lit(14.0))), point(G.project(F.lit(102.1), F.lit(14.1)))).alias("want"))
    rows = row.withColumn("srid", F.lit(32648)).unionByName(row.withColumn("geom", F.col("want")).withColumn("srid", F.lit(32647)))
    rows = rows.unionByName(row.withColumn("geom", F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in ((102.0, 14.0), (102.1, 14.1))])).withColumn("srid", F.lit(4326)))
    moved = P.in_metres(rows).collect()
    # the other zone's series is used some 3 degrees from its middle
    assert all(abs(p[c] - q[c]) < 0.01 for r in moved for p, q in zip(r.geom, r.want) for c in "xy") and {r.srid for r in moved} == {32647}
    south = spark.range(1).select(*[c.alias(n) for n, c in zip("xy", G.moved(*G.project(F.lit(30.0), F.lit(-20.0), 32735), 32735, 4326))]).first()
    assert abs(south.x - 30.0) < 1e-8 and abs(south.y + 20.0) < 1e-8
    for odd in (24047, 32661, None):
        with pytest.raises(ValueError):
            P.in_metres(rows.withColumn("srid", F.lit(odd).cast("int")))
    shape = [[(0.0, 0.0), (1.0, 0.0)], [(5.0, 5.0), (6.0, 6.0), (7.0, 7.0)]]
    parts = spark.createDataFrame([(4, shape, "a"), (9, shape[:1], "b"), (2, None, "c"), (3, shape[::-1], "d")], "line_id long, parts array<array<struct<x:double,y:double>>>, name string")
    got = {(r.line_id, r.name, len(r.geom)) for r in P.part_lines(parts).collect()}
    assert got == {(4, "a", 2), (11, "a", 3), (9, "b", 2), (3, "d", 3), (10, "d", 2)}


def test_clip_by_an_area_with_a_hole(spark):
    ring = lambda a, b: [(a, a), (b, a), (b, b), (a, b)]
    area = spark.createDataFrame([([ring(0.0, 10_000.0), ring(2_000.0, 8_000.0), ring(20_000.0, 21_000.0)],)], "rings array<array<struct<x:double,y:double>>>")
    lines = [(1, [(500.0, 500.0), (600.0, 600.0)]), (2, [(5_000.0, 5_000.0), (5_100.0, 5_100.0)]), (3, [(2_200.0, 5_000.0), (4_000.0, 5_000.0)]), (4, [(20_500.0, 20_500.0), (20_600.0, 20_500.0)]), (5, [(15_000.0, 0.0), (15_000.0, 1.0)])]
    got = P.clipped(spark.createDataFrame(lines, "line_id long, geom array<struct<x:double,y:double>>"), area)
    assert {r.line_id for r in got.collect()} == {1, 3, 4}


def test_remote_rows_and_files_after(spark):
    def post(name, body):
        assert json.loads(body) == {"p_south": 1.0, "p_west": 2.0, "p_north": 3.0, "p_east": 4.0}
        geo = lambda kind, c: json.dumps({"type": kind, "coordinates": c})
        if name == "bodies":
            return json.dumps([{"geom_geojson": geo("MultiPolygon", [[[[0, 0], [1, 0], [0, 0]]]]), "source_attrs": None}])
        lines = [("major_river", "MultiLineString", [[[0, 1], [2, 3]]]), ("minor_stream", "LineString", [[5, 6], [7, 8]]), ("dam", "LineString", [[5, 6], [7, 8]]), ("minor_stream", "MultiLineString", [[[0, 1], [2, 3]], [[4, 5], [6, 7]]])]
        return json.dumps([{"feature_type": t, "geom_geojson": geo(k, c), "source_attrs": {"HY_LNAME": "x"}} for t, k, c in lines])

    got = sorted((r.layer, r.attrs and r.attrs["HY_LNAME"], r.geom and [(p.x, p.y) for p in r.geom]) for r in W.fetch_in_bbox(spark, ["lines", "bodies"], (1.0, 2.0, 3.0, 4.0), post).collect() if r.geom)
    assert got == [("major_river", "x", [(0, 1), (2, 3)]), ("minor_stream", "x", [(5, 6), (7, 8)]), ("water_body", None, [(0, 0), (1, 0), (0, 0)])]
    files = spark.createDataFrame([("major_river",)], "layer string")
    away = lambda: W.fetch_in_bbox(spark, ["x"], (0.0, 0.0, 0.0, 0.0), lambda *a: 1 / 0)
    assert W.first_available(away, lambda: files, empty=files.limit(0)).collect() == files.collect()


def test_reports_and_dumps(spark, tmp_path):
    a, b = spark.createDataFrame([("x", 1), ("y", 2)], "slug string, k int"), spark.createDataFrame([("x",)], "slug string")
    assert [tuple(r) for r in W.unmatched(a, b, "slug").collect()] == [("y", 2)]
    for n in ("01_x", "02_y_z", "plain"):
        (tmp_path / n).mkdir()
    assert [tuple(r) for r in W.folder_table(spark, str(tmp_path)).collect()] == [("01", "x"), ("02", "y_z")]
    lines = spark.createDataFrame([(1, [(0.0, 0.0), (1.0, 1.0)])], "id long, geom array<struct<x:double,y:double>>")
    assert W.dump_features(lines, str(tmp_path / "one")) == 1 and json.loads(spark.read.text(str(tmp_path / "one")).first()[0])["properties"] == {"id": 1}
    with pytest.warns(UserWarning):
        assert W.dump_features(lines.limit(0), str(tmp_path / "none")) == 0
    W.write_script(str(tmp_path / "e.js"), "engineElements", [{"data": {"id": "น1"}}])
    text = spark.read.text(str(tmp_path / "e.js"), wholetext=True).select(W.unwrap_script(F.col("value")).alias("elements"))
    assert W.split_elements(text)[0].first().node_key == "น1"


def test_edits(spark):
    nodes = spark.createDataFrame([("n1", "weir", "a", 0, "h", 1.0, 1.0, "7"), ("n2", None, "", 0, "h", 2.0, 2.0, "")], "node_key string, node_type string, label string, rotation int, dir string, pos_x double, pos_y double, source_ref string")
    fresh = spark.createDataFrame([("n3", "gate", 3.0, 3.0, None), ("t1", "text_box", 4.0, 4.0, "hi"), ("t2", "text_box", 4.0, 4.0, "")], "node_key string, node_type string, pos_x double, pos_y double, label string")
    more = D.insert_nodes(nodes, fresh)
    assert {r.node_key: r.label for r in more.collect()} == {"n1": "a", "n2": "", "n3": "ปตร.", "t1": "hi"}
    edges = spark.createDataFrame([("e1", "n1", "n2", "x", "main")], "edge_key string, source_node_key string, target_node_key string, label string, edge_type string")
    new = spark.createDataFrame([("e2", "n2", "n3", "branch"), ("e3", "n2", "n2", "main"), ("e4", "n2", "gone", "main")], "edge_key string, source_node_key string, target_node_key string, edge_type string")
    drawn = D.draw_edges(edges, more, new)
    assert {r.edge_key: (r.label, r.edge_type) for r in drawn.collect()} == {"e1": ("x", "main"), "e2": ("คลองใหม่", "branch")}
    moves = spark.createDataFrame([("n1", 1, 8.0, 8.0), ("n1", 2, 9.0, 7.0), ("zz", 1, 0.0, 0.0)], "node_key string, seq long, pos_x double, pos_y double")
    moved = D.move_nodes(more, moves)
    assert moved.columns == more.columns and {r.node_key: (r.pos_x, r.pos_y) for r in moved.collect()}["n1"] == (9.0, 7.0) and moved.count() == 4
    back = W.split_elements(D.export_elements(moved, drawn).select(F.concat(F.lit("["), "value", F.lit("]")).alias("elements")))
    assert {(r.node_key, r.node_type, r.pos_x) for r in back[0].collect()} == {("n1", "weir", 9.0), ("n2", None, 2.0), ("n3", "gate", 3.0), ("t1", "text_box", 4.0)}
    assert {(r.edge_key, r.source_node_key, r.edge_type) for r in back[1].collect()} == {("e1", "n1", "main"), ("e2", "n2", "branch")}
    assert tuple(D.linked(nodes).first()) == (2, 1)


def test_publish_is_all_or_nothing(spark, tmp_path):
    nodes, edges = spark.createDataFrame([("n1", 1.0)], "node_key string, pos_x double"), spark.createDataFrame([], "edge_key string, source_node_key string, target_node_key string")
    root = str(tmp_path / "store")
    with pytest.raises(PermissionError):
        versions.publish(nodes, edges, root, "area", "community", password="no", secret="yes")
    first = versions.publish(nodes, edges, root, "area", "community", password="yes", secret="yes")
    broken = edges.withColumn("edge_key", F.raise_error(F.lit("lost")).cast("string")).unionByName(spark.createDataFrame([("e", "n1", "n1")], edges.schema).withColumn("edge_key", F.expr("raise_error('lost')").cast("string")))
    with pytest.raises(Exception):
        versions.publish(nodes, broken, root, "area", "engine")
    n, e = versions.current(spark, root, "area")
    assert {r.version_id for r in n.collect()} == {first} and e.count() == 0
    assert versions.shown(n, e) == (n, e)
    with pytest.raises(ValueError):
        versions.shown(n.limit(0), e)
    with pytest.raises(ValueError):
        versions.current(spark, root, "elsewhere")
    sent = []
    assert versions.send_version(nodes, edges, "a", "l", "me", lambda body: sent.append(json.loads(body)) or 200) and not versions.send_version(nodes, edges, "a", "l", "me", lambda body: 300)
    assert sent[0]["p_nodes"] == [{"node_key": "n1", "pos_x": 1.0}] and sent[0]["p_edges"] == []


def test_run_for_one_area(spark, tmp_path):
    """Boundary by names, degrees to metres, clip, network, elevation, schematic, version."""
    lon, lat = (lambda e: 99.0 + (e - 500000.0) / 106_000.0), (lambda n: 17.0 + n / 110_650.0)
    at = lambda *points: [(lon(500000.0 + x), lat(y)) for x, y in points]
    shape = "geom array<struct<x:double,y:double>>, srid int"
    areas = spark.createDataFrame([("พิษณุโลก", "เมือง", "ก", at((0, 0), (2000, 0), (2000, 2000), (0, 2000), (0, 0)), 4326), ("พิษณุโลก", "เมือง", "ข", at((9000, 0), (9999, 0), (9000, 9), (9000, 0)), 4326)], f"area_l1 string, area_l2 string, area_l3 string, {shape}")
    primary = spark.createDataFrame([(1, "primary", "river", "main", at((500, -200), (500, 1000), (510, 1900)), 4326), (2, "primary", "canal", None, at((500, 1000), (1500, 1000)), 4326), (3, "primary", "canal", "far", at((8000, 0), (8000, 900)), 4326)], f"line_id long, source string, tag string, name string, {shape}")
    supplement = spark.createDataFrame([(11, "supplement", "major_river", None, at((1500, 1000), (1500, 1900)), 4326, "major_river")], f"line_id long, source string, tag string, name string, {shape}, layer string")
    write_raster(tmp_path / "dem.tif", [[30.0 - r] * 12 for r in range(12)], 98.98, 17.04, 0.005)
    out = P.run_area(areas, ("จังหวัดพิษณุโลก".replace("จังหวัด", ""), "อำเภอเมือง", "ต.ก"), primary, supplement, rasters.read_rasters(spark, str(tmp_path / "dem.tif")), str(tmp_path / "store"), "area-1")
    edges = out["edges"].collect()
    assert sorted((e.source, e.tag, e.name) for e in edges) == [("primary", "canal", None), ("primary", "river", "main"), ("primary", "river", "main"), ("supplement", "major_river", None)]
    assert out["nodes"].count() == 5 and tuple(out["known_elevations"].first()) == (5, 5)
    nodes, shown = versions.current(spark, str(tmp_path / "store"), "area-1")
    assert nodes.count() == 5 and shown.count() == 4 and {r.version_id for r in nodes.collect()} == {out["version"]}
    with pytest.raises(ValueError):
        P.run_area(areas, ("พิษณุโลก", "เมือง", "ค"), primary, supplement)


def test_responses_by_box(spark):
    """The first endpoint refuses, the second answers, one partition for each box."""
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from thalweg.sources.responses import fetch_responses

    class Answer(BaseHTTPRequestHandler):
        def do_POST(self):
            query = self.rfile.read(int(self.headers["Content-Length"])).decode()
            good = self.path == "/good" and self.headers["User-Agent"] == W.AGENT
            self.send_response(200 if good else 503)
            self.end_headers()
            way = {"type": "way", "id": int(query.split("](")[1].split(".")[0]), "tags": {"waterway": "canal"}, "geometry": [{"lat": 1.0, "lon": 2.0}, {"lat": 1.5, "lon": 2.5}]}
            self.wfile.write(json.dumps({"elements": [way]}).encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    raw = fetch_responses(spark, [f"{base}/bad", f"{base}/good"], [(1.0, 2.0, 3.0, 4.0), (5.0, 6.0, 7.0, 8.0)], timeout=20)
    assert raw.rdd.getNumPartitions() == 2 and sorted(r.osm_id for r in W.flatten_response(raw).collect()) == [1, 5]
    server.shutdown()


def test_names_and_quotes(spark):
    from thalweg.functions import text as T

    row = spark.range(1).select(T.quoted(F.lit("o'k")).alias("a"), T.title(F.lit("x"), F.lit(""), F.lit("y"), fallback=F.lit("z")).alias("b"), T.title(F.lit(""), fallback=F.lit("z")).alias("c")).first()
    assert tuple(row) == ("o''k", "x y", "z")
    assert P.admin_text(" อ. เมือง ") == "เมือง" and P.admin_text("จังหวัดตาก") == "จังหวัดตาก"
