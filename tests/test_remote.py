"""Remote stores and map services, with a stub server of our own."""

import json
import re
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from thalweg.sources import documents as W
from thalweg.sources import remote
from thalweg.sources.responses import fetch_ways


@pytest.fixture
def served():
    """Starts servers for ``answer(path, text)`` that gives a status and a text; returns their addresses."""
    running = []

    def start(answer):
        class Handler(BaseHTTPRequestHandler):
            def do_POST(self):
                status, text = answer(self.path, self.rfile.read(int(self.headers["Content-Length"])).decode(), self.headers)
                self.send_response(status)
                self.end_headers()
                self.wfile.write(text.encode())

            def log_message(self, *a):
                pass

        running.append(HTTPServer(("127.0.0.1", 0), Handler))
        threading.Thread(target=running[-1].serve_forever, daemon=True).start()
        return f"http://127.0.0.1:{running[-1].server_port}"

    yield start
    for server in running:
        server.shutdown()


class Store:
    """Staged rows by version, part and attempt; what was committed; what is visible."""

    def __init__(self, refuse=None):
        self.staged, self.committed, self.visible, self.aborted, self.refuse = {}, {}, {}, [], refuse

    def __call__(self, path, text, headers):
        body = json.loads(text)
        key = (body["version"], body.get("part"))
        if headers["Authorization"] != "Bearer t" or self.refuse and self.refuse(path, body):
            return 403, ""
        if path == "/stage":
            self.staged.setdefault(key, {}).setdefault(body["attempt"], []).extend(body["rows"])
        elif path == "/commit":
            rows = [r for a in body["attempts"] for r in self.staged[key][a]]
            assert len(rows) == body["rows"]
            self.committed[key] = rows
        elif path == "/abort":
            self.staged.pop(key, None)
            self.aborted.append(key)
        elif path == "/publish":
            self.visible[body["p_tambon_id"]] = body["version"]
        return 200, ""


def diagram(spark, n):
    nodes = spark.range(n).select(F.concat(F.lit("n"), "id").alias("node_key"), F.col("id").cast("double").alias("pos_x"), F.array("id").alias("more")).repartition(5)
    edges = spark.range(n - 1).select(F.concat(F.lit("e"), "id").alias("edge_key"), F.concat(F.lit("n"), "id").alias("source_node_key"), F.concat(F.lit("n"), F.col("id") + 1).alias("target_node_key"))
    return nodes, edges


def test_a_diagram_in_many_requests(spark, served, monkeypatch):
    store = Store()
    version = remote.send_diagram(*diagram(spark, 3000), served(store), "area", token="t")
    assert store.visible == {"area": version} and not store.aborted
    assert sorted(r["node_key"] for r in store.committed[version, "nodes"]) == sorted(f"n{i}" for i in range(3000))
    assert len(store.committed[version, "edges"]) == 2999 and store.committed[version, "nodes"][0]["more"] is not None
    assert all(len(v) <= 3000 for v in store.staged[version, "nodes"].values()) and len(store.staged[version, "nodes"]) > 1


def test_a_broken_write_leaves_nothing(spark, served):
    nodes, edges = diagram(spark, 2000)
    store = Store()
    address = served(store)
    broken = edges.withColumn("edge_key", F.when(F.col("edge_key") == "e1500", F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("edge_key")))
    with pytest.raises(Exception):
        remote.send_diagram(nodes, broken, address, "area", token="t")
    assert store.visible == {} and [p for _, p in store.aborted] == ["edges"] and [p for _, p in store.committed] == ["nodes"]
    refusing = Store(lambda path, body: path == "/stage" and body["part"] == "nodes" and any(r["node_key"] == "n7" for r in body["rows"]))
    with pytest.raises(Exception):
        remote.send_diagram(nodes, edges, served(refusing), "area", token="t")
    assert refusing.visible == {} == refusing.committed
    with pytest.raises(Exception):
        remote.send_rows(nodes, address, "v", "nodes")  # no token
    empty = Store()
    remote.send_rows(nodes.limit(0), served(empty), "v", "nodes", "t")
    assert empty.committed == {("v", "nodes"): []}


#: Ways of a made-up map: id, tag, points as (lat, lon).
MAP = [(1, "river", [(0.5, 0.5), (0.6, 0.6)]), (2, "canal", [(0.5, 1.9), (0.5, 2.1), (0.5, 3.9)]), (3, "river", [(2.0, 2.0), (2.1, 2.0)]), (4, "canal", [(9.0, 9.0), (4.0, 4.0), (3.9, 3.9)]), (5, "river", [(-1.0, 0.0), (-1.0, 3.0)]), (6, "pipe", [(1.0, 1.0), (1.1, 1.1)]), (7, "stream", [(1.0, 3.0)]), (8, "drain", [(4.0, 0.0), (3.0, 0.0)])]


def test_ways_of_tiles_come_once(spark, served):
    asked = []

    def answer(path, query, headers):
        s, w, n, e = map(float, re.search(r"\(([-0-9.,e]+)\);out", query)[1].split(","))
        tags = re.search(r"\^\((.*)\)\$", query)[1].split("|")
        asked.append(((s, w, n, e), tuple(tags)))
        out = []
        for i, tag, points in MAP:
            box = [min(p[0] for p in points), min(p[1] for p in points), max(p[0] for p in points), max(p[1] for p in points)]
            if tag in tags and box[0] <= n and box[2] >= s and box[1] <= e and box[3] >= w:
                out.append({"type": "way", "id": i, "tags": {"waterway": tag, "name": f"w{i}"}, "geometry": [{"lat": a, "lon": b} for a, b in points]})
        return 200, json.dumps({"elements": out})

    address = served(answer)
    for tiles in (1, 2, 4):
        ways = fetch_ways(spark, [address], (0.0, 0.0, 4.0, 4.0), tiles)
        got = ways.collect()
        assert sorted(r.osm_id for r in got) == [1, 2, 3, 4, 8] and {r.osm_id: (r.lat, r.lon) for r in got}[4] == (4.0, 4.0)
        assert {r.osm_id: len(r.geom) for r in got}[4] == 3
    asked.clear()
    got = fetch_ways(spark, [address], (0.0, 0.0, 4.0, 4.0), 2).where("waterway = 'river' and lon >= 1.5 and lat < 3").select("osm_id", "name").collect()
    assert [tuple(r) for r in got] == [(3, "w3")]
    assert {t for _, t in asked} == {("river",)} and min(b[1] for b, _ in asked) == 1.5 and max(b[2] for b, _ in asked) == 3.0 and len(asked) == 4
    asked.clear()
    assert fetch_ways(spark, [address], (0.0, 0.0, 4.0, 4.0)).where("lon > 5").collect() == [] == asked
    assert fetch_ways(spark, [address], (0.0, 0.0, 4.0, 4.0)).where("waterway in ('canal', 'drain')").count() == 3


def test_scripts_of_partitions(spark, tmp_path):
    df = spark.createDataFrame([('{"data":{"id":"a","label":"x]; y"}}',), (None,), ('{"data":{"id":"b"}}',), ('{"data":{"id":"e","source":"a","target":"b"}}',)], "value string")
    for n, rows in ((1, df), (3, df), (2, df.limit(0))):
        path = str(tmp_path / f"s{n}")
        W.write_scripts(rows.repartition(n), path, "elements", "made")
        nodes, edges = W.split_elements(W.read_scripts(spark, path))
        assert {r.node_key for r in nodes.collect()} == ({"a", "b"} if n < 2 or n == 3 else set())
        assert edges.count() == (0 if n == 2 else 1)


def test_scripts_of_a_large_partition(spark, tmp_path, monkeypatch):
    """Files are of bounded size, whatever the partition; an element longer than that has a file of its own."""
    monkeypatch.setattr(W, "SCRIPT", 2_000)
    df = spark.range(500).selectExpr("""concat('{"data":{"id":"n', id, '","label":"', repeat('x', if(id = 7, 3000, 10)), '"}}') as value""").coalesce(1)
    for packed, suffix in ((None, ".txt"), ("gzip", ".txt.gz")):
        path = tmp_path / f"s{packed}"
        W.write_scripts(df, str(path), "elements", "made", compression=packed)
        files = list(path.glob(f"part-*{suffix}"))
        texts = [r.value for r in spark.read.text(str(path), wholetext=True).collect()]
        assert len(files) == len(texts) > 10 and sorted(map(len, texts))[-2] < 2_100
        nodes, edges = W.split_elements(W.read_scripts(spark, str(path)))
        assert {r.node_key for r in nodes.collect()} == {f"n{k}" for k in range(500)} and nodes.count() == 500 and edges.count() == 0
