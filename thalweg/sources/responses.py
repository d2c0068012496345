"""Map responses as tables: one partition per bounding box, each the answer of the first endpoint that gives one.

``map_responses`` gives the answers as they come, ``map_ways`` the ways of one box, which is cut into tiles that are asked for in
parallel; filters on the tag and on the place reach the question.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from thalweg.sources.documents import WATER_TAGS, fetch_first, response_query


class _Box(InputPartition):
    def __init__(self, box):
        self.box = box


class ResponseReader(DataSourceReader):
    def __init__(self, endpoints: list[str], boxes: list[tuple], tags: tuple[str, ...], timeout: int):
        self.endpoints, self.boxes, self.tags, self.timeout = endpoints, boxes, tags, timeout

    def partitions(self):
        return [_Box(tuple(b)) for b in self.boxes]

    def read(self, partition):
        yield (fetch_first(response_query(partition.box, self.tags), self.endpoints, self.timeout),)


class Responses(DataSource):
    """Options, each JSON text: ``endpoints``, ``boxes`` (south, west, north, east) and, if wanted, ``tags``; ``timeout`` in seconds."""

    @classmethod
    def name(cls):
        return "map_responses"

    def schema(self):
        return "value string"

    def reader(self, schema):
        o = self.options
        return ResponseReader(json.loads(o["endpoints"]), json.loads(o["boxes"]), tuple(json.loads(o.get("tags", json.dumps(WATER_TAGS)))), int(o.get("timeout", 90)))


def fetch_responses(spark: SparkSession, endpoints: list[str], boxes: list[tuple[float, float, float, float]], **options) -> DataFrame:
    """``value``: the response for each box, for :func:`thalweg.sources.documents.flatten_response`."""
    spark.dataSource.register(Responses)
    reader = spark.read.format("map_responses").option("endpoints", json.dumps(endpoints)).option("boxes", json.dumps(boxes))
    return reader.options(**options).load()


WAYS = "waterway string, osm_id long, name string, lon double, lat double, geom array<struct<x: double, y: double>>"


class WayReader(DataSourceReader):
    """Ways with a point in the box.  ``lon, lat``: the first such point; the tile that holds it gives the way, so ways over the borders of tiles
    come once."""

    def __init__(self, endpoints: list[str], box: tuple, tiles: int, tags: tuple[str, ...], key: str, timeout: int):
        self.endpoints, self.box, self.tiles, self.tags, self.key, self.timeout = endpoints, tuple(map(float, box)), tiles, tags, key, timeout
        self.narrow = list(self.box)

    def pushFilters(self, filters):
        south, west, north, east = 0, 1, 2, 3
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("waterway",):
                wanted = f.value if isinstance(f, In) else (f.value,)
                self.tags = tuple(t for t in self.tags if t in wanted)
            elif getattr(f, "attribute", None) in (("lon",), ("lat",)) and isinstance(getattr(f, "value", None), (int, float)):
                low, high = (west, east) if f.attribute == ("lon",) else (south, north)
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.narrow[low] = max(self.narrow[low], f.value)
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    self.narrow[high] = min(self.narrow[high], f.value)
            yield f  # ends of ranges are not exact here, so Spark looks again

    def partitions(self):
        s, w, n, e = self.narrow
        if not self.tags or s > n or w > e:
            return []
        cut = lambda a, b: [a + (b - a) * k / self.tiles for k in range(self.tiles)] + [b]
        rows, columns = cut(s, n), cut(w, e)
        return [_Box((a, c, b, d, b == n, d == e)) for a, b in zip(rows, rows[1:]) for c, d in zip(columns, columns[1:])]

    def read(self, partition):
        if partition is None:  # nothing to ask for
            return
        s, w, n, e, top, right = partition.box
        answer = json.loads(fetch_first(response_query((s, w, n, e), self.tags), self.endpoints, self.timeout))
        inside = lambda p: self.box[0] <= p["lat"] <= self.box[2] and self.box[1] <= p["lon"] <= self.box[3]
        for way in answer.get("elements") or ():
            points, tags = way.get("geometry") or [], way.get("tags") or {}
            first = next(filter(inside, points), None)
            if way.get("type") != "way" or len(points) < 2 or tags.get(self.key) not in self.tags or first is None:
                continue
            x, y = first["lon"], first["lat"]
            if s <= y and (y < n or top and y == n) and w <= x and (x < e or right and x == e):
                yield tags[self.key], way["id"], tags.get("name"), float(x), float(y), [(float(p["lon"]), float(p["lat"])) for p in points]


class Ways(DataSource):
    """Options, JSON text: ``endpoints``, ``box`` (south, west, north, east) and, if wanted, ``tags``; ``tiles`` a side (1), ``timeout`` in seconds."""

    @classmethod
    def name(cls):
        return "map_ways"

    def schema(self):
        return WAYS

    def reader(self, schema):
        o = self.options
        return WayReader(json.loads(o["endpoints"]), json.loads(o["box"]), int(o.get("tiles", 1)), tuple(json.loads(o.get("tags", json.dumps(WATER_TAGS)))), "waterway", int(o.get("timeout", 90)))


def fetch_ways(spark: SparkSession, endpoints: list[str], box: tuple[float, float, float, float], tiles: int = 1, **options) -> DataFrame:
    """``waterway, osm_id, name, lon, lat, geom`` of the ways with a point in the box."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Ways)
    return spark.read.format("map_ways").option("endpoints", json.dumps(endpoints)).option("box", json.dumps(box)).option("tiles", tiles).options(**options).load()
