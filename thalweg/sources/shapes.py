"""Shapefiles as a table: ``spark.read.format("shapes").option("path", ...).load()`` after :func:`register`.

Columns are those of the attribute file, as text, then ``parts`` (the vertex arrays of a shape) and ``srid``.  Records are read in
slices by the index file, equality filters on attributes are applied to a record before its shape is decoded.  Text is read in the
``encoding`` given (utf-8); where no projection file lies beside, ``srid`` is the one given (4326).
"""

from __future__ import annotations

import os
import re
import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from thalweg.functions import geometry as G

POINT = StructType([StructField("x", DoubleType()), StructField("y", DoubleType())])
#: Records of a slice.
SLICE = 100_000
# Fixed values of the format: kinds of shapes with vertex arrays (plain, with z, with m) and points.
LINES, POINTS = (3, 5, 13, 15, 23, 25), (1, 11, 21)


def _attributes(path: str) -> tuple[int, int, list[tuple[str, int, int]]]:
    """Size of the head, of a record, and ``name, start, length`` of the fields."""
    with open(path, "rb") as f:
        head, size = struct.unpack_from("<8xHH", f.read(32))
        fields, at = [], 1
        for raw in iter(lambda: f.read(32), b""):
            if raw[0] == 0x0D:
                break
            fields.append((raw[:11].split(b"\0")[0].decode("ascii", "replace"), at, raw[16]))
            at += raw[16]
    return head, size, fields


def _srid(base: str, default: int) -> int:
    if not os.path.exists(base + ".prj"):
        return default
    with open(base + ".prj", encoding="utf-8", errors="replace") as f:
        text = f.read()
    zone = re.search(r"UTM_Zone_(\d+)([NS])", text)
    return (32600 if zone[2] == "N" else 32700) + int(zone[1]) if zone else 4326


def _parts(body: bytes) -> list[list[tuple[float, float]]] | None:
    kind = struct.unpack_from("<i", body)[0] if len(body) >= 4 else 0
    if kind in POINTS:
        return [[struct.unpack_from("<2d", body, 4)]]
    if kind not in LINES:
        return None
    n_parts, n = struct.unpack_from("<2i", body, 36)
    starts = [*struct.unpack_from(f"<{n_parts}i", body, 44), n]
    flat = struct.unpack_from(f"<{2 * n}d", body, 44 + 4 * n_parts)
    return [list(zip(flat[2 * a : 2 * b : 2], flat[2 * a + 1 : 2 * b : 2])) for a, b in zip(starts, starts[1:])]


class _Slice(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class ShapeReader(DataSourceReader):
    def __init__(self, base: str, encoding: str, srid: int, names: list[str]):
        self.base, self.encoding, self.srid, self.names = base, encoding, srid, names
        self.wanted: dict[str, str] = {}

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in self.names and isinstance(f.value, str):
                self.wanted[f.attribute[0]] = f.value
            yield f  # trailing blanks are cut here, so Spark looks again

    def partitions(self):
        n = (os.path.getsize(self.base + ".shx") - 100) // 8
        return [_Slice(k, min(n, k + SLICE)) for k in range(0, n, SLICE)]

    def read(self, partition):
        head, size, fields = _attributes(self.base + ".dbf")
        with open(self.base + ".dbf", "rb") as dbf, open(self.base + ".shp", "rb") as shp, open(self.base + ".shx", "rb") as shx:
            shx.seek(100 + 8 * partition.first)
            places = struct.iter_unpack(">2i", shx.read(8 * (partition.last - partition.first)))
            dbf.seek(head + size * partition.first)
            for at, words in places:
                raw = dbf.read(size)
                if raw[:1] == b"*":  # deleted
                    continue
                values = [raw[a : a + n].rstrip(b" \0").decode(self.encoding, "replace").strip() or None for _, a, n in fields]
                if any(values[self.names.index(k)] != v for k, v in self.wanted.items()):
                    continue
                shp.seek(2 * at + 8)
                yield (*values, _parts(shp.read(2 * words)), self.srid)


class Shapes(DataSource):
    @classmethod
    def name(cls):
        return "shapes"

    def _base(self):
        return re.sub(r"\.(shp|dbf|shx)$", "", self.options["path"])

    def _names(self):
        return [n for n, _, _ in _attributes(self._base() + ".dbf")[2]]

    def schema(self):
        text = [StructField(n, StringType()) for n in self._names()]
        return StructType([*text, StructField("parts", ArrayType(ArrayType(POINT))), StructField("srid", IntegerType())])

    def reader(self, schema):
        o = self.options
        return ShapeReader(self._base(), o.get("encoding", "utf-8"), _srid(self._base(), int(o.get("srid", 4326))), self._names())


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Shapes)


def read_shapes(spark: SparkSession, path: str, encoding: str = "utf-8", srid: int = 4326) -> DataFrame:
    """A shapefile with ``geom``, the vertices of its one part (null where a shape has several), beside ``parts``."""
    register(spark)
    rows = spark.read.format("shapes").option("path", path).option("encoding", encoding).option("srid", srid).load()
    return rows.withColumn("geom", G.single_part(F.col("parts")))
