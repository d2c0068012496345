"""Elevation rasters: georeferenced TIFF files to blocks, and the cells under points.

A file is parted into its strips or tiles, which stay packed; only the blocks that hold a point are unpacked.  Each file keeps its own
header, so a mosaic may mix resolutions, packings and coordinate systems, and files may overlap.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thalweg.functions import geometry as G
from thalweg.storage import materialize

# Fixed values of the format: tags, and how their values are stored.
WIDTH, HEIGHT, BITS, PACKING, OFFSETS, ROWS, COUNTS, PREDICTOR, FORM = 256, 257, 258, 259, 273, 278, 279, 317, 339
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325
SCALE, ORIGIN, KEYS, NODATA = 33550, 33922, 34735, 42113
TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 12: "d"}
GEOGRAPHIC, PROJECTED = 2048, 3072
BLOCKS = "path string, block int, srid int, west double, north double, res_x double, res_y double, nodata double, row0 int, col0 int, height int, width int, stride int, form string, packing int, data binary"
CELLS = "path string, row int, col int, elev double"


def _header(data: bytes) -> dict[int, tuple]:
    order = {b"II": "<", b"MM": ">"}[data[:2]]
    at = struct.unpack_from(order + "I", data, 4)[0]
    tags = {0: (order,)}
    for k in range(struct.unpack_from(order + "H", data, at)[0]):
        tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        if kind in TYPES:
            form, own = f"{order}{n}{TYPES[kind]}", at + 10 + 12 * k
            tags[tag] = struct.unpack_from(form, data, own if struct.calcsize(form) <= 4 else struct.unpack_from(order + "I", data, own)[0])
    return tags


def blocks_of(data: bytes):
    """Header ``srid, west, north, res_x, res_y, nodata`` of a raster of one band, and its blocks: ``row0, col0, height, width, stride, form, packing,
    data``, the cells of the raster in them, the cells of a stored row, and how samples are stored."""
    tags = _header(data)
    one = lambda t, d: tags.get(t, (d,))[0]
    kind = np.dtype({1: "u", 2: "i", 3: "f"}[one(FORM, 1)] + str(one(BITS, 8) // 8)).newbyteorder(tags[0][0])
    packing, predictor = one(PACKING, 1), one(PREDICTOR, 1)
    if packing not in (1, 8, 32946) or predictor not in (1, 2) or predictor == 2 and kind.kind == "f":
        raise ValueError("rasters must be plain or deflated, with no or the horizontal predictor")
    keys = dict(zip(tags.get(KEYS, ())[4::4], tags.get(KEYS, ())[7::4]))
    scale, tie = tags[SCALE], tags[ORIGIN]
    nodata = float(b"".join(tags[NODATA]).split(b"\0")[0]) if NODATA in tags else None
    head = (keys.get(PROJECTED) or keys.get(GEOGRAPHIC) or 4326, tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1], scale[0], scale[1], nodata)
    rows, columns = tags[HEIGHT][0], tags[WIDTH][0]
    tiled = TILE_WIDTH in tags
    wide, high = (tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0]) if tiled else (columns, min(rows, one(ROWS, rows)))
    across = -(-columns // wide)
    stored = tags[TILE_OFFSETS if tiled else OFFSETS], tags[TILE_COUNTS if tiled else COUNTS]
    out = []
    for k, (at, n) in enumerate(zip(*stored)):
        row0, col0 = k // across * high, k % across * wide
        if row0 < rows and n:
            out.append((row0, col0, min(high, rows - row0), min(wide, columns - col0), wide, kind.str + ("p" if predictor == 2 else ""), packing, data[at : at + n]))
    return head, out


def unpack(height: int, width: int, stride: int, form: str, packing: int, data: bytes) -> np.ndarray:
    """The cells of a block."""
    kind = np.dtype(form.rstrip("p"))
    raw = data if packing == 1 else zlib.decompress(data)
    cells = np.frombuffer(raw[: height * stride * kind.itemsize], kind).reshape(height, stride)
    if form.endswith("p"):
        cells = np.cumsum(cells, axis=1, dtype=kind.newbyteorder("="))
    return cells[:, :width].astype(float)


def read_rasters(spark: SparkSession, path: str) -> DataFrame:
    """A row for each strip or tile of each raster file, packed as it lies there, with the file's header.  Files are read by Spark, so any store
    that it reaches will do; one file is parted in one task."""

    names = [c.split()[0] for c in BLOCKS.split(", ")]
    types = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}
    kinds = [types[c.split()[1]] for c in BLOCKS.split(", ")]

    def run(batches):
        for b in batches:
            for name, data in zip(b.column(0), b.column(1)):
                head, blocks = blocks_of(data.as_py())
                for k, block in enumerate(blocks):
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((name.as_py(), k, *head, *block), kinds)], names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, BLOCKS)


def cells_of(blocks: DataFrame) -> DataFrame:
    """A row for each cell of blocks."""

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                cells = unpack(*(r[c] for c in ("height", "width", "stride", "form", "packing", "data")))
                row, col = np.indices(cells.shape, np.int32).reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array([r["path"]] * cells.size), pa.array(row + np.int32(r["row0"])), pa.array(col + np.int32(r["col0"])), pa.array(cells.ravel())], ["path", "row", "col", "elev"])

    return blocks.select("path", "row0", "col0", "height", "width", "stride", "form", "packing", "data").mapInArrow(run, CELLS)


def sample_elevation(nodes: DataFrame, blocks: DataFrame, srid: int = 32647) -> DataFrame:
    """``node_id, elevation_m`` of nodes ``(node_id, x, y)`` in metres of the zone ``srid``: the cell under each, in whatever system a raster is
    (degrees or a zone; an error for others).  Null outside all rasters, for no-data and for NaN; where rasters overlap, the first by path
    that has a value counts.  Nodes with a null coordinate have none.

    Points and blocks meet in squares as wide as the widest block, and only blocks with a point are unpacked."""
    blocks = materialize(blocks, "blocks")
    place = blocks.drop("data", "form", "packing", "stride")
    east = lambda c: F.col("west") + F.col("res_x") * c
    north = lambda c: F.col("north") - F.col("res_y") * c
    box = place.withColumns({"x0": east(F.col("col0")), "x1": east(F.col("col0") + F.col("width")), "y1": north(F.col("row0")), "y0": north(F.col("row0") + F.col("height"))})
    systems = {r.srid: r.side for r in box.groupBy("srid").agg(F.max(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).alias("side")).collect()}
    spots = None
    for own in sorted(systems):
        x, y = G.moved(F.col("x"), F.col("y"), srid, own)
        part = nodes.where("x is not null and y is not null").select("node_id", F.lit(own).alias("srid"), x.alias("px"), y.alias("py"))
        spots = part if spots is None else spots.unionByName(part)
    if spots is None:
        return nodes.select("node_id", F.lit(None).cast("double").alias("elevation_m"))
    side = F.element_at(F.create_map(*[F.lit(v) for kv in systems.items() for v in kv]), F.col("srid"))
    cell = lambda c: F.floor(F.col(c) / side).cast("long")
    held = box.withColumn("cx", F.explode(F.sequence(cell("x0"), cell("x1")))).withColumn("cy", F.explode(F.sequence(cell("y0"), cell("y1"))))
    met = spots.withColumns({"cx": cell("px"), "cy": cell("py")}).join(held, ["srid", "cx", "cy"])
    met = met.withColumns({"row": F.floor((F.col("north") - F.col("py")) / F.col("res_y")).cast("int"), "col": F.floor((F.col("px") - F.col("west")) / F.col("res_x")).cast("int")})
    met = met.where("row >= row0 and row < row0 + height and col >= col0 and col < col0 + width")
    met = materialize(met.select("node_id", "path", "block", "row", "col", "nodata"), "met")
    touched = blocks.join(met.select("path", "block").distinct(), ["path", "block"], "left_semi")
    value = met.join(cells_of(touched), ["path", "row", "col"]).where("not isnan(elev) and (nodata is null or elev <> nodata)")
    found = value.groupBy("node_id").agg(F.min(F.struct("path", "elev")).alias("v")).select("node_id", F.col("v.elev").alias("elevation_m"))
    return nodes.select("node_id").join(found, "node_id", "left")
