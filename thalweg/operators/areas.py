"""Places and lines in many areas at once; areas have any number of parts and holes.

Each area is covered by square cells of its own size.  Cells that no edge passes are inside or outside as a whole, which a
scan along the rows of cells tells; points in the others are compared with the edges of that cell only: the cell's lower left corner
is inside or not, and each edge crossed on the way from there to the point turns that over.  No area is ever one row with all its
edges, and none is compared with a point outside its cells.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from thalweg.operators.spatial import near_keys
from thalweg.storage import materialize, materialize_told

#: Cells along the longer side of an area: twice the root of its number of edges, within these ends.
FEWEST, MOST = 8, 256


def edges_of(areas: DataFrame, key: str = "area_id", rings: str = "rings") -> DataFrame:
    """``key, seg, x1, y1, x2, y2`` of all rings, closed or not; edges without length, or with an end that is no finite number, are
    left out.  Rows with one key make one area."""
    ring = areas.where(F.col(key).isNotNull()).select(key, F.posexplode(rings).alias("_r", "_g")).where("size(_g) >= 2")
    shifted = F.concat(F.slice("_g", F.lit(2), F.size("_g") - 1), F.slice("_g", 1, 1))
    each = ring.select(key, "_r", F.posexplode(F.arrays_zip(F.col("_g").alias("p"), shifted.alias("q"))).alias("_s", "e"))
    out = each.select(key, F.struct("_r", "_s").alias("seg"), *[F.col(f"e.{e}.{c}").cast("double").alias(f"{c}{n}") for n, e in ((1, "p"), (2, "q")) for c in "xy"])
    for c in ("x1", "y1", "x2", "y2"):
        out = out.where(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return out.where("x1 <> x2 or y1 <> y2")


def _cell(x: Column | str, level: Column | str) -> Column:
    return F.floor((F.col(x) if isinstance(x, str) else x) / F.pow(F.lit(2.0), level)).cast("long")


#: Edges run upwards, level ones to the right.  ``{0}`` is whether a place is left of the edge; a place on the edge counts as moved right by
#: much less than anything, and up by much less than that.
_LEFT = "((x2 - x1) * ({y} - y1) - (y2 - y1) * ({x} - x1) > 0 or ((x2 - x1) * ({y} - y1) - (y2 - y1) * ({x} - x1) = 0 and y1 = y2))"


def _left(x: str, y: str) -> str:
    return _LEFT.format(x=x, y=y)


def cover(areas: DataFrame, key: str = "area_id", rings: str = "rings") -> tuple[DataFrame, DataFrame, list[int]]:
    """Cells ``key, level, cx, cy, border, odd`` of the areas, the edges ``key, level, cx, cy, x1, y1, x2, y2`` in those at the border, and
    the levels in use: a cell of level n has a side of 2**n.  ``odd``: whether the lower left corner is inside."""
    up = F.expr("y1 < y2 or (y1 = y2 and x1 < x2)")
    ends = {f"{c}{n}": F.when(up, F.col(f"{c}{n}")).otherwise(F.col(f"{c}{3 - n}")) for n in (1, 2) for c in "xy"}
    edges = edges_of(areas, key, rings).withColumns(ends).drop("seg")
    wide = F.greatest(F.max(F.greatest("x1", "x2")) - F.min(F.least("x1", "x2")), F.max("y2") - F.min("y1"))
    many = F.greatest(F.lit(FEWEST), F.least(F.lit(MOST), 2 * F.sqrt(F.count("*"))))
    levels = edges.groupBy(key).agg(F.ceil(F.log2(wide / many)).cast("int").alias("level"))
    edges = materialize(edges.join(levels, key), "area-edges")
    used = [r.level for r in edges.select("level").distinct().collect()]  # exponents of two

    side = F.pow(F.lit(2.0), "level")
    across = edges.withColumn("cx", F.explode(F.sequence(_cell(F.least("x1", "x2"), "level"), _cell(F.greatest("x1", "x2"), "level"))))
    # the part of an edge over its column of cells, a little wider
    upright = F.col("x1") == F.col("x2")
    at = lambda x: F.when(~upright, F.least("y2", F.greatest("y1", F.col("y1") + (x - F.col("x1")) * ((F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1"))))))
    a, b = at(F.col("cx") * side), at((F.col("cx") + 1) * side)
    low, high = F.when(upright, F.col("y1")).otherwise(F.least(a, b)), F.when(upright, F.col("y2")).otherwise(F.greatest(a, b))
    cells = across.withColumn("cy", F.explode(F.sequence(_cell(low - side * 1e-6, "level"), _cell(high + side * 1e-6, "level"))))
    place = [key, "level", "cx", "cy"]
    at_border = materialize(cells.select(*place, "x1", "y1", "x2", "y2"), "area-border")

    # edges that pass the lower lines of rows of cells
    first, last = F.ceil(F.col("y1") / side).cast("long"), F.ceil(F.col("y2") / side).cast("long") - 1
    passing = edges.where(first <= last).withColumn("cy", F.explode(F.sequence(first, last))).withColumn("y", F.col("cy") * side)
    passing = materialize(passing, "area-rows")
    corners = at_border.select(*place).distinct()
    right = passing.join(corners, [key, "level", "cy"]).where(_left("cx * pow(2.0d, level)", "y"))
    counted = right.groupBy(*place).agg((F.count("*") % 2 == 1).alias("odd"))
    border = corners.join(counted, place, "left").select(*place, F.lit(True).alias("border"), F.coalesce("odd", F.lit(False)).alias("odd"))

    # between an odd crossing of a row and the next one lies the inside
    row = Window.partitionBy(key, "level", "cy").orderBy("x")
    crossed = passing.withColumn("x", F.col("x1") + (F.col("y") - F.col("y1")) * ((F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))))
    spans = crossed.withColumns({"k": F.row_number().over(row), "to": F.lead("x").over(row)}).where("k % 2 = 1 and to is not null")
    first, last = F.ceil(F.col("x") / side - 1e-6).cast("long"), F.floor(F.col("to") / side - 1e-6).cast("long")
    inner = spans.where(first <= last).select(key, "level", F.explode(F.sequence(first, last)).alias("cx"), "cy").distinct()
    inner = inner.join(corners, place, "left_anti").select(*place, F.lit(False).alias("border"), F.lit(True).alias("odd"))
    return materialize(border.unionByName(inner), "area-cells"), at_border, used


#: Points of one cell that are held at once; the points of a cell with more are dealt into slices.
SLICE = 1 << 15
#: Points compared with edges at once.
BLOCK = 1 << 20
_EDGE = ("x1", "y1", "x2", "y2")


def _turned(x, y, cx, cy, x1, y1, x2, y2) -> tuple[np.ndarray, np.ndarray]:
    """For each edge (rows) and point (columns): whether the way from the cell's corner to the point crosses the edge an odd number of times,
    and whether the point is on the edge.  No edge (nan) is never crossed."""
    dx, dy = x2 - x1, y2 - y1
    level = y1 == y2

    def left(px, py):
        side = dx * (py - y1) - dy * (px - x1)
        return (side > 0) | ((side == 0) & level)

    # from the corner along the lower side to below the point, then up to it
    below = left(x, cy)
    along = (y1 <= cy) & (y2 > cy) & (left(cx, cy) != below)
    rising = ((x1 > x) != (x2 > x)) & (below != left(x, y))
    on = (dx * (y - y1) == dy * (x - x1)) & (x >= np.minimum(x1, x2)) & (x <= np.maximum(x1, x2)) & (y >= y1) & (y <= y2)
    return along ^ rising, on


def _told(batches, point: str, key: str, block: int):
    """Sorted rows of cells, in each the points first and then the areas' rows by area, to ``point, key`` of the points inside.  The points of a cell
    and slice are held, areas pass by; of an area whose rows go on in the next batch only what is known so far of each point."""
    place, lefts, spots, area = None, [], None, None

    def done():
        """The points in the area that is over."""
        at = np.flatnonzero(area[1] | area[2])
        if len(at):
            yield pa.RecordBatch.from_arrays([spots[0].take(pa.array(at)), pa.repeat(area[0], len(at))], [point, key])

    for b in batches:
        cols = [b.column(c).to_numpy(zero_copy_only=False) for c in ("level", "cx", "cy", "_part", "_right")]
        change = np.zeros(max(len(b) - 1, 0), bool)
        for c in cols:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), len(b)]
        for s, e in zip(cuts, cuts[1:]) if len(b) else ():
            here = tuple(int(c[s]) for c in cols[:4])
            if here != place:
                if area is not None:
                    yield from done()
                place, lefts, spots, area = here, [], None, None
            rows = b.slice(s, e - s)
            if not cols[4][s]:
                lefts.append(rows)
                continue
            if not lefts:
                continue
            if spots is None:
                held = pa.Table.from_batches(lefts).combine_chunks()
                spots = held.column(point).combine_chunks(), held.column("_x").to_numpy(), held.column("_y").to_numpy()
            n = len(spots[1])
            cx, cy = here[1] * 2.0 ** here[0], here[2] * 2.0 ** here[0]
            names, odd = rows.column(key), rows.column("odd").to_numpy(zero_copy_only=False).astype(bool)
            ends = [rows.column(c).to_numpy(zero_copy_only=False).astype(float) for c in _EDGE]
            same = pc.equal(names.slice(1), names.slice(0, len(names) - 1)).to_numpy(zero_copy_only=False)
            step = max(1, block // n)
            for k in range(0, len(rows), step):
                m = min(step, len(rows) - k)
                turned, on = _turned(spots[1], spots[2], cx, cy, *(v[k : k + m, None] for v in ends))
                turned ^= odd[k : k + m, None]
                starts = np.flatnonzero(np.r_[True, ~same[k : k + m - 1]])
                turned, on = np.logical_xor.reduceat(turned, starts, axis=0), np.logical_or.reduceat(on, starts, axis=0)
                first = names[k]
                if area is not None and area[0].equals(first):
                    turned[0] ^= area[1]
                    on[0] |= area[2]
                elif area is not None:
                    yield from done()
                # all but the last area are over
                a, p = np.nonzero(turned[:-1] | on[:-1])
                if len(a):
                    yield pa.RecordBatch.from_arrays([spots[0].take(pa.array(p)), names.take(pa.array(starts[a] + k))], [point, key])
                area = names[int(starts[-1]) + k], turned[-1].copy(), on[-1].copy()
    if area is not None:
        yield from done()


def points_in_areas(points: DataFrame, areas: DataFrame, point_key: str = "point_id", key: str = "area_id", rings: str = "rings") -> DataFrame:
    """``point_key, key`` of the points ``(x, y)`` in areas, borders included, once each.  A place is inside where it is within an odd number of
    an area's rings.  Points with a null key or a coordinate that is no finite number, and areas without edges, give no rows.

    Points and the cells of areas are shuffled, pairs are not: they are made cell by cell in numpy, and a place lies in one cell of an area.
    Only those of keys that have several places are put together."""
    cells, edges, levels = cover(areas, key, rings)
    if not levels:
        return points.select(point_key).limit(0).join(areas.select(key).limit(0))
    finite = points.where(F.col(point_key).isNotNull() & (F.abs(F.col("x").cast("double")) < float("inf")) & (F.abs(F.col("y").cast("double")) < float("inf")))
    places = finite.groupBy(F.col(point_key).alias("_p"), F.col("x").cast("double").alias("_x"), F.col("y").cast("double").alias("_y")).agg(F.lit(1).alias("one"))
    repeated = materialize(places.groupBy("_p").agg(F.count("*").alias("n")).where("n > 1").select("_p"), "repeated-points")
    around = F.array(*[F.lit(n) for n in sorted(levels)])
    spots = places.drop("one").withColumn("level", F.explode(around)).withColumns({"cx": _cell("_x", "level"), "cy": _cell("_y", "level")})
    spots = materialize(spots, "spots")
    place = ["level", "cx", "cy"]
    busy = materialize(spots.groupBy(*place).agg(F.ceil(F.count("*") / SLICE).cast("int").alias("parts")).where("parts > 1"), "busy-cells")
    dealt = spots.join(busy, place, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64("_p", "_x", "_y"), F.col("parts")), F.lit(0)).cast("int"))
    none = {c: F.lit(None).cast("double") for c in _EDGE}
    rows = cells.select(*place, key, "odd", *[c.alias(n) for n, c in none.items()]).unionByName(edges.select(*place, key, F.lit(False).alias("odd"), *_EDGE))
    rows = rows.join(busy, place, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    both = dealt.select(*place, "_part", "_p", "_x", "_y", F.lit(False).alias("_right")).unionByName(rows.select(*place, "_part", key, "odd", *_EDGE, F.lit(True).alias("_right")), allowMissingColumns=True)
    # few bytes make much work here, so the number of tasks is not left to bytes
    spark = points.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    met = both.repartition(tasks, *place, "_part").sortWithinPartitions(*place, "_part", "_right", key)
    schema = StructType([both.schema["_p"], both.schema[key]])
    block = BLOCK
    found = met.mapInArrow(lambda batches: _told(batches, "_p", key, block), schema)
    if not repeated.isEmpty():
        found = materialize(found, "points-in-areas")
        several = found.join(repeated, "_p", "left_semi").distinct()
        found = found.join(repeated, "_p", "left_anti").unionByName(several)
    return found.withColumnRenamed("_p", point_key)


def shapes(areas: DataFrame, key: str = "area_id", rings: str = "rings") -> tuple[DataFrame, DataFrame | None]:
    """Areas ``key, rings`` without those that are another one over again, and ``_shape, key``: which of them each area is; None if each is itself.
    Areas of several rows are not compared."""
    areas = areas.where(F.col(key).isNotNull()).select(key, rings)
    several = materialize(areas.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key), "several-rows")
    alike = Window.partitionBy(F.xxhash64(rings), rings)
    first = areas.join(several, key, "left_anti").withColumn("_shape", F.min(key).over(alike))
    one, told = materialize_told(first.select("_shape", key, F.when(F.col("_shape") == F.col(key), F.col(rings)).alias(rings)), "shapes", again=F.count_if(F.col("_shape") != F.col(key)))
    if not told.get("again"):
        return areas, None
    rest = areas.join(several, key, "left_semi")
    own = one.where(F.col("_shape") == F.col(key)).select(key, rings).unionByName(rest)
    # a table, so that its size is known: a small one is sent to the pairs, others meet them by a shuffle
    return own, materialize(one.select("_shape", key).unionByName(several.select(F.col(key).alias("_shape"), key)), "shape-of")


def lines_in_areas(segs: DataFrame, areas: DataFrame, within: float = 0.0, line_key: str = "line_id", key: str = "area_id", rings: str = "rings") -> DataFrame:
    """``line_key, key`` of the lines (a segment table) that come ``within`` a distance of areas or lie in them, once each: lines that come that
    near to an edge, and lines whose first place is inside.  Areas with the same rings are compared once, and their rows are made at the end; what
    is shuffled are the pairs of lines and different areas."""
    own, members = shapes(areas, key, rings)
    starts = segs.groupBy(line_key).agg(F.min(F.struct("seg", "x1", "y1")).alias("s")).select(line_key, F.col("s.x1").alias("x"), F.col("s.y1").alias("y"))
    inside = points_in_areas(starts, own, line_key, key, rings)
    near = near_keys(segs, edges_of(own, key, rings), within, line_key, key)
    pairs = inside.unionByName(near).distinct()
    if members is None:
        return pairs
    return pairs.withColumnRenamed(key, "_shape").join(members, "_shape").select(line_key, key)
