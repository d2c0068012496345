"""Distance joins over segments and points, by squares of a quadtree or cells of a grid instead of nested loops."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from thalweg.functions import kernels as K
from thalweg.operators import noding, quadtree
from thalweg.operators.components import connected_components
from thalweg.operators.skew import salted_join
from thalweg.storage import materialize


def segments(lines: DataFrame, key: str, geom: str = "geom", *keep: str) -> DataFrame:
    """``key, seg, x1, y1, x2, y2`` (and ``keep``) of polylines given as vertex arrays."""
    points = lines.select(key, *keep, F.size(geom).alias("_n"), F.col(geom).alias("_g")).where("_n >= 2")
    pairs = points.select(key, *keep, F.posexplode(F.arrays_zip(F.slice("_g", F.lit(1), F.col("_n") - 1).alias("p"), F.slice("_g", F.lit(2), F.col("_n") - 1).alias("q"))).alias("seg", "_s"))
    return pairs.select(key, *keep, "seg", F.col("_s.p.x").alias("x1"), F.col("_s.p.y").alias("y1"), F.col("_s.q.x").alias("x2"), F.col("_s.q.y").alias("y2"))


def near_segments(left: DataFrame, right: DataFrame, reach: float, before: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of segments at most ``reach`` apart, once each: all columns of left, those of right with ``o_`` before the name, and
    ``gap2``, the squared distance.  Two segments may share many squares; the pair is taken in the one where the left segment is
    met, so nothing is shuffled to remove repeats.  Pairs are made in numpy, from the rows of a square; only those that are near become
    rows.  ``before``: columns, in order, by which the left row comes before the right one.  Segments with a null or non-finite end meet
    nothing."""
    mine, others = list(left.columns), [f"o_{c}" for c in right.columns]
    rows, tree = quadtree.meet(left, right, reach)

    def work(square, b):
        ends = [b.column(f"o_{c}").to_numpy() for c in quadtree._ENDS]
        for i, j in quadtree.near_boxes(square.ends, ends, reach + tree.slack):
            if before:
                first, same = None, None
                for c in before:
                    p, q = square.rows.column(c).take(pa.array(i)), b.column(f"o_{c}").take(pa.array(j))
                    less = pc.less(p, q) if same is None else pc.and_(same, pc.less(p, q))
                    first = less if first is None else pc.or_(first, less)
                    same = pc.equal(p, q) if same is None else pc.and_(same, pc.equal(p, q))
                kept = first.fill_null(False).to_numpy(zero_copy_only=False)
                i, j = i[kept], j[kept]
            own = [e[i] for e in square.ends]
            gap2, t = K.segment_gap(*own, *(e[j] for e in ends))
            x, y = own[0] + t * (own[2] - own[0]), own[1] + t * (own[3] - own[1])
            met = np.flatnonzero((gap2 <= reach * reach) & tree.holds(square.leaf, x, y))
            p, q = square.rows.take(pa.array(i[met])), b.select(others).take(pa.array(j[met]))
            yield pa.RecordBatch.from_arrays([*p.columns, *q.columns, pa.array(gap2[met])], [*mine, *others, "gap2"])

    schema = StructType([rows.schema[c] for c in (*mine, *others)]).add("gap2", "double")
    return rows.mapInArrow(lambda batches: quadtree.by_square(batches, mine, work), schema)


#: Pairs of keys that are held before repeated ones go.
KEYS = 1 << 20


def near_keys(left: DataFrame, right: DataFrame, reach: float, key: str, other: str) -> DataFrame:
    """``key, other`` of the segments of two tables at most ``reach`` apart, about once each square that both meet, however many segments of theirs
    are near."""
    rows, tree = quadtree.meet(left.select(key, *quadtree._ENDS), right.select(F.col(other).alias("key"), *quadtree._ENDS), reach)
    most = KEYS

    def work(square, b):
        if not square.notes:
            named = square.rows.column(key).dictionary_encode(null_encoding="encode")
            square.notes.update(at=named.indices.to_numpy().astype(np.int64), names=named.dictionary)
        mine, named = square.notes["at"], b.column("o_key").dictionary_encode(null_encoding="encode")
        theirs, n = named.indices.to_numpy().astype(np.int64), len(named.dictionary)
        ends = [b.column(f"o_{c}").to_numpy() for c in quadtree._ENDS]

        def batch(codes):
            return pa.RecordBatch.from_arrays([square.notes["names"].take(pa.array(codes // n)), named.dictionary.take(pa.array(codes % n))], [key, other])

        found = np.zeros(0, np.int64)
        for i, j in quadtree.near_boxes(square.ends, ends, reach + tree.slack):
            near = K.within(*(e[i] for e in square.ends), *(e[j] for e in ends), reach)
            found = np.unique(np.r_[found, mine[i[near]] * n + theirs[j[near]]])
            if len(found) > most:
                yield batch(found)
                found = found[:0]
        if len(found):
            yield batch(found)

    schema = StructType([rows.schema[key]]).add(other, rows.schema["o_key"].dataType)
    return rows.mapInArrow(lambda batches: quadtree.by_square(batches, [key, *quadtree._ENDS], work), schema)


def _merged(i: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of numbered segments, those that overlap put together."""
    if not len(i):
        return i, low, high
    order = np.lexsort((low, i))
    i, low, high = i[order], low[order], high[order]
    reached = np.maximum.accumulate(2.0 * i + high)
    starts = np.flatnonzero(np.r_[True, 2.0 * i[1:] + low[1:] > reached[:-1]])
    return i[starts], low[starts], np.maximum.reduceat(high, starts)


def _covered(lines: DataFrame, others: DataFrame, key: str, reach: float) -> DataFrame:
    """``key, seg, size, lo, hi``: ranges of segments within ``reach`` of the other ones.  Those of a square are put together where they are
    found, and a segment that is covered as a whole is compared no further."""
    size = F.sqrt((F.col("x2") - F.col("x1")) ** 2 + (F.col("y2") - F.col("y1")) ** 2)
    own = lines.select(key, "seg", size.alias("size"), "x1", "y1", "x2", "y2")
    names = own.columns
    rows, tree = quadtree.meet(own, others.select("x1", "y1", "x2", "y2"), reach)

    def work(square, b):
        ends = [b.column(f"o_{c}").to_numpy() for c in quadtree._ENDS]
        n = len(square.rows)
        for k in range(0, len(ends[0]), 256):
            i0, low, high = square.notes.get("ranges", (np.zeros(0, np.int64), np.zeros(0), np.zeros(0)))
            open_ = np.ones(n, bool)
            open_[i0[(low <= 0) & (high >= 1)]] = False
            left = np.flatnonzero(open_)
            if not len(left):
                return
            mine, other = [e[left] for e in square.ends], [e[k : k + 256] for e in ends]
            for i, j in quadtree.near_boxes(mine, other, reach + tree.slack):
                lo, hi = K.capsule_interval(*(e[i] for e in mine), *(e[j] for e in other), reach)
                some = hi > lo
                i0, low, high = _merged(np.r_[i0, left[i[some]]], np.r_[low, lo[some]], np.r_[high, hi[some]])
            square.notes["ranges"] = i0, low, high
        yield from ()

    def close(square):
        i, low, high = square.notes.get("ranges", ((), (), ()))
        if len(i):
            taken = square.rows.select([key, "seg", "size"]).take(pa.array(i))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(low), pa.array(high)], [key, "seg", "size", "lo", "hi"])

    schema = StructType([rows.schema[c] for c in (key, "seg", "size")]).add("lo", "double").add("hi", "double")
    return rows.mapInArrow(lambda batches: quadtree.by_square(batches, names, work, close), schema)


def coverage(lines: DataFrame, others: DataFrame, key: str, reach: float) -> DataFrame:
    """``key, length, fraction``: the share of each line's length within ``reach`` of the other lines.  Both sides are segment tables.
    Lines of no length, and lines with nothing near, have fraction 0."""
    spans = _covered(lines, others, key, reach)
    size = F.sqrt((F.col("x2") - F.col("x1")) ** 2 + (F.col("y2") - F.col("y1")) ** 2)
    ahead = F.max("hi").over(Window.partitionBy(key, "seg").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("fresh", F.greatest(F.lit(0.0), F.col("hi") - F.greatest(F.col("lo"), F.coalesce(ahead, F.lit(0.0)))))
    covered = spans.groupBy(key).agg(F.sum(F.col("fresh") * F.col("size")).alias("covered"))
    long = lines.groupBy(key).agg(F.sum(size).alias("length"))
    share = F.when(F.col("length") > 0, F.coalesce("covered", F.lit(0.0)) / F.col("length")).otherwise(F.lit(0.0))
    return long.join(covered, key, "left").select(key, "length", share.alias("fraction"))


def within_polygon(lines: DataFrame, ring: list[tuple[float, float]], buffer: float, key: str) -> DataFrame:
    """Keys of the lines (a segment table) that come within ``buffer`` of a polygon; whole lines stay, none is cut.  The ring is a
    parameter and travels as a literal."""
    corners = F.array(*[F.struct(*[F.lit(float(v)).alias(n) for v, n in zip((*p, *q), ("ax", "ay", "bx", "by"))]) for p, q in zip(ring, ring[1:] + ring[:1])])
    x1, y1, x2, y2 = map(F.col, ("x1", "y1", "x2", "y2"))

    def to_edge(px, py, ax, ay, bx, by):
        n = (bx - ax) * (bx - ax) + (by - ay) * (by - ay)
        t = F.when(n == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / n)))
        return F.hypot(px - ax - t * (bx - ax), py - ay - t * (by - ay))

    def side(ax, ay, bx, by, px, py):
        return F.signum((bx - ax) * (py - ay) - (by - ay) * (px - ax))

    def near(e):
        ends = F.least(to_edge(x1, y1, e.ax, e.ay, e.bx, e.by), to_edge(x2, y2, e.ax, e.ay, e.bx, e.by), to_edge(e.ax, e.ay, x1, y1, x2, y2), to_edge(e.bx, e.by, x1, y1, x2, y2))
        crossing = (side(x1, y1, x2, y2, e.ax, e.ay) * side(x1, y1, x2, y2, e.bx, e.by) < 0) & (side(e.ax, e.ay, e.bx, e.by, x1, y1) * side(e.ax, e.ay, e.bx, e.by, x2, y2) < 0)
        return crossing | (ends <= buffer)

    # a ray to the right of a segment's start crosses an odd number of edges if the start is inside
    passed = F.filter(corners, lambda e: ((e.ay > y1) != (e.by > y1)) & (x1 < (e.bx - e.ax) * (y1 - e.ay) / F.when(e.by == e.ay, F.lit(1.0)).otherwise(e.by - e.ay) + e.ax))
    return lines.where((F.size(passed) % 2 == 1) | F.exists(corners, near)).select(key).distinct()


def node_segments(segs: DataFrame, key: str) -> DataFrame:
    """Cuts all segments where they meet: ``key, seg, piece, x1, y1, x2, y2``.  Pieces that several segments share appear once, for the
    least (key, seg)."""
    segs = segs.where("x1 <> x2 or y1 <> y2").where(F.col(key).isNotNull())
    single, pieces = noding.pieces(segs, noding.places(segs, key), key, lines=False)
    forward = F.expr("x1 < x2 or (x1 = x2 and y1 <= y2)")
    ends = lambda *c: F.struct(*[F.col(x).alias(n) for x, n in zip(c, quadtree._ENDS)])
    same = F.when(forward, ends(*quadtree._ENDS)).otherwise(ends("x2", "y2", "x1", "y1"))
    first = pieces.groupBy(same.alias("same")).agg(F.min(F.struct(*pieces.columns)).alias("p"))
    return single.unionByName(first.select("p.*"))


def plain_vertices(geom):
    """A vertex array without vertices equal to the one before."""
    return F.filter(geom, lambda p, i: (i == 0) | (p != geom[F.greatest(i - 1, F.lit(0))]))


def node_lines(lines: DataFrame, key: str, geom: str = "geom") -> DataFrame:
    """Cuts polylines where they meet each other or themselves: ``key, piece, geom``, each piece with all vertices between two such places or
    line ends.  Pieces that several lines share appear once, for the least (key, piece).  Coordinates are rounded to six places; lines
    without length give nothing, lines without a key are not cut.  A line with its places is held by one task.  Only pieces that may be
    shared are shuffled."""
    shaped = lines.select(key, plain_vertices(F.col(geom)).alias("g")).where(F.size("g") >= 2)
    segs = segments(shaped.where(F.col(key).isNotNull()), key, "g")
    single, pieces = noding.pieces(segs, noding.places(segs, key), key, lines=True)
    even = plain_vertices(F.transform("g", lambda p: F.struct(F.round(p.x.cast("double"), 6).alias("x"), F.round(p.y.cast("double"), 6).alias("y"))))
    unnamed = shaped.where(F.col(key).isNull()).select(key, F.lit(0).alias("piece"), even.alias("geom")).where(F.size("geom") >= 2)
    pieces = pieces.unionByName(unnamed)
    same = F.least("geom", F.reverse("geom"))
    first = pieces.groupBy(same.alias("same")).agg(F.min(F.struct(key, "piece", "geom")).alias("p"))
    return single.unionByName(first.select(f"p.{key}", "p.piece", "p.geom"))


def midpoints(segs: DataFrame, key: str) -> DataFrame:
    """``key, mx, my``: the place half way along each line."""
    run = Window.partitionBy(key).orderBy("seg")
    d = F.sqrt((F.col("x2") - F.col("x1")) ** 2 + (F.col("y2") - F.col("y1")) ** 2)
    s = segs.withColumn("d", d).withColumns({"before": F.coalesce(F.sum("d").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), "total": F.sum("d").over(Window.partitionBy(key))})
    half = s.where("total > 0 and before <= total / 2 and before + d >= total / 2 and d > 0")
    t = (F.col("total") / 2 - F.col("before")) / F.col("d")
    first = Window.partitionBy(key).orderBy("seg")
    return half.select(key, "seg", (F.col("x1") + t * (F.col("x2") - F.col("x1"))).alias("mx"), (F.col("y1") + t * (F.col("y2") - F.col("y1"))).alias("my")).withColumn("k", F.row_number().over(first)).where("k = 1").drop("k", "seg")


def nearest_line(points: DataFrame, segs: DataFrame, key: str, reach: float, *attrs: str) -> DataFrame:
    """``key`` of each point with the nearest line within ``reach``, the least key in a tie, its distance and ``attrs``; null if none.

    Middles of pieces lie on a line but for rounding.  So a thousandth of the reach comes first, what is found there is the nearest, and only
    points that have nothing there meet all lines within the reach."""
    spots = materialize(points.select(key, F.col("mx").alias("x1"), F.col("my").alias("y1"), F.col("mx").alias("x2"), F.col("my").alias("y2"), F.lit(0).alias("seg")), "middles")

    def best(spots: DataFrame, reach: float) -> DataFrame:
        return near_segments(spots, segs, reach).groupBy(key).agg(F.min(F.struct("gap2", f"o_{key}", *[f"o_{a}" for a in attrs])).alias("b"))

    found = materialize(best(spots, reach / 1000), "nearest")
    rest = materialize(spots.join(found, key, "left_anti"), "middles")
    if not rest.isEmpty():
        found = found.unionByName(best(rest, reach))
    return points.join(found, key, "left").select(*points.columns, F.col(f"b.o_{key}").alias("near_id"), F.sqrt("b.gap2").alias("distance"), *[F.col(f"b.o_{a}").alias(a) for a in attrs])


def nearest_places(points: DataFrame, segs: DataFrame, key: str, line_key: str = "line_id") -> DataFrame:
    """``key, line_key, seg, t, x, y, distance``: for each of ``points(key, x, y)``, however far, the nearest place on the segments of lines; the
    least line and segment in a tie.  Points with a null or non-finite coordinate are left out, and all where there is no line.

    Rings are grown: points that have no segment within the reach so far are looked for again with four times the reach, so each round has
    fewer points, and what is found within the reach is the nearest."""
    segs = materialize(quadtree.plain_segments(segs).select(line_key, "seg", "x1", "y1", "x2", "y2"), "lines")
    spots = points.select(key, F.col("x").cast("double").alias("x1"), F.col("y").cast("double").alias("y1"), F.col("x").cast("double").alias("x2"), F.col("y").cast("double").alias("y2"))
    spots = materialize(quadtree.plain_segments(spots), "points")
    extent = lambda c: F.max(F.greatest(f"{c}1", f"{c}2")) - F.min(F.least(f"{c}1", f"{c}2"))
    both = spots.select("x1", "y1", "x2", "y2").unionByName(segs.select("x1", "y1", "x2", "y2")).agg(extent("x").alias("w"), extent("y").alias("h")).first()
    n = segs.count()
    columns = [F.col(f"b.o_{c}").alias(c) for c in (line_key, "seg")]
    ends = {c: F.col(f"b.o_{c}") for c in ("x1", "y1", "x2", "y2")}
    dx, dy = ends["x2"] - ends["x1"], ends["y2"] - ends["y1"]
    square = dx * dx + dy * dy
    t = F.when(square > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("x1") - ends["x1"]) * dx + (F.col("y1") - ends["y1"]) * dy) / F.when(square > 0, square)))).otherwise(0.0)
    widest = 1.01 * ((both.w or 0.0) + (both.h or 0.0)) + 1.0
    reach, found = max(1e-3, 2 * (max(both.w or 0.0, 1e-3) * max(both.h or 0.0, 1e-3) / max(n, 1)) ** 0.5), None
    while n:
        reach = min(reach, widest)
        pairs = near_segments(spots, segs, reach)
        best = pairs.groupBy(key).agg(F.min(F.struct("gap2", *[f"o_{c}" for c in (line_key, "seg", "x1", "y1", "x2", "y2")])).alias("b"), F.first("x1").alias("x1"), F.first("y1").alias("y1"))
        best = materialize(best.select(key, *columns, t.alias("t"), F.sqrt("b.gap2").alias("distance"), ends["x1"].alias("_x"), ends["y1"].alias("_y"), dx.alias("_dx"), dy.alias("_dy")), "nearest")
        found = best if found is None else found.unionByName(best)
        spots = materialize(spots.join(best, key, "left_anti"), "points")
        if reach >= widest or spots.isEmpty():
            break
        reach *= 4
    if found is None:
        return spots.limit(0).join(segs.limit(0).select(line_key, "seg")).select(key, line_key, "seg", *[F.lit(0.0).alias(c) for c in ("t", "x", "y", "distance")])
    return found.select(key, line_key, "seg", "t", (F.col("_x") + F.col("t") * F.col("_dx")).alias("x"), (F.col("_y") + F.col("t") * F.col("_dy")).alias("y"), "distance")


def running_sum(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Sum of a column over all rows up to each one in an order that has no ties, by range partitions and their sums, not in one task."""
    spark = df.sparkSession
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(df.repartitionByRange(slices, *order).withColumn("_p", F.spark_partition_id()), "running")
    sums = ranged.groupBy("_p").agg(F.sum(value).alias("_sum"), F.min(F.struct(*order)).alias("_low"))
    before = sums.select("_p", F.coalesce(F.sum("_sum").over(Window.orderBy("_low").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row a partition
    inside = F.sum(value).over(Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn("_inside", inside).join(F.broadcast(before), "_p").select(*df.columns, (F.col("_before") + F.col("_inside")).alias(name))


def split_lines(lines: DataFrame, places: DataFrame, key: str = "line_id", geom: str = "geom") -> DataFrame:
    """``key, piece, geom``: lines cut at ``places(key, seg, t)``, pieces numbered from 0 along each line.  Places at the ends of a line, repeated
    places and places of other lines cut nothing; lines without places are one piece, lines of less than two different vertices none.  ``key``
    is unique in ``lines`` and not null.

    Vertices and places are put in one order and dealt by ranges of it, so a line with very many places is worked on by many tasks."""
    shaped = materialize(lines.where(F.col(key).isNotNull()).select(key, plain_vertices(F.col(geom)).alias("g")).where("size(g) >= 2"), "shaped")
    vertices = shaped.select(key, F.posexplode("g").alias("s", "p"), F.size("g").alias("n"))
    vertices = vertices.select(key, "s", F.lit(0.0).alias("t"), F.col("p.x").alias("x"), F.col("p.y").alias("y"), F.lit(False).alias("cut"), (F.col("s") == 0).cast("long").alias("starts"))
    at = places.select(key, F.when(F.col("t") >= 1, F.col("seg") + 1).otherwise(F.col("seg")).alias("s"), F.when((F.col("t") >= 1) | (F.col("t") < 0), F.lit(0.0)).otherwise(F.col("t")).alias("t")).distinct()
    segs = segments(shaped, key, "g")
    ends = segs.groupBy(key).agg(F.max("seg").alias("last"))
    inner = at.join(ends, key).where("(s > 0 or t > 0) and s <= last").drop("last").join(segs.withColumnRenamed("seg", "s"), [key, "s"])
    along = lambda c: (F.col(f"{c}1") + F.col("t") * (F.col(f"{c}2") - F.col(f"{c}1"))).alias(c)
    cuts = inner.select(key, "s", "t", along("x"), along("y"), F.lit(True).alias("cut"), F.lit(1).cast("long").alias("starts"))
    rows = running_sum(vertices.unionByName(cuts), [key, "s", "t", "cut"], "starts", "g")
    both = rows.withColumn("g", F.explode(F.when(F.col("cut"), F.array(F.col("g") - 1, F.col("g"))).otherwise(F.array("g"))))
    pieces = both.groupBy("g").agg(F.first(key).alias(key), F.sort_array(F.collect_list(F.struct("s", "t", "cut", "x", "y"))).alias("v"))
    pieces = materialize(pieces.select(key, "g", plain_vertices(F.transform("v", lambda p: F.struct(p.x.alias("x"), p.y.alias("y")))).alias(geom)), "pieces")
    first = pieces.groupBy(key).agg(F.min("g").alias("first"))
    return pieces.join(first, key).select(key, (F.col("g") - F.col("first")).alias("piece"), geom)


#: Neighbours of a cell of side tolerance / sqrt(2) that may hold a point within the tolerance, one of each two opposite ones.
_AROUND = [(i, j) for i in (0, 1, 2) for j in (-2, -1, 0, 1, 2) if (i, j) > (0, 0) and (abs(i), abs(j)) != (2, 2)]


def snap(points: DataFrame, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """Merges points ``(seq, x, y)`` that are chained by steps of at most ``tolerance``: nodes ``(node_id, x, y, members)``, at the mean of
    their members and numbered by their first point, and ``(seq, node_id)``.

    Points of one cell of side tolerance / sqrt(2) belong together, so cells are chained, not points.  Two near cells are linked at
    once where their first points are near; otherwise the points of each that lie near the other's box are searched until a near
    pair is found.  At most ten rows a cell are joined, and no list of near points is made."""
    side = F.lit(tolerance / 2**0.5)
    own = points.select("seq", "x", "y", F.struct(F.floor(F.col("x") / side).cast("long").alias("i"), F.floor(F.col("y") / side).cast("long").alias("j")).alias("cell"))
    m = lambda f, c: f(c).alias(f"{c}{'0' if f is F.min else '1'}")
    cells = own.groupBy("cell").agg(F.min(F.struct("seq", "x", "y")).alias("p"), m(F.min, "x"), m(F.max, "x"), m(F.min, "y"), m(F.max, "y"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.count("*").alias("n"))
    cells = materialize(cells, "snap-cells")
    box = F.struct("p", "x0", "x1", "y0", "y1")
    steps = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j")) for i, j in _AROUND]))
    left = cells.select(F.col("cell").alias("a"), box.alias("box_a"), steps.alias("d")).select("a", "box_a", F.struct((F.col("a.i") + F.col("d.i")).alias("i"), (F.col("a.j") + F.col("d.j")).alias("j")).alias("b"))
    reach = tolerance * tolerance
    gap = lambda p, q: f"pow(greatest(0, {p}.x0 - {q}.x1, {q}.x0 - {p}.x1), 2) + pow(greatest(0, {p}.y0 - {q}.y1, {q}.y0 - {p}.y1), 2)"
    near = left.join(cells.select(F.col("cell").alias("b"), box.alias("box_b")), "b").where(f"{gap('box_a', 'box_b')} <= {reach!r}")
    near = materialize(near.withColumn("sure", F.expr(f"pow(box_a.p.x - box_b.p.x, 2) + pow(box_a.p.y - box_b.p.y, 2) <= {reach!r}")), "snap-near")
    open_pairs = near.where("not sure")
    places = own.select("cell", "x", "y").distinct()

    def facing(mine: str, other: str):
        rows = places.withColumnRenamed("cell", mine).join(open_pairs.select("a", "b", F.col(f"box_{other}").alias("box")), mine)
        return rows.where(f"pow(greatest(0, box.x0 - x, x - box.x1), 2) + pow(greatest(0, box.y0 - y, y - box.y1), 2) <= {reach!r}").select("a", "b", F.col("x").alias(f"x_{mine}"), F.col("y").alias(f"y_{mine}"))

    met = facing("a", "b").join(facing("b", "a").withColumnsRenamed({"a": "o_a", "b": "o_b"}), F.expr(f"a = o_a and b = o_b and pow(x_a - x_b, 2) + pow(y_a - y_b, 2) <= {reach!r}"), "left_semi").select("a", "b").distinct()
    links = near.where("sure").unionByName(near.join(met, ["a", "b"], "left_semi")).select(F.col("box_a.p.seq").alias("a"), F.col("box_b.p.seq").alias("b"))
    found = connected_components(links).withColumnRenamed("node", "first")
    named = cells.select("cell", F.col("p.seq").alias("first"), "sx", "sy", "n").join(found, "first", "left").withColumn("first", F.coalesce("component", "first"))
    named = materialize(named, "snap-named")
    groups = named.groupBy("first").agg(F.sum("sx").alias("sx"), F.sum("sy").alias("sy"), F.sum("n").alias("members"))
    nodes = dense_ids(groups, "first", "node_id")
    total = named.agg(F.sum("n")).first()[0] or 0
    ends = salted_join(own.select("seq", "cell"), named.select("cell", "first", "n"), "cell", total, "seq").join(nodes.select("first", "node_id"), "first")
    return nodes.select("node_id", (F.col("sx") / F.col("members")).alias("x"), (F.col("sy") / F.col("members")).alias("y"), "members"), ends.select("seq", "node_id")


def dense_ids(df: DataFrame, key: str | list[str], name: str, slices: int | None = None, keep: bool = True, then: list[Column] | None = None) -> DataFrame:
    """Consecutive numbers from 0 in the order of a unique key, by range partitions and their sizes, not in one task.  The rows are shuffled
    once and written once, in order, without the key if it is not to ``keep``.  ``then``: columns made of the shuffled rows, instead of theirs."""
    slices = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [key] if isinstance(key, str) else key
    ranged = df.repartitionByRange(slices, *keys).sortWithinPartitions(*keys)
    if then is None:
        then = [F.col(c) for c in df.columns if keep or c not in keys]
    # the number of a row in its partition, and that of the partition above it; partitions are in the order of the key
    ranged = materialize(ranged.select(*then, F.monotonically_increasing_id().alias("_k")), "dense")
    part = F.shiftrightunsigned("_k", 33)
    sizes = ranged.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    before = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row a partition
    columns = [c for c in ranged.columns if c != "_k"]
    return ranged.withColumn("_p", part).join(F.broadcast(before), "_p").select(*columns, (F.col("_before") + F.col("_k").bitwiseAND((1 << 33) - 1)).alias(name))
