"""Exact searches by integer inner products: blocked hard-negative mining and a Voronoi nearest-neighbour join.

Rows are ``vec_id, vec`` with vectors of whole numbers in double precision.  Products of blocks are exact while the sums stay
below 2**53; blocks with larger numbers are multiplied in whole numbers of any size, and scores beyond 64 bits are cut to
the ends of that range.  Shorter vectors count as filled up with zeros.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thalweg.storage import materialize, materialize_told

#: Bytes of the vectors of one broadcast block of anchors.
ANCHOR_BYTES = 32 << 20
#: Candidates multiplied at once.
_STEP = 4096
#: Queries of one group of the Voronoi join, and bytes of the vectors of one slice of its candidates.
GROUP_QUERIES, SLICE_BYTES = 512, 4 << 20
_NEVER = np.iinfo(np.int64).min


def whole_vectors(rows: DataFrame, scale: float, vec_col: str = "embedding") -> DataFrame:
    """``vec`` in place of ``vec_col``: each component times ``scale``, rounded down.  Rows with a null vector, or a null or
    non-finite component, are left out."""
    odd = F.exists(vec_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    vec = F.transform(vec_col, lambda x: F.floor(x.cast("double") * scale).cast("double"))
    return rows.where(F.col(vec_col).isNotNull() & ~odd).withColumn("vec", vec).drop(vec_col)


def matrix(column, width: int) -> np.ndarray:
    """Rows of a list column as a matrix of so many columns, filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(offsets)
    if len(sizes) and (sizes == width).all():
        return values[offsets[0] : offsets[-1]].reshape(-1, width)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    near = place < width
    out[row[near], place[near]] = values[offsets[0] : offsets[-1]][near]
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two matrices of whole numbers, as 64-bit integers."""
    most = np.abs(a).max(initial=0.0) * np.abs(b).max(initial=0.0) * max(1, a.shape[1])
    if most < 2.0**53:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in r] for r in m], object).reshape(m.shape)
    ends = np.iinfo(np.int64)
    return np.array([[min(max(x, ends.min + 1), ends.max) for x in r] for r in whole(a) @ whole(b).T], np.int64).reshape(len(a), len(b))


class Best:
    """The k greatest scores of each of n rows, ties by the smaller id; lists of parts can be put together."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores = np.full((n, k), _NEVER)
        self.ids = np.zeros((n, k), np.int64)

    def add(self, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Candidates as parallel arrays."""
        if not len(row):
            return
        touched, place = np.unique(row, return_inverse=True)
        old = np.repeat(np.arange(len(touched)), self.k)
        row = np.r_[old, place]
        score, ids = np.r_[self.scores[touched].ravel(), score], np.r_[self.ids[touched].ravel(), ids]
        order = np.lexsort((ids, ~score, row))
        row, score, ids = row[order], score[order], ids[order]
        first = np.searchsorted(row, np.arange(len(touched)))
        pick = first[:, None] + np.arange(self.k)
        self.scores[touched], self.ids[touched] = score[pick], ids[pick]

    def table(self, names: np.ndarray, columns: list[str]) -> pa.RecordBatch:
        row, k = np.nonzero(self.scores != _NEVER)
        return pa.RecordBatch.from_arrays([pa.array(names[row], pa.int64()), pa.array(self.ids[row, k]), pa.array(self.scores[row, k])], columns)


def _blocks(anchors: DataFrame, width: int, limit: int) -> Iterator[dict[str, np.ndarray]]:
    """The rows of a table as blocks of bounded size, one partition of about that size at a time."""
    rows, held = [], 0
    parts = -(-anchors.count() * (8 * width + 64) // limit)
    for r in anchors.repartition(max(1, parts)).toLocalIterator():
        rows.append(r)
        held += 8 * width + 64
        if held >= limit:
            yield _packed(rows, width)
            rows, held = [], 0
    if rows:
        yield _packed(rows, width)


def _packed(rows: list, width: int) -> dict[str, np.ndarray]:
    vec = np.zeros((len(rows), width))
    for k, r in enumerate(rows):
        vec[k, : len(r.vec)] = r.vec
    out = {"id": np.array([r.vec_id for r in rows], np.int64), "vec": vec, "label": np.array([r.label for r in rows], np.int64)}
    return out | ({"positives": [r.positives for r in rows]} if "positives" in rows[0] else {})


def _passes(rows: DataFrame, anchors: DataFrame, width: int, work, schema: str, limit: int, label: str) -> DataFrame:
    """Runs ``work(block, batches)`` over all rows for each block of anchors, the block being broadcast, and unites the written results."""
    context = rows.sparkSession.sparkContext
    out = []
    for block in _blocks(anchors, width, limit):
        held = context.broadcast(block)
        out.append(materialize(rows.mapInArrow(lambda batches, held=held: work(held.value, batches), schema), label))
        held.destroy()
    if not out:
        return rows.sparkSession.createDataFrame([], schema)
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole


def _steps(batches, width: int):
    for b in batches:
        for lo in range(0, b.num_rows, _STEP):
            part = b.slice(lo, _STEP)
            yield part.column(0).to_numpy(), part.column(1).to_numpy(), matrix(part.column(2), width)


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, limit: int = ANCHOR_BYTES) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for ``rows(vec_id, label, vec)`` and those that
    are anchors, a table of the same columns.

    An anchor's positives are the ``positives`` other rows of its label with the greatest inner products; for each, the
    negatives are the first ``negatives`` rows of other labels with ``low * positive_score <= 100 * negative_score <= high *
    positive_score``, greatest first.  Ties go to the smaller id.  Rows with the anchor's id take no part for it; repeated rows
    are rows of their own, and of anchors with one id the greatest (by vector, then label) asks.  Rows with a null id, label or
    vector take no part.  Other columns are ignored.  An empty table, or one without anchors, gives no rows.

    Blocks of anchors, of ``limit`` bytes, are broadcast one after another, and each is multiplied with blocks of all rows where these lie;
    no row is shuffled.  Each task keeps the best of what it has read, and the lists of the tasks are put together.
    """
    usable = "vec_id is not null and label is not null and vec is not null"
    rows = rows.where(usable).select("vec_id", F.col("label").cast("long").alias("label"), "vec")
    anchors = anchors.where(usable).groupBy("vec_id").agg(F.max(F.struct("vec", F.col("label").cast("long").alias("label"))).alias("a")).select("vec_id", "a.vec", "a.label")
    anchors = materialize(anchors, "anchors")
    width = anchors.agg(F.max(F.size("vec"))).first()[0] or 0
    schema = "anchor_id long, vec_id long, score long"

    def same_label(block, batches):
        best = Best(len(block["id"]), positives)
        for ids, labels, vec in _steps(batches, width):
            score = products(block["vec"], vec)
            row, col = np.nonzero((block["label"][:, None] == labels) & (block["id"][:, None] != ids) & (score >= best.scores[:, -1:]))
            best.add(row, score[row, col], ids[col])
        yield best.table(block["id"], ["anchor_id", "vec_id", "score"])

    found = _passes(rows, anchors, width, same_label, schema, limit, "positives")
    first = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    found = materialize(found.withColumn("k", F.row_number().over(first)).where(F.col("k") <= positives), "positives")
    # lists of at most so many entries
    listed = found.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("k", "score"))).alias("positives")).withColumnRenamed("anchor_id", "vec_id")
    asking = materialize(anchors.join(listed, "vec_id"), "asking")

    def windows(block, batches):
        n = len(block["id"])
        scores = np.full((n, positives), _NEVER)
        for i, p in enumerate(block["positives"]):
            scores[i, : len(p)] = [x.score for x in p]
        wanted = scores.astype(object)
        floor = np.array([[-((-low * int(x)) // 100) if x > _NEVER else 1 for x in r] for r in wanted], np.int64).reshape(n, positives)
        top = np.array([[(high * int(x)) // 100 if x > _NEVER else 0 for x in r] for r in wanted], np.int64).reshape(n, positives)
        best = [Best(n, negatives) for _ in range(positives)]
        for ids, labels, vec in _steps(batches, width):
            score = products(block["vec"], vec)
            other = (block["label"][:, None] != labels) & (block["id"][:, None] != ids)
            score = np.where(other, score, _NEVER)
            for k in range(positives):
                row, col = np.nonzero((score <= top[:, k : k + 1]) & (score >= np.maximum(floor[:, k : k + 1], best[k].scores[:, -1:])))
                best[k].add(row, score[row, col], ids[col])
        for k in range(positives):
            part = best[k].table(np.arange(n), ["a", "vec_id", "score"])
            at = part.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(block["id"][at]), pa.array(np.full(len(at), k + 1, np.int32)), part.column(1), part.column(2)], ["anchor_id", "k", "negative_id", "negative_score"])

    near = _passes(rows, asking, width, windows, "anchor_id long, k int, negative_id long, negative_score long", limit, "negatives")
    first = Window.partitionBy("anchor_id", "k").orderBy(F.desc("negative_score"), "negative_id")
    near = near.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= negatives)
    named = found.select("anchor_id", "k", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return near.join(named, ["anchor_id", "k"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


class Sphere:
    """Pivots on a sphere.  All rows get one more component that makes their length the greatest length of all; queries are stretched to it.
    Then the nearest rows of a query are those of the greatest inner products."""

    def __init__(self, pivots: np.ndarray, radius2: float):
        self.radius2 = radius2
        self.pivots = self.raised(pivots)
        self.apart = np.sqrt(np.maximum(0.0, self._square(self.pivots)[:, None] + self._square(self.pivots) - 2 * self.pivots @ self.pivots.T))

    @staticmethod
    def _square(m: np.ndarray) -> np.ndarray:
        return (m * m).sum(axis=1)

    def raised(self, rows: np.ndarray) -> np.ndarray:
        return np.c_[rows, np.sqrt(np.maximum(0.0, self.radius2 - self._square(rows)))]

    def stretched(self, rows: np.ndarray) -> np.ndarray:
        length = np.sqrt(self._square(rows))
        return np.c_[rows * (np.sqrt(self.radius2) / np.where(length > 0, length, 1.0))[:, None], np.zeros(len(rows))]

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest pivot of each point, and how far it is."""
        gap2 = self._square(points)[:, None] + self._square(self.pivots) - 2 * points @ self.pivots.T
        at = gap2.argmin(axis=1)
        return at, np.sqrt(np.maximum(0.0, gap2[np.arange(len(at)), at]))


def _assigned(rows: DataFrame, held, width: int, queries: bool) -> DataFrame:
    """Rows with their cell and their distance from its pivot."""

    def work(batches):
        sphere = held.value
        for b in batches:
            vec = matrix(b.column(1), width)
            cell, gap = sphere.nearest(sphere.stretched(vec) if queries else sphere.raised(vec))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell.astype(np.int32)), pa.array(gap)], ["vec_id", "vec", "cell", "gap"])

    return rows.select("vec_id", "vec").mapInArrow(work, "vec_id long, vec array<double>, cell int, gap double")


def _closest(assigned: DataFrame, k: int) -> DataFrame:
    """``cell, gap`` of the k ids of each cell that are closest to its pivot."""

    def work(batches):
        best: dict[int, dict[int, float]] = {}
        for b in batches:
            cell, ids, gap = (b.column(c).to_numpy() for c in ("cell", "vec_id", "gap"))
            for c in np.unique(cell).tolist():
                mine = np.flatnonzero(cell == c)
                known = best.setdefault(c, {})
                for i in mine[np.argsort(gap[mine], kind="stable")].tolist():
                    if len(known) >= k and gap[i] >= max(known.values()):
                        break
                    known[int(ids[i])] = min(gap[i], known.get(int(ids[i]), np.inf))
                    if len(known) > k:
                        known.pop(max(known, key=known.get))
        rows = [(c, i, g) for c, known in best.items() for i, g in known.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64())], ["cell", "vec_id", "gap"])

    each = assigned.select("cell", "vec_id", "gap").mapInArrow(work, "cell int, vec_id long, gap double").groupBy("cell", "vec_id").agg(F.min("gap").alias("gap"))
    return each.withColumn("k", F.row_number().over(Window.partitionBy("cell").orderBy("gap", "vec_id"))).where(F.col("k") <= k).select("cell", "gap")


def _groups(counts: dict[int, int], apart: np.ndarray, most: int) -> list[list[int]]:
    """Cells of queries in groups: from the cell of the most queries on, the nearest cells join while a group has at most ``most``."""
    left, out = set(counts), []
    while left:
        first = max(left, key=lambda c: (counts[c], -c))
        left.discard(first)
        group, n = [first], counts[first]
        for c in sorted(left, key=lambda c: (apart[first, c], c)):
            if n + counts[c] > most:
                break
            group.append(c)
            n += counts[c]
        left -= set(group)
        out.append(group)
    return out


def _useful(apart: np.ndarray, have: dict, want: dict, closest: list, k: int, group: int, each: int, slack: float) -> tuple[list, list]:
    """Which cells of queries make which group, ``(group, cell, parts, slices)``, and at what distances from their pivot the rows of a cell
    are of use to a group, ``(group, cell, low, high, parts, slices)``.  ``have``: number of rows of each cell and their least and
    greatest distance from the pivot; ``want``: the same of queries; ``closest``: cell and distance of the ``k + 1`` closest ids."""
    at, gaps = np.array([c for c, _ in closest], int), np.array([g for _, g in closest], float)
    reach = {}
    for i, r in want.items():
        far = np.sort(r.high + apart[i, at] + gaps)
        # of k + 1 ids one can be the query's own
        reach[i] = r.high + (far[k] if len(far) > k else np.inf) + slack
    homes, windows = [], []
    for g, cells in enumerate(_groups({c: r.n for c, r in want.items()}, apart, group)):
        parts = -(-sum(want[c].n for c in cells) // group)
        kept = []
        for j, r in have.items():
            around = [(apart[i, j] - reach[i], apart[i, j] + reach[i]) for i in cells]
            around = [(a, b) for a, b in around if not (a > r.high or b < r.low)]
            if around:
                kept.append((g, j, float(min(a for a, _ in around)), float(max(b for _, b in around))))
        slices = -(-sum(have[j].n for _, j, _, _ in kept) // each)
        windows += [(*w, parts, slices) for w in kept]
        homes += [(g, c, parts, slices) for c in cells]
    return homes, windows


def voronoi_join(rows: DataFrame, queries: DataFrame, k: int = 5, pivots: int = 64, group: int = GROUP_QUERIES, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each of ``queries(vec_id, vec)`` the ``k`` of ``rows(vec_id, vec)`` with the greatest inner
    products, ties by the smaller id; all, if there are fewer.

    Rows with the query's id take no part for it; repeated rows are rows of their own (each has a rank), and of queries with one
    id the greatest vector asks.  Rows and queries with a null id or vector take no part.  Other columns are ignored.  Empty
    tables give no rows.

    Both sides are grouped by the nearest of ``pivots`` rows (those of the least hashes).  From the rows closest to each pivot and the
    widths of the cells follows how far the k-th neighbour of any query of a cell can be, and so which distances from their
    pivot the rows of another cell must have to be of use to it; only those are copied to a group of queries.  Ids are no
    part of the bounds: what is as far as the k-th neighbour stays.  Groups of many rows are dealt into slices, cells of many queries
    into several groups, and the lists of the slices are put together.  The driver holds sums and ``k + 1`` numbers a cell.
    """
    spark = rows.sparkSession
    usable = "vec_id is not null and vec is not null"
    square = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)
    rows, told = materialize_told(rows.where(usable).select("vec_id", "vec"), "vectors", n=F.count(F.lit(1)), width=F.max(F.size("vec")), radius2=F.max(square))
    asked = materialize(queries.where(usable).groupBy("vec_id").agg(F.max("vec").alias("vec")), "queries")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not told.get("n"):
        return empty
    width = max(told["width"], asked.agg(F.max(F.size("vec"))).first()[0] or 0)
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "vec").limit(pivots).collect()
    places = np.zeros((len(drawn), width))
    for i, r in enumerate(drawn):
        places[i, : len(r.vec)] = r.vec
    sphere = Sphere(places, told["radius2"])
    held = spark.sparkContext.broadcast(sphere)
    cells = materialize(_assigned(rows, held, width, queries=False), "cells")
    asking = materialize(_assigned(asked, held, width, queries=True), "asking")

    # sums a cell: at most so many as there are pivots
    have = {r.cell: r for r in cells.groupBy("cell").agg(F.count("*").alias("n"), F.min("gap").alias("low"), F.max("gap").alias("high")).collect()}
    want = {r.cell: r for r in asking.groupBy("cell").agg(F.count("*").alias("n"), F.max("gap").alias("high")).collect()}
    if not want:
        return empty
    closest = [(r.cell, r.gap) for r in _closest(cells, k + 1).collect()]
    slack = 1e-6 * told["radius2"] ** 0.5
    homes, windows = _useful(sphere.apart, have, want, closest, k, group, max(1024, slice_bytes // (8 * max(1, width))), slack)
    homes = spark.createDataFrame(homes, "grp int, cell int, parts int, slices int")
    windows = spark.createDataFrame(windows, "grp int, cell int, low double, high double, parts int, slices int")
    hashed = lambda salt, n: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.col(n)).cast("int")
    left = asking.join(F.broadcast(homes), "cell").select("grp", hashed(1, "parts").alias("part"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "vec_id", "vec")
    right = cells.join(F.broadcast(windows), "cell").where("not (gap < low or gap > high)")
    right = right.select("grp", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), hashed(2, "slices").alias("slice"), "vec_id", "vec")

    def solve(q, c):
        own, vec = q.column("vec_id").to_numpy(), matrix(q.column("vec"), width)
        best = Best(len(own), k)
        if len(own):
            for batch in c.select(["vec_id", "vec"]).to_batches(_STEP):
                ids = batch.column(0).to_numpy()
                score = products(vec, matrix(batch.column(1), width))
                row, col = np.nonzero((own[:, None] != ids) & (score >= best.scores[:, -1:]))
                best.add(row, score[row, col], ids[col])
        return pa.Table.from_batches([best.table(own, ["query_id", "vec_id", "score"])])

    key = ["grp", "part", "slice"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(solve, "query_id long, vec_id long, score long")
    first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def mined(embeddings: DataFrame) -> DataFrame:
    """Hard negatives of every hundredth vector."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = whole_vectors(embeddings.select("vec_id", moved.alias("label"), "embedding"), 256.0)
    return hard_negatives(rows, rows.where("vec_id % 100 = 0"))


def searched(embeddings: DataFrame) -> DataFrame:
    """The five best of every fiftieth vector."""
    rows = whole_vectors(embeddings.select("vec_id", "embedding"), 256.0)
    return voronoi_join(rows, rows.where("vec_id % 50 = 0"))
