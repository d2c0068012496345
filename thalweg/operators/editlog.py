"""Edits in force after undo and redo, with the log of one document dealt to many tasks.

A log is a walk of a cursor: an edit moves it up by one and makes that the top, undo moves it down, not below 0, and redo up, not
above the top.  The last edit at each height up to where the cursor ends is in force.  Slices of a log are told in short first:
what stays above a slice's own edits is known without the rest of the log, so only ways below them are kept.  The short forms
of a document are walked in order, which gives cursor and top at the start of each slice; then all slices are walked at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thalweg.storage import materialize

EDIT, UNDO, REDO = 0, 1, 2


def walk(cursor: int, top: int, steps) -> tuple[int, int]:
    """Cursor and top after steps ``(kind, times)``."""
    for kind, times in steps:
        if kind == EDIT:
            cursor += times
            top = cursor
        elif kind == UNDO:
            cursor = max(0, cursor - times)
        else:
            cursor = min(top, cursor + times)
    return cursor, top


class Short:
    """A short form of a slice: the same walk from every cursor and top."""

    def __init__(self):
        self.steps: list[list[int]] = []
        self.own = self.high = 0  # cursor and top above the place where the edits since the last written step began

    def _write(self, kind: int, times: int) -> None:
        if times:
            if self.steps and self.steps[-1][0] == kind:
                self.steps[-1][1] += times
            else:
                self.steps.append([kind, times])

    def _settle(self) -> None:
        self._write(EDIT, self.high)
        self._write(UNDO, self.high - self.own)
        self.own = self.high = 0

    def add(self, kind: int) -> None:
        if kind == EDIT:
            last = self.steps[-2:]
            if not self.high and len(last) == 2 and last[0][0] == EDIT and last[1][0] == UNDO and last[1][1] >= last[0][1]:
                # the top no longer counts: edits that were all undone leave what was undone below them
                del self.steps[-2:]
                self._write(UNDO, last[1][1] - last[0][1])
            self.own += 1
            self.high = self.own
        elif not self.high:
            self._write(kind, 1)
        elif kind == REDO:
            self.own = min(self.high, self.own + 1)
        elif self.own:
            self.own -= 1
        else:
            self._settle()
            self._write(UNDO, 1)

    def told(self) -> list[list[int]]:
        self._settle()
        return self.steps


def _runs(batches, columns: int) -> Iterator[tuple]:
    """Rows one after another, with whether a new run of equal first columns begins."""
    before = None
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            yield row[:columns] != before, row
            before = row[:columns]


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 50_000):
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def effective_ops(ops: DataFrame, by: str = "doc", slices: int | None = None) -> DataFrame:
    """``by, seq`` of the edits in force: ``ops(doc, seq, op, ...)`` with ``undo``, ``redo`` and anything else (also null) as an edit.  An edit
    after an undo drops what could be redone.  Rows with one ``seq`` in a document count in the order edit, redo, undo.  Null documents are one
    document; an empty log gives no rows."""
    slices = slices or int(ops.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = F.when(F.col("op") == "undo", UNDO).when(F.col("op") == "redo", REDO).otherwise(EDIT)
    log = ops.select(F.col(by).alias("doc"), F.col("seq").cast("long").alias("seq"), kind.alias("kind"), F.when(F.col("op") == "undo", 2).when(F.col("op") == "redo", 1).otherwise(0).alias("tie"))
    log = materialize(log.repartitionByRange(slices, "doc", "seq").withColumn("slice", F.spark_partition_id()), "log")
    doc = log.schema["doc"].dataType.simpleString()
    arrow = lambda b: b.schema.field("doc").type

    def shorten(batches):
        batches = iter(batches)
        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema([("doc", arrow(first)), ("slice", pa.int32()), ("kinds", pa.list_(pa.int32())), ("times", pa.list_(pa.int64()))])

        def rows():
            own, short = None, None
            for new, (slice_, doc, _, kind) in _runs(_chain(first, batches), 2):
                if new:
                    if short:
                        told = short.told()
                        yield own[1], own[0], [k for k, _ in told], [n for _, n in told]
                    own, short = (slice_, doc), Short()
                short.add(kind)
            told = short.told()
            yield own[1], own[0], [k for k, _ in told], [n for _, n in told]

        yield from _batches(rows(), schema, 1000)

    ordered = log.repartition(slices, "slice").sortWithinPartitions("slice", "doc", "seq", "tie").select("slice", "doc", "seq", "kind")
    short = ordered.mapInArrow(shorten, f"doc {doc}, slice int, kinds array<int>, times array<long>")

    def follow(batches):
        batches = iter(batches)
        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema([("doc", arrow(first)), ("slice", pa.int32()), ("cursor", pa.int64()), ("top", pa.int64()), ("ends", pa.int64())])

        def rows():
            starts, doc, cursor, top = [], None, 0, 0  # a start for each slice of a document
            for new, (own, slice_, kinds, times) in _runs(_chain(first, batches), 1):
                if new:
                    yield from ((doc, *s, cursor) for s in starts)
                    starts, doc, cursor, top = [], own, 0, 0
                starts.append((slice_, cursor, top))
                cursor, top = walk(cursor, top, zip(kinds, times))
            yield from ((doc, *s, cursor) for s in starts)

        yield from _batches(rows(), schema)

    starts = short.repartition("doc").sortWithinPartitions("doc", "slice").mapInArrow(follow, f"doc {doc}, slice int, cursor long, top long, ends long")
    # the start of a slice comes before its rows
    led = log.select("slice", "doc", F.lit(1).alias("part"), "seq", "tie", "kind", *[F.lit(None).cast("long").alias(c) for c in ("cursor", "top", "ends")])
    led = led.unionByName(starts.select("slice", "doc", F.lit(0).alias("part"), F.lit(None).cast("long").alias("seq"), F.lit(0).alias("tie"), F.lit(0).alias("kind"), "cursor", "top", "ends"))
    led = led.repartition(slices, "slice").sortWithinPartitions("slice", "doc", "part", "seq", "tie").select("slice", "doc", "part", "seq", "kind", "cursor", "top", "ends")

    def heights(batches):
        batches = iter(batches)
        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema([("doc", arrow(first)), ("height", pa.int64()), ("seq", pa.int64())])

        def rows():
            cursor = top = ends = 0
            for _, (_, doc, part, seq, kind, *start) in _runs(_chain(first, batches), 2):
                if part == 0:
                    cursor, top, ends = start
                    continue
                cursor, top = walk(cursor, top, [(kind, 1)])
                if kind == EDIT and cursor <= ends:
                    yield doc, cursor, seq

        yield from _batches(rows(), schema)

    found = led.mapInArrow(heights, f"doc {doc}, height long, seq long")
    return found.groupBy("doc", "height").agg(F.max("seq").alias("seq")).select(F.col("doc").alias(by), "seq")


def _chain(first, rest):
    yield first
    yield from rest
