"""Mixing sources to target weights along a time-varying curriculum.

Every source has a target number of words and a weight schedule over training time.  The integral of the schedule,
scaled to the target, is the source's cumulative demand.  The documents of a source lie end to end in a fixed random
order (repeated when the demand is larger than the source); the position of a copy in training is the time at which the
cumulative demand reaches the middle of the copy.  Documents of all sources are then range-sorted by position.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thalweg.storage import materialize

WORD = "[^\\x20\\x09-\\x0D]+"
#: Weight schedules by rank of the source, repeating: breakpoints (time, relative weight), linear in between.
SCHEDULES = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))
WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3
_BUCKET_ROWS, _MOST_BUCKETS = 512, 65536


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def _digest(text: Column) -> Column:
    return F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


def source_targets(sized: DataFrame) -> DataFrame:
    """``sized(skey, size)`` to one row per source: ``skey, source_size, rank, target``.  The number of rows is that of the
    sources.  Targets are shares by weight, levelled off at ``MOST_REPEATS`` times the source; the level of the others
    follows from the sources ordered by capacity per unit of weight."""
    totals = sized.groupBy("skey").agg(F.sum("size").alias("source_size"))
    ranked = totals.withColumn("rank", F.row_number().over(Window.orderBy("skey")) - 1)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int")).cast("long")
    w = ranked.withColumn("w", weight).withColumn("cap", F.col("source_size") * MOST_REPEATS)
    every = Window.partitionBy()
    order = Window.orderBy(F.col("cap").cast("double") / F.col("w"), "skey").rowsBetween(Window.unboundedPreceding, -1)
    level = (
        w.withColumn("free_words", F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(order), F.lit(0)))
        .withColumn("free_weight", F.sum("w").over(every) - F.coalesce(F.sum("w").over(order), F.lit(0)))
        .withColumn("lam", F.col("free_words").cast("double") / F.col("free_weight"))
        .withColumn("open", F.col("cap") > F.col("lam") * F.col("w"))
    )
    first_open = F.min(F.when(F.col("open"), F.struct(F.col("cap").cast("double") / F.col("w"), "skey", "lam"))).over(every)
    return level.withColumn("lam", first_open["lam"]).select(
        "skey", "source_size", "rank", F.least(F.col("cap").cast("double"), F.coalesce(F.col("lam") * F.col("w"), F.col("cap").cast("double"))).alias("target")
    )


def demand_time(u: Column, points) -> Column:
    """Time in [0, 1] at which the normalised integral of a piecewise linear schedule reaches ``u``."""
    parts, area = [], 0.0
    for (t0, w0), (t1, w1) in zip(points, points[1:]):
        parts.append((t0, t1, w0, w1, area))
        area += (t1 - t0) * (w0 + w1) / 2
    out = None
    for t0, t1, w0, w1, before in reversed(parts):
        r = u * F.lit(area) - F.lit(before)
        slope = (w1 - w0) / (t1 - t0)
        root = F.sqrt(F.greatest(F.lit(0.0), F.lit(w0 * w0) + F.lit(2 * slope) * r))
        t = F.lit(t0) + F.lit(2.0) * r / (F.lit(w0) + root)
        out = t if out is None else F.when(u * F.lit(area) < F.lit(before + (t1 - t0) * (w0 + w1) / 2), t).otherwise(out)
    return out


def plan_mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """Adds ``_source_size, _target, _taken, _total, _rank, _ahead`` to a table that has ``_size`` (words) and ``_digest`` (md5 of the text).

    The cumulative sum within a source is taken in two steps, within hash buckets and over bucket totals, so that a
    source with a third of all rows is spread over many tasks, as are rows without an id or with one id.
    """
    keyed = df.withColumn(
        "_skey", F.when(F.col(source_col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source_col).cast("string")))
    ).withColumn("_h", F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.col("_digest")).cast("binary")))
    narrow = materialize(keyed.select(F.col("_skey").alias("skey"), F.col("_size").alias("size"), F.conv(F.substring("_h", 1, 4), 16, 10).cast("int").alias("b")).groupBy("skey", "b").agg(F.sum("size").alias("size"), F.count("*").alias("n")), "mix-totals")
    n, total = narrow.agg(F.sum("n"), F.sum("size")).first()
    bits = min(int(math.log2(_MOST_BUCKETS)), max(0, math.ceil(math.log2(max(1, (n or 0) / _BUCKET_ROWS)))))
    bucket = lambda c: F.expr(f"shiftright({c}, {16 - bits})")
    sums = narrow.groupBy("skey", bucket("b").alias("bucket")).agg(F.sum("size").alias("s"))
    upto = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("skey", "bucket", F.coalesce(F.sum("s").over(upto), F.lit(0)).alias("_offset"))
    table = offsets.join(source_targets(narrow.select("skey", "size")), "skey")
    table = table.select(F.col("skey").alias("_skey"), F.col("bucket").alias("_bucket"), "_offset", F.col("source_size").alias("_source_size"), F.col("rank").alias("_rank"), F.col("target").alias("_target"))
    rows = keyed.withColumn("_b", F.conv(F.substring("_h", 1, 4), 16, 10).cast("int")).withColumn("_bucket", bucket("_b"))
    inside = Window.partitionBy("_skey", "_bucket").orderBy("_h", F.col(id_col)).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_within", F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    rows = rows.join(table, ["_skey", "_bucket"]).withColumn("_ahead", F.col("_offset") + F.col("_within"))
    demand = F.floor(F.col("_target") + 0.5).cast("long")
    full = F.when(F.col("_source_size") > 0, F.floor(demand / F.col("_source_size")).cast("long")).otherwise(F.lit(0).cast("long"))
    rows = rows.withColumn("_full", full).withColumn("_rest", demand - F.col("_full") * F.col("_source_size"))
    taken = F.col("_full") * F.col("_size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("_size"), F.col("_rest") - F.col("_ahead")))
    return rows.withColumn("_taken", taken).withColumn("_total", F.lit(int(total or 0)).cast("long")).drop("_h", "_b", "_bucket", "_offset", "_within", "_full", "_rest", "_skey")


def position(copy: Column) -> Column:
    """Training position, in words from the start, of a copy of a planned document (copy 0, 1, ...)."""
    u = F.when(F.col("_target") > 0, (copy * F.col("_source_size") + F.col("_ahead") + F.col("_size") / F.lit(2.0)) / F.col("_target")).otherwise(F.lit(0.0))
    u = F.least(F.lit(1.0), u)
    by_rank = F.col("_rank") % len(SCHEDULES)
    time = demand_time(u, SCHEDULES[0])
    for k in range(1, len(SCHEDULES)):
        time = F.when(by_rank == k, demand_time(u, SCHEDULES[k])).otherwise(time)
    return F.floor(time * F.col("_total")).cast("long")


def mix_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken, copies, position``, sorted by position.

    ``size`` counts words (null text: 0).  ``taken`` counts the words the mix takes, repeats included: whole copies, but
    for one document per source whose last copy is cut where the demand ends, so a source's taken words equal its target
    rounded.  ``position`` is that of the first copy, null when nothing is taken.  Null sources form one source that
    comes last.  Order within a source: md5 of id and content; only rows equal in both may swap.
    Sources without words have target 0.  An empty table gives no rows.
    """
    narrow = materialize(
        df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("_size"), _digest(F.col(text_col)).alias("_digest")),
        "mix-sizes",
    )
    plan = plan_mix(narrow, "doc_id", "source")
    copies = F.when(F.col("_size") > 0, F.ceil(F.col("_taken") / F.col("_size"))).otherwise(F.lit(0)).cast("int")
    return plan.select(
        "doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").alias("taken"),
        copies.alias("copies"), F.when(F.col("_taken") > 0, position(F.lit(0))).alias("position"),
    ).orderBy("position", "doc_id")


def mixed_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: whole input rows, each as often as it is taken (the last copy when at least half of it is), dealt
    into partitions by training position and sorted within them.  Columns as in ``df``.

    Null and empty texts have no words and are not taken; null sources form one source that comes last; null ids are ids like others.
    Repeated rows are rows of their own; rows that are alike in id and content may swap.  An empty table gives no rows.  Columns
    may have any names."""
    columns = df.columns
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(id_col).alias("_id"), F.col(source_col).alias("_source"))
    text = F.col("row").getField(text_col)
    sized = packed.withColumns({"_size": word_count(text), "_digest": _digest(text)})
    plan = plan_mix(sized, "_id", "_source")
    n = F.when(F.col("_size") > 0, F.floor(F.col("_taken") / F.col("_size") + 0.5)).otherwise(F.lit(0)).cast("int")
    copies = plan.withColumn("_n", n).where("_n > 0").withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return copies.withColumn("_position", position(F.col("_copy"))).repartitionByRange("_position", "_id").sortWithinPartitions("_position", "_id").select("row.*")
