"""Exact quantiles by repeated histograms: no sort, no buffer of all values, whatever the size of a group.

Each round counts the values in slices of the range that still holds the wanted rank, and goes on with the slice that has it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thalweg.storage import materialize

#: Slices of a range that are counted at once.
SLICES = 1024
#: Groups up to which their ranges are broadcast.
FEW = 20_000
_INF = float("inf")


def _keyed(df: DataFrame, value: str, keys: tuple[str, ...]) -> DataFrame:
    """The values with their group as one text, so that null keys join as others do."""
    key = F.to_json(F.struct(*keys)) if keys else F.lit("")
    return df.where(F.col(value).isNotNull()).select(key.alias("_key"), *keys, F.col(value).cast("double").alias("_v"))


def _with(rows: DataFrame, groups: DataFrame, n: int) -> DataFrame:
    return rows.join(F.broadcast(groups) if n <= FEW else groups, "_key")


def _narrowed(rows: DataFrame, ranges: DataFrame, n: int) -> DataFrame:
    """For each range the slice of it that holds its rank: least and greatest value there, and the rank within."""
    low, high, v = F.col("_low"), F.col("_high"), F.col("_v")
    # over several magnitudes the slices are even in magnitude: ln of the least double is above -745
    size = lambda x: F.when(x == 0, F.lit(0.0)).otherwise(F.signum(x) * (F.ln(F.abs(x)) + 745))
    wide = (low <= 0) & (high >= 0) | (F.greatest(F.abs(low), F.abs(high)) > 4 * F.least(F.abs(low), F.abs(high)))
    share = F.when(wide, (size(v) - size(low)) / (size(high) - size(low))).otherwise((v - low) / (high - low))
    slice_of = F.when(F.col("_v") == F.col("_high"), F.lit(SLICES)).otherwise(F.least(F.floor(share * SLICES), F.lit(SLICES - 1)))
    inside = _with(rows, ranges, n).where("_v between _low and _high").withColumn("_slice", slice_of)
    counts = inside.groupBy("_key", "_slice").agg(F.count("*").alias("_n"), F.min("_v").alias("_a"), F.max("_v").alias("_b"), F.first("_rank").alias("_rank"))
    # at most SLICES + 1 rows a group
    before = F.sum("_n").over(Window.partitionBy("_key").orderBy("_slice")) - F.col("_n")
    held = counts.withColumn("_before", before).where("_rank >= _before and _rank < _before + _n")
    return held.select("_key", F.col("_a").alias("_low"), F.col("_b").alias("_high"), (F.col("_rank") - F.col("_before")).alias("_rank"))


def order_statistic(df: DataFrame, value: str, rank: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """``keys, value, n``: of each group the value of rank ``rank`` (from 0, an expression of the group's number ``n`` of values) in
    ascending order.  Null values don't count, infinities do, and NaN counts as greater than all.  Null keys are a group; groups that have
    no such rank give no row."""
    rows = _keyed(df, value, keys)
    infinite = lambda sign: F.count_if(F.col("_v") == sign * _INF)
    finite = F.when(F.abs("_v") < _INF, F.col("_v"))
    sums = rows.groupBy("_key").agg(F.count("*").alias("n"), F.count_if(F.isnan("_v")).alias("_nan"), infinite(1).alias("_top"), infinite(-1).alias("_bottom"), F.min(finite).alias("_low"), F.max(finite).alias("_high"), *[F.first(k).alias(k) for k in keys])
    sums = materialize(sums.withColumn("_rank", rank.cast("long")).where("_rank >= 0 and _rank < n"), "groups")
    from_top = F.col("n") - F.col("_rank")
    odd = F.when(F.col("_rank") < F.col("_bottom"), F.lit(-_INF)).when(from_top <= F.col("_nan"), F.lit(float("nan"))).when(from_top <= F.col("_nan") + F.col("_top"), F.lit(_INF))
    found = sums.where(odd.isNotNull()).select("_key", odd.alias("value"))
    ranges = sums.where(odd.isNull()).select("_key", "_low", "_high", (F.col("_rank") - F.col("_bottom")).alias("_rank"))
    rows = rows.where(F.abs("_v") < _INF).select("_key", "_v")
    while True:
        found = found.unionByName(ranges.where("_low = _high").select("_key", F.col("_low").alias("value")))
        ranges = ranges.where("_low < _high")
        n = ranges.count()
        if not n:
            break
        ranges = materialize(_narrowed(rows, ranges, n), "ranges")
    return sums.join(found, "_key").select("_key", *keys, "value", "n")


def median(df: DataFrame, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """``keys, median, n``: of each group the middle value, or half way between the two middle ones.  Null values don't count; NaN counts as
    greater than all.  Null keys are a group; a group without values, and an empty table, give no row."""
    low = materialize(order_statistic(df, value, F.floor((F.col("n") - 1) / 2), keys), "medians")
    # the next rank has the same value, or the least of the greater ones; NaN is greater than all here too
    beside = _with(_keyed(df, value, keys).select("_key", "_v"), low.select("_key", "value"), low.count())
    upper = beside.groupBy("_key").agg(F.count_if(F.col("_v") <= F.col("value")).alias("_upto"), F.min(F.when(F.col("_v") > F.col("value"), F.col("_v"))).alias("_next"))
    last = F.when(F.col("_upto") > F.floor(F.col("n") / 2), F.col("value")).otherwise(F.col("_next"))
    middle = F.when(last == F.col("value"), F.col("value")).otherwise(F.col("value") / 2 + last / 2)
    return low.join(upper, "_key").select(*keys, middle.alias("median"), "n")
