"""Joins of rows with a table of their keys, where a few keys may have a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most so many keys count as large: those with more than this part of all rows.
LARGE_KEYS = 20_000
#: No key is large that has no more rows than this.
LEAST_LARGE = 100_000


def salted_join(rows: DataFrame, table: DataFrame, key: str, total: int, spread: str, count: str = "n", least: int = LEAST_LARGE) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has one row per key and in ``count`` the number of rows with that key, ``total``
    of them or about so many.  Rows of large keys are dealt into slices by a hash of the column ``spread``, and the table's row is
    repeated for each slice, so no task gets more than a fixed part of all rows.  The list of large keys is broadcast; it
    has at most ``LARGE_KEYS`` entries.  ``count`` is dropped."""
    share = max(least, total // LARGE_KEYS)
    if total <= share:
        return rows.join(table.drop(count), key)
    slices = F.ceil(F.col(count) / F.lit(share)).cast("int")
    large = table.where(F.col(count) > share).select(key, slices.alias("_slices"))
    slice_of = F.when(F.col("_slices").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(spread), F.col("_slices")).cast("int"))
    dealt = rows.join(F.broadcast(large), key, "left").withColumn("_slice", slice_of).drop("_slices")
    repeated = table.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.when(F.col(count) > share, slices - 1).otherwise(F.lit(0))))).drop(count)
    return dealt.join(repeated, [key, "_slice"]).drop("_slice")
