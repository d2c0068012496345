"""Landed map responses as a stream: each new file is flattened to ways, each way once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thalweg.sources.documents import flatten_response


def follow_responses(spark: SparkSession, folder: str, delay: str = "1 day", **filters) -> DataFrame:
    """Ways of the response files that arrive in a folder.  A way seen again within ``delay`` is not repeated, so the state stays bounded."""
    raw = spark.readStream.text(folder, wholetext=True).withColumn("seen_at", F.current_timestamp())
    ways = flatten_response(raw, **filters).withColumn("seen_at", F.current_timestamp())
    return ways.withWatermark("seen_at", delay).dropDuplicatesWithinWatermark(["osm_id"])
