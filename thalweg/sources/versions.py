"""Append-only versions of a diagram: one Parquet folder per version, made visible by one last file, never overwritten."""

from __future__ import annotations

import hmac
import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thalweg.operators.diagrams import SOURCES, current_versions, difference, orphans

VERSIONS = "version_id string, tambon_id string, source string, label string, entered_by string, created_at timestamp"


def publish(nodes: DataFrame, edges: DataFrame, root: str, area: str, source: str, label: str = "", entered_by: str = "", password: str | None = None, secret: str | None = None) -> str:
    """Adds a version and returns its id.  Nodes and edges go to the version's own folders; the row in ``versions``, one file written last,
    makes them visible together, so a run that breaks off leaves nothing that a reader sees.  Edges must name nodes of the
    version; a community version needs the ``secret`` where there is one."""
    if source not in SOURCES:
        raise ValueError(f"unknown source {source}")
    if source == "community" and secret is not None and not hmac.compare_digest((password or "").encode(), secret.encode()):
        raise PermissionError("wrong password")
    spark, version = nodes.sparkSession, uuid.uuid4().hex
    n, e = nodes.withColumn("version_id", F.lit(version)), edges.withColumn("version_id", F.lit(version))
    if not orphans(e, n).isEmpty():
        raise ValueError("edges name nodes that are not in the version")
    n.drop("version_id").write.parquet(f"{root}/nodes/version_id={version}")
    e.drop("version_id").write.parquet(f"{root}/edges/version_id={version}")
    row = [(version, area, source, label, entered_by, datetime.now(timezone.utc))]
    spark.createDataFrame(row, VERSIONS).coalesce(1).write.mode("append").parquet(f"{root}/versions")
    return version


def current(spark: SparkSession, root: str, area: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the current version of an area; an error where it has none.  Only that version's folders are read."""
    v = current_versions(spark.read.schema(VERSIONS).parquet(f"{root}/versions").where(F.col("tambon_id") == area)).where("is_current").select("version_id").first()
    if v is None:
        raise ValueError(f"no version of {area}")
    return version(spark, root, v.version_id)


def version(spark: SparkSession, root: str, version_id: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of one version, an error where it was not made visible."""
    if spark.read.schema(VERSIONS).parquet(f"{root}/versions").where(F.col("version_id") == version_id).isEmpty():
        raise ValueError(f"no version {version_id}")
    pick = lambda name: spark.read.parquet(f"{root}/{name}/version_id={version_id}").withColumn("version_id", F.lit(version_id))
    return pick("nodes"), pick("edges")


def compare(spark: SparkSession, root: str, before: str, after: str) -> DataFrame:
    """``part, key, change, fields``: nodes and edges that were added, removed or changed from one version to another."""
    parts = []
    for part, key, a, b in zip(("nodes", "edges"), ("node_key", "edge_key"), version(spark, root, before), version(spark, root, after)):
        parts.append(difference(a.drop("version_id"), b.drop("version_id"), key).select(F.lit(part).alias("part"), F.col(key).alias("key"), "change", "fields"))
    return parts[0].unionByName(parts[1])


def restore(spark: SparkSession, root: str, version_id: str, label: str = "", entered_by: str = "", password: str | None = None, secret: str | None = None) -> str:
    """Publishes an earlier version's nodes and edges once more, as the newest version of its area, and returns the new id; nothing that was
    written before is touched.  A community version needs the ``secret`` again."""
    nodes, edges = version(spark, root, version_id)
    old = spark.read.schema(VERSIONS).parquet(f"{root}/versions").where(F.col("version_id") == version_id).first()
    return publish(nodes.drop("version_id"), edges.drop("version_id"), root, old.tambon_id, old.source, label or f"restored from {version_id}", entered_by, password, secret)


def shown(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A published diagram for use: an error where it has no nodes."""
    if nodes.isEmpty():
        raise ValueError("the diagram is empty")
    return nodes, edges


def send_version(nodes: DataFrame, edges: DataFrame, area: str, label: str, entered_by: str, post) -> bool:
    """Sends a diagram, small enough to show, to a remote procedure; ``post(body)`` gives the status.  False where it is refused."""
    rows = lambda df: [json.loads(r.v) for r in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("v")).toLocalIterator()]
    return post(json.dumps({"p_tambon_id": area, "p_label": label, "p_entered_by": entered_by, "p_nodes": rows(nodes), "p_edges": rows(edges)}, ensure_ascii=False)) < 300
