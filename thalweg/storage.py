"""Durable intermediate tables.

Iterative plans and plans with several consumers cut their lineage by writing Parquet into the folder that every
executor shares (``spark.checkpoint.dir``).  Nothing is ever kept only on an executor, so a lost executor costs a
re-read and no more.  The tables of an application lie in one folder, which is deleted when the program ends; tables that
nothing reads any more are deleted before, by :func:`forget`.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_FOLDERS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """This application's folder inside the one named by ``spark.checkpoint.dir``.  Only where that is unset, and the master is
    local, so that driver and executors are one process, it is a temporary folder of this machine."""
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            configured = "file://" + tempfile.mkdtemp(prefix="thalweg-")
        _FOLDERS[app] = f"{configured.rstrip('/')}/thalweg-{app}-{uuid.uuid4().hex[:8]}"
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        atexit.register(_clear, jvm, conf, _FOLDERS[app])
    return _FOLDERS[app]


def _clear(jvm, conf, folder: str) -> None:
    try:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
    except Exception:  # the Java side may be gone before the program ends
        pass


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: same rows, no lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_told(df: DataFrame, label: str, **told: Column) -> tuple[DataFrame, dict]:
    """As :func:`materialize`, and aggregates of the rows, taken while they are written; of an empty table they may be missing."""
    seen = Observation()
    out = materialize(df.observe(seen, *[c.alias(n) for n, c in told.items()]), label)
    return out, seen.get


def forget(*tables: DataFrame) -> None:
    """Delete the files behind tables made by :func:`materialize` (only inside the shared folder)."""
    for df in tables:
        spark = df.sparkSession
        base = shared_dir(spark)
        jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            if path.toUri().getPath().startswith(jvm.org.apache.hadoop.fs.Path(base).toUri().getPath() + "/"):
                path.getFileSystem(conf).delete(path, True)
