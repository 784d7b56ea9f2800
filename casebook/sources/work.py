"""A folder for tables of one query's own, where driver and executors both reach it."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

_KEPT: dict[str, object] = {}


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``; a folder of this machine only where all of Spark runs in this process.

    Results are read from such tables as late as they are asked for, so they go when the application ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="casebook-work-")
        spark.conf.set("spark.checkpoint.dir", base)
    own = f"{base.rstrip('/')}/casebook/{spark.sparkContext.applicationId}"
    if own not in _KEPT:
        path = spark._jvm.org.apache.hadoop.fs.Path(own)
        _KEPT[own] = (path, spark._jsc.hadoopConfiguration())
        if len(_KEPT) == 1:
            atexit.register(delete_all)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def delete_all() -> None:
    """Delete the tables of this process's applications; what cannot be reached any more is left."""
    while _KEPT:
        _, (path, conf) = _KEPT.popitem()
        try:
            path.getFileSystem(conf).delete(path, True)
        except Exception:  # the JVM is gone, or the store
            return
