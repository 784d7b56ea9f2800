"""Cutting lineage through the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    A folder of our own is made only where the setting is absent and all of Spark runs in this one process, as in local tests;
    on a cluster, other machines could not see it, so its absence is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="casebook-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/casebook/{name}-{uuid.uuid4().hex}"


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.option("parquet.block.size", 32 << 20).parquet(path)  # a writer holds one block in memory
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    What was written survives the loss of any executor, and later stages don't repeat
    what came before.
    """
    return _written(df, new_path(df.sparkSession, name))


class Scratch:
    """Tables that are needed only until others, made from them, are stored: ``clear`` deletes them all."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.made = spark, new_path(spark, name), 0

    def store(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` as a stored table."""
        self.made += 1
        return _written(df, f"{self.path}/{self.made}-{name}")

    def clear(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame, text_col: str) -> int:
    """Bytes of all texts of a column, by which work is dealt to tasks of bounded size."""
    return int(docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0)


def parts(size: int, each: int) -> int:
    """How many parts of about ``each`` bytes ``size`` bytes make."""
    return max(1, -(-size // each))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or one made from it, that no column of ``df`` has."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name
