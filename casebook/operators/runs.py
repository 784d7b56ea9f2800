"""Runs of a model over reports that can stop anywhere and go on.

A run has a folder.  Reports without a committed answer are dealt to batches, each read, answered, validated and stored on its own, and
committed by one small file of its manifest, which is renamed into place.  Whatever is lost, executor or driver, no answer of a committed
batch is asked for again; what an interrupted batch left is in no manifest, is read by nobody, and goes when the run goes on.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook import schemas
from casebook.operators import extraction
from casebook.sources import sinks

#: Reports of a batch: what the loss of a driver costs at most.
BATCH = 100_000
_MANIFEST = "batch string, n_good long, n_broken long"


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _exists(spark: SparkSession, name: str) -> bool:
    fs, path = _path(spark, name)
    return fs.exists(path)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The committed batches, with their counts of good and broken records."""
    if not _exists(spark, f"{folder}/manifest"):
        return spark.createDataFrame([], _MANIFEST)
    return spark.read.schema(_MANIFEST).json(f"{folder}/manifest")


def _commit(spark: SparkSession, folder: str, batch: str, counts: dict[str, int]) -> None:
    fs, made = _path(spark, f"{folder}/manifest/_{batch}")  # readers skip names with an underscore
    out = fs.create(made, True)
    out.write(bytearray(json.dumps({"batch": batch, **counts}).encode() + b"\n"))
    out.close()
    if not fs.rename(made, spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest/{batch}.json")):
        raise RuntimeError(f"batch {batch} of {folder} could not be committed")


def answers(spark: SparkSession, folder: str) -> DataFrame | None:
    """All answers of committed batches, with their ``batch``; none before the first."""
    done = manifest(spark, folder)
    if not done.take(1):
        return None
    read = spark.read.option("mergeSchema", False).parquet(f"{folder}/answers")
    return read.withColumn("batch", F.col("batch").cast("string")).join(F.broadcast(done.select("batch")), "batch", "left_semi")


def pending(reports: DataFrame, folder: str, key: str = "report_index") -> DataFrame:
    """Reports without a committed answer.  A report without a key could not be told from others, so it is an error."""
    known = F.when(F.col(key).isNull(), F.raise_error(F.lit(f"a report has no {key}"))).otherwise(True)
    reports = reports.where(known.cast("boolean"))
    done = answers(reports.sparkSession, folder)
    return reports if done is None else reports.join(done.select(key), key, "left_anti")


def resume(reports: DataFrame, template: str, model: extraction.Backend, folder: str, key: str = "report_index", version: str = schemas.DEFAULT, vocabulary: list[str] | None = None, size: int = BATCH, most: int | None = None) -> int:
    """Answer what is pending in batches of about ``size`` reports, at most ``most`` of them now; returns how many were committed."""
    spark = reports.sparkSession
    for part in ("todo", "answers"):  # what an interrupted batch left
        _clear(spark, folder, part)
    todo, number = pending(reports, folder, key), uuid.uuid4().hex[:12]
    n = todo.count()
    if not n:
        return 0
    batches = -(-n // size)
    # each batch is a folder, so that it reads its own reports only
    dealt = todo.withColumn("batch", F.concat(F.lit(f"{number}-"), F.pmod(F.xxhash64(key), F.lit(batches)).cast("string")))
    dealt.repartition("batch").write.partitionBy("batch").parquet(f"{folder}/todo/{number}")
    fs, base = _path(spark, f"{folder}/todo/{number}")
    names = sorted(f.getPath().getName().removeprefix("batch=") for f in fs.listStatus(base) if f.isDirectory())
    for batch in names[:most]:
        own = spark.read.schema(todo.schema).parquet(f"{folder}/todo/{number}/batch={batch}")
        own = own.repartition(max(1, spark.sparkContext.defaultParallelism))
        made = extraction.validate(extraction.generate(extraction.prompts(own, template), model), version, vocabulary)
        _, counts = extraction.stored(made, f"{folder}/answers/batch={batch}")
        _commit(spark, folder, batch, counts)
    return len(names[:most])


def _clear(spark: SparkSession, folder: str, part: str) -> None:
    """Delete what is in no manifest."""
    fs, base = _path(spark, f"{folder}/{part}")
    if not fs.exists(base):
        return
    if part == "todo":
        fs.delete(base, True)
        return
    done = {f"batch={r['batch']}" for r in manifest(spark, folder).toLocalIterator()}
    for found in fs.listStatus(base):
        if found.getPath().getName() not in done:
            fs.delete(found.getPath(), True)


def publish(spark: SparkSession, folder: str, target: str) -> dict[str, int]:
    """K2, K4: the good records and the broken ones of all committed batches at ``target``, and how many there are (A20).  No good one is an error."""
    done = answers(spark, folder)
    if done is not None:
        good, broken = extraction.split(done)
        sinks.records(good, target, mode="overwrite")
        sinks.broken(broken, target, mode="overwrite")
    counts = manifest(spark, folder).agg(F.coalesce(F.sum("n_good"), F.lit(0)).alias("n_good"), F.coalesce(F.sum("n_broken"), F.lit(0)).alias("n_broken"))
    extraction.require_success(counts)
    return counts.first().asDict()
