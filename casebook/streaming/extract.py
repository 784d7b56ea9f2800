"""Extraction as a stream of report files: every file once, with good and broken records appended batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from casebook import schemas
from casebook.operators import extraction
from casebook.sources import sinks

REPORT = T.StructType([T.StructField("case_id", T.LongType()), T.StructField("report_index", T.LongType()), T.StructField("text", T.StringType())])


def start(spark: SparkSession, source: str, target: str, checkpoint: str, template: str, model: extraction.Backend, version: str = schemas.DEFAULT, vocabulary: list[str] | None = None, once: bool = True) -> StreamingQuery:
    """Start the stream: JSON report files of ``source`` to ``target``; a restart goes on after what ``checkpoint`` has."""

    def handle(batch: DataFrame, number: int) -> None:
        made = extraction.validate(extraction.generate(extraction.prompts(batch, template), model), version, vocabulary)
        # answers feed two sinks, from a table that the loss of an executor leaves; a batch that runs again overwrites what it wrote
        done, _ = extraction.stored(made, f"{target}/answers/batch={number}")
        good, broken = extraction.split(done)
        sinks.records(good, f"{target}/batch={number}", mode="overwrite")
        sinks.broken(broken, f"{target}/batch={number}", mode="overwrite")

    writer = spark.readStream.schema(REPORT).json(source).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
