"""Places of rows that a shuffle has dealt."""

from __future__ import annotations

from pyspark.sql import functions as F

from casebook.plans import roundtrips
from casebook.sources import readers
from tests.compare import difference

SF = "/root/testdata/sf0.01"


def test_keyed_lines_are_placed_however_partitions_are_put_together(spark):
    confs = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1"}
    for k, v in confs.items():
        spark.conf.set(k, v)
    try:
        assert difference(roundtrips.scan_keyed(spark, SF), roundtrips.ORACLE_SQL["scan_keyed"], SF) == ""
    finally:
        for k in confs:
            spark.conf.unset(k)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_places_go_by_ranges_of_numbers(spark):
    df = spark.range(0, 1000, 7).select((F.col("id") - 300).alias("n")).repartition(5)
    got = sorted((r["n"], r["k"]) for r in readers.placed(df, "n", "k", each=10).collect())
    assert got == [(n, k + 1) for k, n in enumerate(range(-300, 700, 7))]
