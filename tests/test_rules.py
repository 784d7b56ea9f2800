"""Rules in place of a model."""

from pyspark.sql import functions as F

from casebook.operators import rules


def test_rules(spark):
    df = spark.createDataFrame([("A. Skin: fine.\nB & C: node, excision is recommended.\n(AB12-345; 1/1/2002) x\nA: again",), ("Carcinoma.",), (None,)], "t string")
    got = df.select(rules.definitive(F.col("t")).alias("d"), rules.container_labels(F.col("t")).alias("l"), rules.flag(F.col("t"), "node", True).alias("n"), rules.flag(F.col("t"), "node", False).alias("f")).collect()
    assert got[0]["d"] is False and got[0]["l"] == ["A", "B & C", "AB12-345"] and got[0]["n"] is True
    assert got[1]["d"] is True and got[1]["l"] == [] and got[1]["n"] is None and got[1]["f"] is False
    assert got[2]["d"] is None


def test_priorities(spark):
    df = spark.createDataFrame([([("a", False), ("b", True)],)], "c array<struct<label:string,node:boolean>>")
    got = df.select(rules.by_priority(F.col("c"), [lambda x: x["label"] == "z", lambda x: x["node"], lambda x: F.lit(True)])["label"].alias("x")).first()
    assert got["x"] == "b"
    pair = lambda k: F.struct(F.lit(k).alias("code"), F.lit(f"n{k}").alias("name"))
    staged = rules.staged(F.when(F.lit(False), pair(1)), pair(2), pair(3))
    assert df.select(staged.alias("x")).first()["x"]["name"] == "n2"
