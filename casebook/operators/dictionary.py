"""The controlled dictionary and lookups in it.

A dictionary has a row for each synonym: code, name, group_1 .. group_4, and ``row_num``, its order.  Lookups are left
joins on a deduplicated side; Spark broadcasts that side when its size allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pick(df: DataFrame, key: str, order: str, last: bool = False) -> DataFrame:
    """One row for each key that is not null: the first by ``order``, or the last.

    An aggregation, so rows of a frequent key are reduced before they are shuffled.  Rows of a key with one order are not told apart.
    A row is taken whole, so ``df`` should have no column that isn't wanted: none can be pruned below the aggregation.
    """
    best = F.max_by if last else F.min_by
    whole = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    return df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_picked")).agg(best(whole, F.col(order)).alias("_row")).select("_row.*")


def terms(dictionary: DataFrame, name: str = "name") -> DataFrame:
    """S3: distinct trimmed names that are not blank."""
    return dictionary.select(F.trim(name).alias("term")).where("term <> ''").distinct()


def synonyms(dictionary: DataFrame, code: str = "code", name: str = "name") -> DataFrame:
    """Distinct sorted names of each code."""
    known = dictionary.select(F.col(code).alias("code"), F.trim(name).alias("name")).where("code is not null and name <> ''")
    return known.groupBy("code").agg(F.array_sort(F.collect_set("name")).alias("synonyms"))


def entries(dictionary: DataFrame, code: str = "code", name: str = "name") -> DataFrame:
    """A row for each code and distinct name, with all names of the code."""
    return synonyms(dictionary, code, name).select("code", F.explode("synonyms").alias("description"), "synonyms")


def _side(dictionary: DataFrame, key: Column, values: dict[str, str], order: str, last: bool) -> DataFrame:
    """The dictionary's first or last row for each key: ``_key`` and the wanted values, of which alone anything is read."""
    wanted = dictionary.select(key.alias("_key"), F.col(order).alias("_order"), *(F.col(v).alias(f"_value_{k}") for k, v in values.items()))
    return pick(wanted, "_key", "_order", last).drop("_order")


def lookup(df: DataFrame, on: Column, dictionary: DataFrame, key: Column, values: dict[str, str], order: str = "row_num", last: bool = False) -> DataFrame:
    """``df`` with columns of the first or last dictionary row whose ``key`` equals ``on``; null where there is none.

    L2 and L5 take the last row, by name or by match key; L3 the first, by code.
    """
    joined = df.withColumn("_on", on).join(_side(dictionary, key, values, order, last), F.col("_on") == F.col("_key"), "left")
    kept = [c for c in df.columns if c not in values]
    return joined.select(*kept, *(F.col(f"_value_{k}").alias(k) for k in values))


def overwrite_on_hit(df: DataFrame, on: Column, dictionary: DataFrame, key: Column, values: dict[str, str], order: str = "row_num") -> DataFrame:
    """L4: existing columns replaced where the dictionary has the key, by its last row, and kept where not."""
    joined = df.withColumn("_on", on).join(_side(dictionary, key, values, order, True), F.col("_on") == F.col("_key"), "left")
    return joined.select(*(F.when(F.col("_key").isNotNull(), F.col(f"_value_{c}")).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns))


def mapping(dictionary: DataFrame, source: str, target: str, order: str = "row_num") -> DataFrame:
    """Source to target, the last row wins; numbers by their canonical text."""
    text = F.col(source).cast("string")
    key = F.coalesce(F.when(text.rlike(r"^\d+(\.0+)?$"), text.try_cast("double").cast("bigint").cast("string")), F.trim(text))
    return _side(dictionary, key, {"target": target}, order, True).select(F.col("_key").alias("source"), F.col("_value_target").alias("target"))
