"""Stratified evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values.
STEPS, RARE_BELOW = 500, 2


def hard_cases(report: DataFrame, categories: dict[str, Column], metrics: list[Column]) -> DataFrame:
    """Metrics of overlapping categories, empty ones included, in the order given."""
    spark = report.sparkSession
    held = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in categories.items())))
    each = report.select("*", F.explode(held).alias("category")).groupBy("category").agg(F.count("*").alias("n"), *metrics)
    names = spark.range(1).select(F.posexplode(F.array(*(F.lit(n) for n in categories))).alias("position", "category"))
    out = names.join(each, "category", "left")
    return out.select("category", F.coalesce("n", F.lit(0)).alias("n"), *[c for c in each.columns if c not in ("category", "n")])


def error_partition(report: DataFrame, wrong: Column, causes: dict[str, Column]) -> DataFrame:
    """The share of errors with exactly each combination of causes; all combinations, or none without errors."""
    spark = report.sparkSession
    names = list(causes)
    counted = report.where(wrong).groupBy(*(F.coalesce(c, F.lit(False)).alias(n) for n, c in causes.items())).agg(F.count("*").alias("k"))
    grid = spark.range(1 << len(names)).select(*((F.shiftright("id", i) % 2 == 1).alias(n) for i, n in enumerate(reversed(names)))).select(*names)
    total = counted.agg(F.sum("k").alias("errors")).where("errors > 0")  # no row without errors
    label = F.concat_ws("+", *(F.when(F.col(n), F.lit(n)) for n in names))
    out = grid.join(counted, names, "left").join(total)
    return out.select(F.when(label == "", "none").otherwise(label).alias("combination"), F.coalesce("k", F.lit(0)).alias("n"), (F.coalesce("k", F.lit(0)) / F.col("errors")).alias("fraction"))


def rare_common(report: DataFrame, metrics: list[Column], code: str = "gt_code", below: int = RARE_BELOW) -> DataFrame:
    """Metrics of cases whose code is rare and of the others; a null code is common."""
    often = report.where(F.col(code).isNotNull()).groupBy(F.col(code).alias("_code")).agg(F.count("*").alias("_n"))
    out = report.join(often, F.col(code) == F.col("_code"), "left").withColumn("is_rare", F.coalesce(F.col("_n") < below, F.lit(False)))
    return out.groupBy("is_rare").agg(F.count("*").alias("n"), *metrics)


def by_group(report: DataFrame, column: str, metrics: list[Column]) -> DataFrame:
    """Metrics of each value that is not null."""
    return report.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("group")).agg(F.count("*").alias("n"), *metrics)


def by_groups(report: DataFrame, columns: list[str], metrics: list[Column]) -> DataFrame:
    """A9 for several columns at once, by grouping sets: level, group, n and metrics."""
    view = report.select("*", *(F.col(c).cast("string").alias(f"_g{i}") for i, c in enumerate(columns)))
    keys = [f"_g{i}" for i in range(len(columns))]
    out = view.groupingSets([[k] for k in keys], *keys).agg(F.grouping_id(*keys).alias("_id"), F.count("*").alias("n"), *metrics)
    # the only key of a set is the one bit that is 0
    full = (1 << len(keys)) - 1
    level = reduce(lambda acc, i: F.when(F.col("_id") == full - (1 << (len(keys) - 1 - i)), F.lit(columns[i])).otherwise(acc), range(len(keys)), F.lit(None))
    picked = F.coalesce(*keys)
    return out.select(level.alias("level"), picked.alias("group"), *[c for c in out.columns if c not in (*keys, "_id")]).where(F.col("group").isNotNull())


def threshold_sweep(report: DataFrame, hits: list[str], score: str = "pred_score", steps: int = STEPS) -> DataFrame:
    """Coverage and accuracy of rows with a score of at least each of ``steps`` thresholds from the least score to the greatest.

    Rows are counted by the last threshold that they reach; running sums from the top then give every threshold. The work is linear in the rows, and what is
    ordered is one row for each threshold.
    """
    spark = report.sparkSession
    rows = report.where(F.col(score).isNotNull()).select(F.col(score).cast("double").alias("s"), *hits)
    ends = rows.agg(F.min("s").alias("low"), F.max("s").alias("high"), F.count("*").alias("total"))
    last = steps - 1

    def threshold(i: Column) -> Column:
        return F.when(i >= last, F.col("high")).otherwise(F.col("low") + i * ((F.col("high") - F.col("low")) / F.lit(float(last))))

    width = (F.col("high") - F.col("low")) / F.lit(float(last))
    guess = F.when(width > 0, F.least(F.lit(last), F.floor((F.col("s") - F.col("low")) / F.nullif(width, F.lit(0.0))))).otherwise(F.lit(last)).cast("long")
    placed = rows.join(F.broadcast(ends)).withColumn("g", guess)  # one row is broadcast
    exact = F.when((F.col("g") < last) & (threshold(F.col("g") + 1) <= F.col("s")), F.col("g") + 1).when((F.col("g") > 0) & (threshold(F.col("g")) > F.col("s")), F.col("g") - 1).otherwise(F.col("g"))
    counted = placed.groupBy(exact.alias("id")).agg(F.count("*").alias("n"), *(F.count_if(F.col(h)).alias(h) for h in hits))
    grid = spark.range(steps).join(F.broadcast(ends.where("total > 0"))).withColumn("threshold", threshold(F.col("id")))
    above = Window.orderBy(F.desc("id")).rowsBetween(Window.unboundedPreceding, 0)
    joined = grid.join(counted, "id", "left")
    run = joined.select("id", "threshold", "total", *(F.sum(F.coalesce(c, F.lit(0))).over(above).alias(c) for c in ("n", *hits)))
    return run.select("id", "threshold", (F.col("n") / F.col("total")).alias("coverage"), *(F.when(F.col("n") > 0, F.col(h) / F.col("n")).alias(f"{h.removesuffix('_correct')}_accuracy") for h in hits))


def auc(sweep: DataFrame, accuracies: list[str], x: str = "coverage") -> DataFrame:
    """Area under each accuracy over coverage, by trapezoids between neighbouring thresholds."""
    w = Window.orderBy("id")
    steps = sweep.select(*((F.abs(F.col(x) - F.lag(x).over(w)) * (F.col(a) + F.lag(a).over(w)) / 2).alias(a) for a in accuracies))
    return steps.agg(*(F.sum(a).alias(f"auc_{a}") for a in accuracies))
