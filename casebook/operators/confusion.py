"""Confusion matrices and label order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normalized(rows: DataFrame, truth: str, pred: str) -> DataFrame:
    """Of each true label, the share of each predicted one, over all labels of either side; rows with nulls go.

    One row for each pair of labels, of which there are as many as the matrix has cells.
    """
    known = rows.where(F.col(truth).isNotNull() & F.col(pred).isNotNull()).select(F.col(truth).cast("string").alias("truth"), F.col(pred).cast("string").alias("pred"))
    cells = known.groupBy("truth", "pred").agg(F.count("*").alias("n"))
    label = cells.select(F.col("truth").alias("label")).union(cells.select("pred")).distinct()
    grid = label.select(F.col("label").alias("truth")).join(label.select(F.col("label").alias("pred")))
    full = grid.join(cells, ["truth", "pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy("truth"))
    return full.withColumn("share", F.when(total > 0, F.col("n") / total).otherwise(0.0))


def pivot(cells: DataFrame, labels: list[str], value: str = "share") -> DataFrame:
    """The matrix with a column for each of the given labels."""
    return cells.groupBy("truth").pivot("pred", labels).agg(F.first(value))


def major_groups(rows: DataFrame, sides: list[tuple[str, str]]) -> DataFrame:
    """The major group of each label by a vote in which each side counts each of its distinct groups once.

    ``sides`` are (label, major) columns; ties go to the earlier side, then the smaller name.
    """
    votes = None
    for k, (label, major) in enumerate(sides):
        one = rows.select(F.col(label).cast("string").alias("label"), F.col(major).cast("string").alias("major")).where("label is not null and major is not null").distinct().withColumn("side", F.lit(k))
        votes = one if votes is None else votes.union(one)
    counted = votes.groupBy("label", "major").agg(F.count("*").alias("votes"), F.min("side").alias("side"))
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("votes"), "side", "major"))
    return counted.withColumn("_rank", rank).where("_rank = 1").select("label", "major", "votes")


def ordered(labels: DataFrame) -> DataFrame:
    """Positions of labels (label, major) by major group, then name; labels without a group last."""
    key = (F.col("major").isNull(), F.col("major"), F.col("label"))
    return labels.withColumn("position", F.row_number().over(Window.orderBy(*key)) - 1)


def blocks(positions: DataFrame) -> DataFrame:
    """First and last position of each run of labels with one major group."""
    w = Window.orderBy("position")
    starts = positions.withColumn("_new", F.when(F.lag("position").over(w).isNull() | ~F.lag("major").over(w).eqNullSafe(F.col("major")), 1).otherwise(0))
    runs = starts.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("_run", "major").agg(F.min("position").alias("first"), F.max("position").alias("last"), F.count("*").alias("n_labels")).drop("_run")


def literal_match(truth: Column, pred: Column) -> Column:
    """The marker of a prediction that equals the truth by match key."""
    from casebook.functions.text import match_key

    return F.when(F.coalesce(match_key(truth) == match_key(pred), F.lit(False)), F.lit("literal_match"))
