"""Metrics as lists of aggregate expressions (A1-A5).  Every stratification reuses them in one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook.functions.text import slug


def accuracy(hit: Column) -> Column:
    """A1: the mean of a boolean; null without rows."""
    return F.avg(hit.cast("double"))


def mcc(truth: Column, pred: Column) -> Column:
    """A2: Matthews correlation; null without rows, 0 where a margin is empty."""
    tp, tn = F.count_if(truth & pred).cast("double"), F.count_if(~truth & ~pred).cast("double")
    fp, fn = F.count_if(~truth & pred).cast("double"), F.count_if(truth & ~pred).cast("double")
    root = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return F.when(tp + tn + fp + fn > 0, F.when(root > 0, (tp * tn - fp * fn) / root).otherwise(0.0))


def conditional(hit: Column, given: Column) -> Column:
    """A4: accuracy where something else is right."""
    return F.avg(F.when(given, hit.cast("double")))


def columns(groups=(), top_k=(1, 3, 5), flags=(), container: str | None = None, names: dict[int, str] | None = None) -> list[Column]:
    """A3: the summary bundle over a report-level frame.  ``container`` is the prefix of container hits, null where none."""
    out = [accuracy(F.col(f"top{k}_correct")).alias(f"primary_top{k}_accuracy") for k in top_k]
    for flag in flags:
        out.append(accuracy(F.col(f"{flag}_correct")).alias(f"{flag}_accuracy"))
        out.append(mcc(F.col(f"gt_{flag}"), F.col(f"pred_{flag}")).alias(f"{flag}_mcc"))
    if container:
        out += [accuracy(F.col(f"{container}top{k}_correct")).alias(f"container_top{k}_accuracy") for k in top_k]
    for g in groups:
        name = slug((names or {}).get(g, f"group_{g}"))
        out += [accuracy(F.col(f"top{k}_group_{g}_correct")).alias(f"{name}_top{k}_accuracy") for k in top_k]
    return out


def given_group(groups) -> list[Column]:
    """A4 for each group level."""
    return [conditional(F.col("top1_correct"), F.col(f"top1_group_{g}_correct")).alias(f"top1_given_group_{g}") for g in groups]


def summary(report: DataFrame, groups=(), **bundle) -> DataFrame:
    """A5: n_cases and everything else, in one pass."""
    return report.agg(F.count("*").alias("n_cases"), *columns(groups, **bundle), *given_group(groups))


def melt(summary_: DataFrame, run: str | None = None) -> DataFrame:
    """A wide row of metrics as rows (run, metric, value)."""
    pairs = F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in summary_.columns))
    return summary_.select(F.lit(run).alias("run"), F.explode(pairs).alias("p")).select("run", "p.metric", "p.value")
