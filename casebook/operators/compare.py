"""Comparison of runs (A15-A19, L12, T18-T21, P4-P12 data)."""

from __future__ import annotations

import logging
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

log = logging.getLogger(__name__)


def runs(metrics: list[tuple[str, DataFrame]], names: list[str]) -> DataFrame:
    """One-row metric frames of several runs as (run, metric, value); a metric that a run lacks is null."""
    made = []
    for run, df in metrics:
        pairs = F.array(*(F.struct(F.lit(n).alias("metric"), (F.col(n) if n in df.columns else F.lit(None)).cast("double").alias("value")) for n in names))
        made.append(df.select(F.lit(run).alias("run"), F.explode(pairs).alias("p")).select("run", "p.metric", "p.value"))
    return reduce(DataFrame.union, made)


def melted(wide: DataFrame, names: list[str]) -> DataFrame:
    """L12 for runs that are rows of one frame: (run, metric, value); a metric that the frame lacks is null."""
    pairs = F.array(*(F.struct(F.lit(n).alias("metric"), (F.col(n) if n in wide.columns else F.lit(None)).cast("double").alias("value")) for n in names))
    return wide.select("run", F.explode(pairs).alias("p")).select("run", "p.metric", "p.value")


def matrix(long: DataFrame, names: list[str], rename: dict[str, str] | None = None, run_names: dict[str, str] | None = None) -> DataFrame:
    """Runs by metrics, renamed for display."""
    wide = long.groupBy("run").pivot("metric", names).agg(F.first("value"))
    if run_names:
        shown = F.coalesce(*(F.when(F.col("run") == a, F.lit(b)) for a, b in run_names.items()), F.col("run"))
        wide = wide.withColumn("run", shown)
    return wide.select("run", *(F.col(n).alias((rename or {}).get(n, n)) for n in names))


def select_columns(df: DataFrame, wanted: list[str], rename: dict[str, str] | None = None) -> DataFrame:
    """Columns by metric or display name; missing ones are logged and skipped."""
    rename = rename or {}
    kept = []
    for name in wanted:
        column = name if name in df.columns else rename.get(name)
        if column in df.columns:
            kept.append(column)
        else:
            log.warning("no column %s to select", name)
    return df.select("run", *kept)


def of_runs(df: DataFrame, prefixes: list[str]) -> DataFrame:
    """Rows whose run starts with one of the prefixes; all rows without prefixes."""
    return df.where(reduce(lambda a, b: a | b, (F.col("run").startswith(p) for p in prefixes))) if prefixes else df


def first_rows(df: DataFrame, flag: str) -> DataFrame:
    """Rows flagged as the first of their case."""
    return df.where(F.coalesce(F.col(flag), F.lit(False)))


def without_label(df: DataFrame, column: str, label: str) -> DataFrame:
    """Rows with another label."""
    return df.where(F.col(column) != label)


def group_accuracy(report: DataFrame, truth: str, pred: str) -> DataFrame:
    """Of each true value, how often the prediction equals it, and n; numbers by their canonical text."""

    def canonical(c: Column) -> Column:
        text = F.trim(c.cast("string"))
        return F.coalesce(F.when(text.rlike(r"^\d+(\.0+)?$"), text.try_cast("double").cast("bigint").cast("string")), text)

    rows = report.select(canonical(F.col(truth)).alias("group"), canonical(F.col(pred)).alias("_pred")).where(F.col("group").isNotNull())
    return rows.groupBy("group").agg(F.count("*").alias("n"), F.avg(F.coalesce(F.col("group") == F.col("_pred"), F.lit(False)).cast("double")).alias("accuracy"))


def group_matrix(long: DataFrame, run_order: list[str]) -> DataFrame:
    """(run, group, n, accuracy) as a row for each group, with n of the first run that has it."""
    wide = long.groupBy("group").pivot("run", run_order).agg(F.first("accuracy"))
    place = F.coalesce(*(F.when(F.col("run") == r, F.lit(k)) for k, r in enumerate(run_order)))
    counts = long.where(place.isNotNull()).groupBy("group").agg(F.min(F.struct(place.alias("k"), F.col("n"))).alias("f")).select("group", F.col("f.n").alias("n"))
    return wide.join(counts, "group", "left").select("group", "n", *(F.col(r) for r in run_order))


def label_frequencies(df: DataFrame, name: Column, code: str) -> DataFrame:
    """How often each name occurs with each code, most frequent last within a code."""
    return df.groupBy(name.alias("name"), F.col(code).alias("code")).agg(F.count("*").alias("n")).orderBy("code", "n", "name")


def label_counts(df: DataFrame, case: str, name: Column, code: str) -> DataFrame:
    """Distinct cases, names and codes."""
    return df.agg(F.count_distinct(case).alias("n_cases"), F.count_distinct(name).alias("n_names"), F.count_distinct(code).alias("n_codes"))


def error_stack(wide: DataFrame, parts: list[str], rest: str = "Other") -> DataFrame:
    """Error shares for a stacked bar: parts null in every run go, other nulls are 0, the rest fills up to 1, nothing below 0."""
    some = wide.agg(*(F.count(p).alias(p) for p in parts)).first()
    kept = [p for p in parts if some[p]]
    filled = wide.select("run", *(F.coalesce(F.col(p), F.lit(0.0)).alias(p) for p in kept))
    left = F.lit(1.0) - sum((F.col(p) for p in kept), F.lit(0.0))
    return filled.select("run", *(F.greatest(F.col(p), F.lit(0.0)).alias(p) for p in kept), F.greatest(left, F.lit(0.0)).alias(rest))


def paired(long: DataFrame, suffixes: tuple[str, str] = ("-om", "-cd")) -> DataFrame:
    """P5: bars of runs that come in pairs by the end of their name: base, variant, metric, value."""
    either = "|".join(re.escape(s) for s in suffixes)
    return long.select(F.regexp_replace("run", f"({either})$", "").alias("base"), F.regexp_extract("run", f"({either})$", 1).alias("variant"), "metric", "value")


def mcc_bars(long: DataFrame) -> DataFrame:
    """Bars of correlations, (run, flag, value); flags that a run lacks are blank."""
    return long.where(F.col("metric").endswith("_mcc")).select("run", F.regexp_replace("metric", "_mcc$", "").alias("flag"), "value")


def given_bars(long: DataFrame) -> DataFrame:
    """Bars of the accuracy where a group is right, (run, group, value)."""
    return long.where(F.col("metric").startswith("top1_given_")).select("run", F.regexp_replace("metric", "^top1_given_", "").alias("group"), "value")


def table(wide: DataFrame, digits: int = 4) -> DataFrame:
    """Numbers as text with fixed digits, nulls blank."""
    return wide.select("run", *(F.when(F.col(c).isNotNull(), F.format_string(f"%.{digits}f", F.col(c).cast("double"))).otherwise("").alias(c) for c in wide.columns if c != "run"))


def curves(sweep: DataFrame) -> DataFrame:
    """Accuracy and coverage over the threshold, a row for each series and threshold."""
    names = [c for c in sweep.columns if c == "coverage" or c.endswith("_accuracy")]
    pairs = F.array(*(F.struct(F.lit(n).alias("series"), F.col(n).alias("value")) for n in names))
    return sweep.select("threshold", F.explode(pairs).alias("p")).select("threshold", "p.series", "p.value").where("value is not null")


def tradeoff(sweep: DataFrame) -> DataFrame:
    """Each accuracy over coverage, a row for each series and threshold with anything above it."""
    pairs = F.array(*(F.struct(F.lit(n).alias("series"), F.col(n).alias("value")) for n in sweep.columns if n.endswith("_accuracy")))
    return sweep.select("coverage", F.explode(pairs).alias("p")).select("coverage", "p.series", "p.value").where("value is not null")


FIGURES = {"curves": curves, "tradeoff": tradeoff, "table": table, "paired": paired, "mcc": mcc_bars, "given": given_bars, "error_stack": error_stack, "group_matrix": group_matrix}


def figure(kind: str, df: DataFrame, **options) -> DataFrame:
    """The data of a figure by its kind."""
    if kind not in FIGURES:
        raise ValueError(f"unknown figure {kind!r}; known: {', '.join(sorted(FIGURES))}")
    return FIGURES[kind](df, **options)
