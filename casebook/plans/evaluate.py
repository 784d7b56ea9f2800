"""The evaluation of a run and the comparison of runs, end to end."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook.functions import records
from casebook.operators import confusion, metrics, report, stratify
from casebook.sources import sinks


@dataclass(frozen=True)
class Settings:
    """What to evaluate."""

    groups: tuple[int, ...] = records.GROUPS
    top_k: tuple[int, ...] = report.TOP_K
    flags: tuple[str, ...] = ()
    rare_below: int = stratify.RARE_BELOW
    steps: int = stratify.STEPS
    exclude_failed: bool = True
    hard: dict[str, Column] = field(default_factory=dict)
    causes: dict[str, Column] = field(default_factory=dict)


def evaluate(truth: DataFrame, predictions: DataFrame, settings: Settings) -> dict[str, DataFrame]:
    """Every frame of an evaluation by name.  ``report_level`` feeds all others; persist it where it is dear."""
    frame = report.report_level(truth, predictions, settings.groups, settings.top_k, settings.flags)
    if settings.exclude_failed:
        frame = report.scored(frame)
    bundle = metrics.columns(settings.groups, settings.top_k, settings.flags)
    hits = [f"top{k}_correct" for k in settings.top_k]
    sweep = stratify.threshold_sweep(frame, hits, steps=settings.steps)
    out = {
        "report_level": frame,
        "summary": metrics.summary(frame, settings.groups, top_k=settings.top_k, flags=settings.flags),
        "rare_common": stratify.rare_common(frame, bundle, below=settings.rare_below),
        "groups": stratify.by_groups(frame, [f"gt_group_{g}" for g in settings.groups], bundle),
        "thresholds": sweep,
        "auc": stratify.auc(sweep, [f"top{k}_accuracy" for k in settings.top_k]),
        "confusion": confusion.normalized(frame, "gt_code", "pred_code"),
    }
    if settings.hard:
        out["hard_cases"] = stratify.hard_cases(frame, settings.hard, bundle)
    if settings.causes:
        out["errors"] = stratify.error_partition(frame, ~F.col("top1_correct"), settings.causes)
    return out


def write(frames: dict[str, DataFrame], folder: str, wanted: set[str] | None = None) -> None:
    """Frames as CSV, the summary as JSON too."""
    sinks.csvs(frames, folder, wanted)
    if wanted is None or "summary" in wanted:
        sinks.one_row_json(frames["summary"], f"{folder}/summary.json")
