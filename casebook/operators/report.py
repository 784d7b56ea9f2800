"""The evaluation frames: truth joined with linked predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.functions import records
from casebook.operators.dictionary import pick

TOP_K = (1, 3, 5)


def report_level(truth: DataFrame, predictions: DataFrame, groups=records.GROUPS, top_k=TOP_K, flags=(), compat: bool = False) -> DataFrame:
    """One row for each case with truth and a prediction.

    ``truth``: case_id, row_num, gt_code, gt_group_<g> and gt_<flag>; its first row for a case counts.  ``predictions``: case_id,
    row_num, ranked and pred_<flag>; the last row counts, and cases without a prediction go.  ``compat`` leaves
    group 4 without hits beyond the first, as the studied code does.
    """
    t = pick(truth, "case_id", "row_num").drop("row_num")
    p = pick(predictions, "case_id", "row_num", last=True).drop("row_num").where(F.size("ranked") > 0)
    out = t.join(p, "case_id")
    made = {"pred_code": records.first(F.col("ranked"), "code"), "pred_name": records.first(F.col("ranked"), "name"), "pred_score": records.first(F.col("ranked"), "score")}
    for k in top_k:
        made[f"top{k}_correct"] = records.hit(F.col("gt_code"), records.codes(F.col("ranked"), k))
    for g in groups:
        made[f"pred_group_{g}"] = records.first(F.col("ranked"), f"group_{g}")
        for k in top_k:
            found = records.hit(F.col(f"gt_group_{g}"), records.groups(F.col("ranked"), g, k))
            made[f"top{k}_group_{g}_correct"] = F.lit(False) if compat and g == 4 and k > 1 else found
    for flag in flags:
        made[f"{flag}_correct"] = F.coalesce(F.col(f"gt_{flag}") == F.col(f"pred_{flag}"), F.lit(False))
    return out.withColumns(made).drop("ranked")


def scored(report: DataFrame) -> DataFrame:
    """Without rows that have no score."""
    return report.where(F.col("pred_score").isNotNull())


def container_level(report: DataFrame, ranked: str = "container_ranked", top_k=TOP_K) -> DataFrame:
    """Rows with a container's truth and prediction, their hits those of the container; group hits stay the report's."""
    own = {f"top{k}_correct": records.hit(F.col("gt_container_code"), records.codes(F.col(ranked), k)) for k in top_k}
    return report.where(F.col("gt_container_code").isNotNull() & (F.size(ranked) > 0)).withColumns(own)
