"""Workbooks of more rows than a sheet holds."""

from __future__ import annotations

import pytest

from casebook.sources import readers, sinks


def test_rows_beyond_a_sheet_go_on_in_further_ones(spark, tmp_path):
    path = f"{tmp_path}/large.xlsx"
    sinks.workbook(spark.range(1, 26).selectExpr("id AS Number", "concat('t', id) AS `Final Diagnosis`"), path, "All", most=10)
    got = readers.load_reports(spark, path, "*").orderBy("report_index").collect()
    assert [tuple(r) for r in got] == [(k, k, f"t{k}") for k in range(1, 26)]
    assert [readers.workbook(spark, path, s).count() for s in ("All", "All (2)", 2)] == [10, 10, 5]
    with pytest.raises(Exception, match="no sheet 'All \\(4\\)'"):
        readers.workbook(spark, path, "All (4)").count()
