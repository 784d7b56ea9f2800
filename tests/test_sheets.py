"""Workbooks written and read by tasks, and rows whose key is their first."""

from __future__ import annotations

import zipfile

import pytest
from pyspark.sql import functions as F

from casebook.operators import merge
from casebook.sources import readers, sheets, sinks

ROWS = [(1, 1.5, True, " a<b>&\"c\" ", None), (2, None, None, None, "é😀\nline"), (None, -3.0, False, "", "x\x01y"), (10**15, 1e-9, True, "  ", "=1+1")]


@pytest.fixture
def made(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "n long, `Final Diagnosis` double, flag boolean, t string, u string").coalesce(1)
    path = f"{tmp_path}/book.xlsx"
    sinks.workbook(df, path, "Results & more")
    return path


def test_a_workbook_comes_back_as_text(spark, made):
    got = readers.workbook(spark, made).orderBy("row_num").collect()
    assert [tuple(r) for r in got] == [
        (1, "1", "1.5", "true", ' a<b>&"c" ', None),
        (2, "2", None, None, None, "é😀\nline"),
        (3, None, "-3.0", "false", "", "xy"),
        (4, "1000000000000000", "1e-09", "true", "  ", "=1+1"),
    ]
    assert readers.workbook(spark, made, "Results & more").count() == 4
    with pytest.raises(Exception, match="no sheet 'Other'"):
        readers.workbook(spark, made, "Other").count()


def test_a_sheet_is_read_in_ranges(spark, tmp_path):
    rows = "".join(f'<row r="{k}"><c r="A{k}" t="s"><v>{k % 2}</v></c><c r="C{k}"><v>{k}</v></c></row>' for k in range(3, 403) if k % 10)
    main = sheets._MAIN
    parts = {
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{sheets._OFFICE}"><sheets><sheet name="S" sheetId="1" r:id="a"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{sheets._PACKAGE}/relationships"><Relationship Id="a" Target="/xl/worksheets/one.xml"/></Relationships>',
        "xl/sharedStrings.xml": f'<sst xmlns="{main}"><si><r><t>ev</t></r><r><t>en</t></r></si><si><t>odd</t><rPh><t>aid</t></rPh></si><si><t> Name </t></si></sst>',
        "xl/worksheets/one.xml": f'<worksheet xmlns="{main}"><dimension ref="A2:C402"/><sheetData><row r="2"><c r="A2" t="s"><v>2</v></c><c r="B2"/><c r="C2" t="inlineStr"><is><t>Name</t></is></c></row>{rows}</sheetData></worksheet>',
    }
    path = f"{tmp_path}/ranged.xlsx"
    with zipfile.ZipFile(path, "w") as book:
        for name, text in parts.items():
            book.writestr(name, text)
    spark.dataSource.register(sheets.SheetSource)
    df = spark.read.format(sheets.FORMAT).option("rows", 50).load(f"file://{path}")
    assert df.columns == ["row_num", "Name", "column_2", "Name.1"] and df.rdd.getNumPartitions() == 9
    want = [(k - 2, "odd" if k % 2 else "even", None, str(k)) for k in range(3, 403) if k % 10]
    assert sorted(tuple(r) for r in df.collect()) == want


def test_a_failed_workbook_leaves_nothing(spark, tmp_path, monkeypatch):
    path = tmp_path / "never.xlsx"
    bad = spark.range(3).select(F.when(F.col("id") == 2, F.raise_error(F.lit("no"))).otherwise(F.col("id").cast("string")).alias("v"))
    with pytest.raises(Exception):  # noqa: B017
        sinks.workbook(bad, str(path))
    assert not path.exists()


def test_reports_of_a_workbook(spark, tmp_path):
    path = f"{tmp_path}/reports.xlsx"
    sinks.workbook(spark.createDataFrame([("7", " one "), (None, "two"), ("8", " "), (None, None)], "NUMBER string, ` final diagnosis` string"), path)
    got = readers.load_reports(spark, path).collect()
    assert [tuple(r) for r in got] == [(7, 1, "one"), (None, 2, "two")]


def test_bad_lines_are_named_by_number(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"case_id": 1}\n\n{"case_id": 2}\n"text"\n')
    with pytest.raises(Exception, match='line 4 is not a JSON object: "text"'):
        readers.keyed_jsonl(spark, str(tmp_path / "p.jsonl")).collect()


def test_first_rows_of_hot_and_missing_keys(spark):
    rows = [("hot", 5 * k + 3) for k in range(500)] + [(None, 7 * k + 11) for k in range(500)] + [("a", 2), ("b", 1), ("a", 1)]
    df = spark.createDataFrame(rows, "k string, row int").repartition(5)
    out = merge.first_occurrence(df, "k", "row")
    assert sorted((r["k"] or "", r["row"]) for r in out.where("is_first").collect()) == [("", 11), ("a", 1), ("b", 1), ("hot", 3)]
    assert out.count() == len(rows) and "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
