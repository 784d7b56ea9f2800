"""Readers, writers, the stream and the evaluation plan."""

import json

import pytest
from pyspark.sql import functions as F

from casebook import schemas
from casebook.operators import extraction
from casebook.plans import evaluate
from casebook.sources import readers, sinks
from casebook.streaming import extract
from tests.test_operators import report_frame


def test_text_lines(spark, tmp_path):
    (tmp_path / "r.txt").write_text("line one\n\n  line two \n")
    got = readers.load_reports(spark, str(tmp_path / "r.txt")).orderBy("report_index").collect()
    assert [(r["case_id"], r["report_index"], r["text"]) for r in got] == [(None, 1, "line one"), (None, 2, "line two")]
    (tmp_path / "e.txt").write_text("\n")
    with pytest.raises(ValueError, match="no reports"):
        readers.load_reports(spark, str(tmp_path / "e.txt"))


def test_sheet_rules(spark):
    df = spark.createDataFrame([("1.0", " a "), (None, "b"), ("2", " "), (None, None)], "Number string, `Final Diagnosis` string")
    assert [tuple(r) for r in readers.reports(df).collect()] == [(1, 1, "a"), (None, 2, "b")]
    with pytest.raises(Exception, match="not a whole number"):
        readers.reports(df.withColumn("Number", F.lit("1.5"))).collect()
    with pytest.raises(ValueError, match="missing columns: Report"):
        readers.require(df, "Report")


def test_numbered_over_partitions(spark):
    got = readers.numbered(spark.range(0, 100, 1, 7).where("id % 3 = 0"), "n").orderBy("n").collect()
    assert [(r["id"], r["n"]) for r in got] == [(3 * k, k + 1) for k in range(34)]


def test_keyed_jsonl(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"case_id": 2, "v": 1}\n\n{"case_id": "1"}\n{"case_id": 2.0, "v": 3}\n{"v": 4}\n')
    got = readers.keyed_jsonl(spark, str(tmp_path / "p.jsonl")).orderBy("first_line").collect()
    assert [(r["case_id"], json.loads(r["value"]).get("v")) for r in got] == [("2", 3), ("1", None)]
    (tmp_path / "bad.jsonl").write_text("[1]\n")
    with pytest.raises(Exception, match="not a JSON object"):
        readers.keyed_jsonl(spark, str(tmp_path / "bad.jsonl")).collect()


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text('{"a": 2}')
    assert readers.config(str(tmp_path / "c.yaml"), {"a": 1, "b": 3}) == {"a": 2, "b": 3}
    with pytest.raises(ValueError, match="unknown settings: a"):
        readers.config(str(tmp_path / "c.yaml"), {"b": 3})
    with pytest.raises(ValueError, match="allowed"):
        readers.config(str(tmp_path / "c.yaml"), {"a": 1}, {"a": {1}})


def test_prompt_template(tmp_path):
    (tmp_path / "extraction_v5.txt").write_text("E")
    assert readers.prompt_template(str(tmp_path), "v5") == "E"
    (tmp_path / "prompt_v5.txt").write_text("P")
    assert readers.prompt_template(str(tmp_path), "v5") == "P"
    with pytest.raises(FileNotFoundError):
        readers.prompt_template(str(tmp_path), "v6")


def test_metrics_and_sections(spark, tmp_path):
    (tmp_path / "run1").mkdir()
    (tmp_path / "run1" / "summary.json").write_text('{"a": 0.5}')
    got = readers.metrics(spark, [str(tmp_path / "run1" / "summary.json")], ["a", "b"]).collect()
    assert {(r["run"], r["metric"], r["value"]) for r in got} == {("run1", "a", 0.5), ("run1", "b", None)}
    df = spark.createDataFrame([("intro\n# A\nx\n## B\ny",)], "t string")
    assert [r["section_text"].split("\n")[0] for r in readers.sections(df, "t").collect()] == ["intro", "# A", "## B"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, [("a",)])], "k int, c array<struct<v:string>>")
    sinks.csvs({"x": df, "y": df}, str(tmp_path), {"x"}, one_file=True)
    assert spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/x").first()["c"] is not None and not (tmp_path / "y").exists()
    assert sinks.one_row_json(df, str(tmp_path / "one.json"))["k"] == 1
    sinks.reset(spark, str(tmp_path / "x"))
    assert not list((tmp_path / "x").iterdir())
    with pytest.raises(Exception, match="not 3 wide"):
        sinks.vectors(spark.createDataFrame([([1.0],)], "v array<double>"), str(tmp_path / "v"), "v", 3)


def test_stream_takes_each_file_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"case_id": 1, "report_index": 1, "text": "{\\"primary_diagnosis\\": \\"A\\"}"}\n{"report_index": 2, "text": "x"}\n')
    run = lambda: extract.start(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), "{input_text}", extraction.Echo()).awaitTermination(120)
    run()
    (tmp_path / "in" / "b.json").write_text('{"case_id": 3, "report_index": 3, "text": "{}"}\n')
    run()
    good = spark.read.schema(schemas.get("v5")).json(f"{tmp_path}/out/batch=*/predictions")
    assert sorted(r["case_id"] for r in good.collect()) == [1, 3]
    assert spark.read.json(f"{tmp_path}/out/batch=*/broken").count() == 1


def test_evaluation_plan(spark, tmp_path):
    frame = report_frame(spark)
    truth = frame.select("case_id", F.lit(1).alias("row_num"), "gt_code", "gt_group_1")
    ranked = F.array(F.struct(F.lit(1).alias("rank"), F.col("pred_code").alias("code"), F.lit("n").alias("name"), F.col("pred_score").alias("score"), *(F.lit(None).cast("string").alias(f"group_{g}") for g in (1, 2, 3, 4))))
    pred = frame.select("case_id", F.lit(1).alias("row_num"), ranked.alias("ranked"))
    frames = evaluate.evaluate(truth, pred, evaluate.Settings(groups=(1,), top_k=(1,), hard={"all": F.lit(True)}, causes={"X": F.lit(True)}))
    evaluate.write(frames, str(tmp_path), {"summary", "rare_common"})
    assert json.loads((tmp_path / "summary.json").read_text())["primary_top1_accuracy"] == 0.5
    assert frames["hard_cases"].first()["n"] == 2 and frames["errors"].where("combination = 'X'").first()["fraction"] == 1.0
