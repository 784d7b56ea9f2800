"""Text, payload and record functions on small inline cases."""

import pytest
from pyspark.sql import functions as F

from casebook import schemas
from casebook.functions import payload, records, text


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("given", "want"),
    [("  Ünï\tCODE\n x ", "ünï code x"), ("ﬁne Â\xa0b", "fine â b"), ("", ""), (None, None), ("a\x07b", "a b"), ("①", "1")],
)
def test_standardize(spark, given, want):
    assert one(spark, text.standardize(F.col("t").cast("string")), t=given) == want


@pytest.mark.parametrize(("given", "want"), [("B-cell,  NOS", "b cell nos"), ("", ""), ("Ｆull", "full")])
def test_alphanumeric(spark, given, want):
    assert one(spark, text.alphanumeric(F.col("t")), t=given) == want


@pytest.mark.parametrize(("given", "want"), [("007", "7"), ("12.0", "12"), (" x1 ", "x1"), ("", None), ("0", "0"), ("12.5", "12.5")])
def test_case_id(spark, given, want):
    assert one(spark, text.case_id(F.col("t")), t=given) == want


@pytest.mark.parametrize(("given", "want"), [("Yes", True), (" no ", False), ("1", True), ("0.0", False), (None, False), ("2", True)])
def test_truth(spark, given, want):
    assert one(spark, text.truth(F.col("t").cast("string")), t=given) is want


def test_truth_rejects_other_words(spark):
    with pytest.raises(Exception, match="not a boolean"):
        one(spark, text.truth(F.col("t")), t="perhaps")


def test_same_key_is_false_for_nulls(spark):
    assert one(spark, text.same_key(F.col("a").cast("string"), F.col("b")), a=None, b="x") is False
    assert one(spark, text.same_key(F.col("a"), F.col("b")), a=" X\t", b="x") is True


def test_fill_template(spark):
    assert one(spark, text.fill_template("A {input_text} B {input_text}", F.col("t")), t="x{1}$") == "A x{1}$ B x{1}$"
    with pytest.raises(ValueError, match="lacks"):
        text.fill_template("nothing", F.lit(""))


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ('<unused94>thought<unused95>{"a": 1}', '{"a": 1}'),
        ('```json\n{"a": 1}\n```', '{"a": 1}'),
        ('Here is the result:\n{"a": 1}\nThanks.', '{"a": 1}'),
        ('{"a": 1} Thanks.', '{"a": 1}'),
        ("this is not json", None),
        ('{"a": ', None),
        (None, None),
    ],
)
def test_recover(spark, raw, want):
    row = payload.recover(spark.createDataFrame([(raw,)], "raw string"), "raw").first()
    assert row["payload"] == want
    assert (row["error"] is None) == (want is not None)


def parse(spark, body, version="v5"):
    return payload.parse(spark.createDataFrame([(body,)], "payload string"), "payload", version).first()


def test_parse_coerces_plain_text(spark):
    r = parse(spark, '{"schema_version": "v5", "case_id": 12.0, "is_definitive": "true", "containers": [{"label": "A", "is_lymph_node": 0}]}')
    assert r["errors"] == []
    assert (r["record"]["case_id"], r["record"]["is_definitive"], r["record"]["containers"][0]["is_lymph_node"]) == (12, True, False)


@pytest.mark.parametrize(
    ("body", "part"),
    [
        ('{"schema_version": "v1"}', "schema_version"),
        ('{"is_definitive": "perhaps"}', "is_definitive"),
        ('{"case_id": 1.5}', "case_id"),
        ('{"containers": [{"is_lymph_node": false}, {"is_lymph_node": "x"}]}', "containers[1].is_lymph_node"),
        ("null", "Invalid JSON"),
    ],
)
def test_parse_errors(spark, body, part):
    r = parse(spark, body)
    assert r["record"] is None and any(part in e for e in r["errors"])


def test_parse_limits_of_v2(spark):
    assert parse(spark, '{"confidence": 1.5}', "v2")["errors"] == ["Schema mismatch: confidence"]
    many = ", ".join(f'"d{k}"' for k in range(11))
    assert parse(spark, f'{{"differential_diagnoses": [{many}]}}', "v2")["errors"] == ["Schema mismatch: differential_diagnoses"]


def test_unknown_version():
    with pytest.raises(ValueError, match="unknown schema version"):
        schemas.get("v9")


def test_vocabulary_walk(spark):
    r = payload.parse(spark.createDataFrame([('{"primary_diagnosis": " A ", "containers": [{"diagnosis": "B"}, {"diagnosis": " "}, {"diagnosis": "C"}]}',)], "payload string"), "payload", "v7")
    values = payload.constrained_values(F.col("record"), schemas.get("v7"))
    got = r.select(payload.outside_vocabulary(values, ["A", "B"]).alias("x"), values.alias("all")).first()
    assert [tuple(v) for v in got["all"]] == [("primary_diagnosis", "A"), ("containers[0].diagnosis", "B"), ("containers[2].diagnosis", "C")]
    assert [tuple(v) for v in got["x"]] == [("containers[2].diagnosis", "C")]


@pytest.mark.parametrize(("primary", "items", "want"), [("A", ["A"], []), ("A", [" B ", "B", "", None, "C"], ["B", "C"]), (None, ["A"], ["A"]), ("A", None, [])])
def test_differential(spark, primary, items, want):
    df = spark.createDataFrame([(primary, items)], "p string, i array<string>")
    assert df.select(payload.differential(F.col("p"), F.col("i")).alias("x")).first()["x"] == want


def test_json_schema():
    made = schemas.json_schema(schemas.get("v7"), "v7", ["b", "a"])
    assert "case_id" not in made["properties"] and made["required"] == list(made["properties"]) and made["additionalProperties"] is False
    assert made["properties"]["primary_diagnosis"]["anyOf"][0]["enum"] == ["a", "b"]
    assert made["properties"]["containers"]["anyOf"][0]["items"]["properties"]["diagnosis"]["anyOf"][0]["enum"] == ["a", "b"]
    assert schemas.constrained_paths(schemas.get("v7")) == [("primary_diagnosis",), ("containers", "diagnosis")]


def test_rank_map(spark):
    ranked = spark.createDataFrame([([(1, 7, "n", 0.5, "a", None, None, None)],), ([],), (None,)], f"r {records.RANKED}")
    got = [r["m"] for r in ranked.select(records.rank_map(F.col("r"), "valid").alias("m")).collect()]
    assert got[0]["top_1"]["valid_code"] == 7 and got[0]["top_1"]["valid_group_1"] == "a"
    assert got[1]["top_1"]["valid_code"] is None and got[2]["top_1"]["valid_name"] is None


def test_fallback_only_without_predictions(spark):
    ranked = spark.createDataFrame([([(1, None, None, None, None, None, None, None)], 9), ([], 9)], f"r {records.RANKED}, flat long")
    assert [r["x"] for r in ranked.select(records.with_fallback(F.col("r"), "code", F.col("flat")).alias("x")).collect()] == [None, 9]


def test_single_container_wins_even_if_null(spark):
    kind = "struct<label:string>"
    df = spark.createDataFrame([(None, True, [("a",)]), (None, False, [("a",)]), (("b",), True, [("a",)])], f"own {kind}, has boolean, many array<{kind}>")
    got = df.select(records.container(F.col("own"), F.col("has"), F.col("many"))["label"].alias("x")).collect()
    assert [r["x"] for r in got] == [None, "a", "b"]


@pytest.mark.parametrize(("given", "want"), [(None, []), ("null", []), ('{"label": "A"}', ['{"label": "A"}']), ('"A"', ['{"label":"A"}']), ('[{"label": "A"}, null]', ['{"label": "A"}'])])
def test_normalized_containers(spark, given, want):
    got = one(spark, records.normalized_containers(F.col("t").cast("string")), t=given)
    assert [g.replace(" ", "") for g in got] == [w.replace(" ", "") for w in want]
