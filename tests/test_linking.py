"""Linking end to end."""

from casebook.plans import linking

ENTRIES = [(1, 10, "b cell lymphoma", "B"), (2, 10, "B-cell", "B2"), (3, 20, "t cell lymphoma", "T"), (4, 30, "carcinoma", "C"), (5, 30, "b cell lymphoma", "D")]


def frames(spark):
    entries = spark.createDataFrame(ENTRIES, "row_num int, code long, name string, group_1 string")
    kind = "case_id long, primary_diagnosis string, containers array<struct<label:string,diagnosis:string>>"
    rows = [(1, " t cell lymphoma ", [("a", "carcinoma"), ("b", None)]), (2, "T cell lymphomas", None), (3, None, []), (4, "t cell lymphoma", [])]
    return spark.createDataFrame(rows, kind), entries


def test_links_by_similarity(spark):
    records, entries = frames(spark)
    got = {r["case_id"]: r for r in linking.link_records(records, "case_id", entries).collect()}
    assert [got[k]["ranked"][0]["code"] for k in (1, 2, 4)] == [20, 20, 20] and got[3]["ranked"] == []
    assert got[1]["ranked"][0]["group_1"] == "T" and [p["rank"] for p in got[1]["ranked"]] == [1, 2, 3]
    assert got[1]["container_ranked"][0][0]["code"] == 30 and got[1]["container_ranked"][1] == [] and got[2]["container_ranked"] == []


def test_links_exactly(spark):
    records, entries = frames(spark)
    got = {r["case_id"]: r["ranked"] for r in linking.link_records(records, "case_id", entries, exact=True).collect()}
    assert [(p["code"], p["name"], p["group_1"]) for p in got[1]] == [(20, "t cell lymphoma", "T")] and got[2] == [] and got[3] == []


def test_acceptance_and_last_code(spark):
    _, entries = frames(spark)
    texts = spark.createDataFrame([("b cell lymphoma",)], "text string")
    assert [p["code"] for p in linking.link_exactly(texts, entries).first()["ranked"]] == [30]
    assert linking.link_texts(texts, entries, accept=99.0).count() == 0
