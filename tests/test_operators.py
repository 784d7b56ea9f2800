"""Operators on small inline cases, and span rules against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from casebook.operators import compare, confusion, dictionary, extraction, link, merge, metrics, report, spans, stratify


def plain_select(items):
    kept = []
    for s in sorted(items, key=lambda s: (-s[3], s[0] - s[1], s[0], s[2])):
        if all(s[1] <= k[0] or k[1] <= s[0] for k in kept):
            kept.append(s)
    return sorted(kept)


def plain_merge(items, gap=1):
    out = []
    for s in sorted(items):
        if out and out[-1][2] == s[2] and s[0] - out[-1][1] <= gap:
            out[-1] = (out[-1][0], max(out[-1][1], s[1]), s[2], max(out[-1][3], s[3]))
        else:
            out.append(s)
    return out


def test_spans_against_plain_versions(spark):
    draw = random.Random(5)
    cases = [[(a := draw.randint(0, 40), a + draw.randint(1, 9), draw.choice("XY"), draw.choice([0.5, 0.75, 0.9])) for _ in range(draw.randint(0, 12))] for _ in range(60)]
    df = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], f"k int, s {spans.SPANS}")
    chosen = spans.select(F.col("s"))
    for row in df.select("k", chosen.alias("kept"), spans.merge(chosen).alias("merged")).collect():
        kept = [tuple(s) for s in row["kept"]]
        assert kept == plain_select(cases[row["k"]])
        assert [tuple(s) for s in row["merged"]] == plain_merge(kept)


def test_mask_and_expand(spark):
    df = spark.createDataFrame([("ID 12-345 😀 bob", [(4, 6, "ID", 0.9), (12, 15, "NAME", 0.8)])], f"t string, s {spans.SPANS}")
    grown = spans.expand(F.col("s"), F.col("t"))
    row = df.select(grown.alias("g"), spans.mask(F.col("t"), F.col("s")).alias("m")).first()
    assert (row["g"][0]["start"], row["g"][0]["end"]) == (2, 10)
    assert row["m"] == "ID 1[ID(2/0.90)]345 😀 [NAME(3/0.80)]"


def test_distinct_spans_keep_the_first(spark):
    df = spark.createDataFrame([([(0, 2, "A", 0.8), (0, 2, "A", 0.9), (0, 2, "B", 0.7)],)], f"s {spans.SPANS}")
    assert [tuple(s) for s in df.select(spans.distinct(F.col("s")).alias("x")).first()["x"]] == [(0, 2, "A", 0.8), (0, 2, "B", 0.7)]


def test_windows_overlap_and_cover(spark):
    words = [f"w{k}" for k in range(25)]
    got = spans.windows(spark.createDataFrame([(" " + "  ".join(words),), ("",), (None,)], "t string"), "t", size=10, overlap=2).collect()
    parts = [r["window_text"].split() for r in got]
    assert parts == [words[0:10], words[8:18], words[16:25]]
    assert all((" " + "  ".join(words))[r["window_start"] :].startswith(r["window_text"]) for r in got)


def test_deidentify_masks_and_survives_failures(spark):
    docs = spark.createDataFrame([(1, "mail a.b@c.org now"), (2, None), (3, "fine")], "id int, t string")
    got = {r["id"]: r for r in spans.deidentify(docs, "id", "t").collect()}
    assert got[1]["masked"] == "mail [EMAIL(9/0.99)] now" and got[2]["masked"] == "" and got[3]["masked"] == "fine"

    def broken(text):
        raise RuntimeError("no model")

    row = spans.detect(docs.where("id = 1"), "t", broken).first()
    assert row["found"] == [] and "no model" in row["detect_error"]


def test_lookup_directions(spark):
    d = spark.createDataFrame([(1, "a", 10), (2, "a", 20), (3, None, 30)], "row_num int, name string, code int")
    q = spark.createDataFrame([("a",), ("b",), (None,)], "t string")
    first = dictionary.lookup(q, F.col("t"), d, F.col("name"), {"code": "code"})
    last = dictionary.lookup(q, F.col("t"), d, F.col("name"), {"code": "code"}, last=True)
    assert {r["t"]: r["code"] for r in first.collect()} == {"a": 10, "b": None, None: None}
    assert {r["t"]: r["code"] for r in last.collect()} == {"a": 20, "b": None, None: None}


def test_retrieval_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(link, "DICTIONARY_BLOCK", 7)
    draw = random.Random(3)
    rows = [(k, k % 5, [draw.random() for _ in range(6)]) for k in range(40)] + [(90, 1, [0.0] * 6), (91, 1, None)]
    d = spark.createDataFrame(rows, "entry_id long, code long, vector array<double>")
    q = d.where("entry_id < 9").select(F.col("entry_id").alias("query_id"), "vector")
    got = {(r["query_id"], r["entry_id"]): r["similarity"] for r in link.retrieve(q, d, 4).collect()}

    def cos(a, b):
        return sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5

    want = {}
    for k, _, v in rows[:9]:
        best = sorted(((-round(cos(v, w), 6), e) for e, _, w in rows[:40]))[:4]
        want |= {(k, e): -s for s, e in best}
    assert got == pytest.approx(want)


def test_rerank(spark):
    df = spark.createDataFrame([("acute b cell", ["b cell", "x"])], "t string, s array<string>")
    assert link.rerank(df, "t", "s").first()["score"] == pytest.approx(2 / 4)


def test_mcc_conventions(spark):
    df = spark.createDataFrame([("c", True, True), ("c", False, True), ("p", True, True), ("p", False, False)], "g string, t boolean, p boolean")
    got = {r["g"]: r["m"] for r in df.groupBy("g").agg(metrics.mcc(F.col("t"), F.col("p")).alias("m")).collect()}
    assert got == {"c": 0.0, "p": 1.0}
    assert df.where("false").agg(metrics.mcc(F.col("t"), F.col("p")).alias("m"), metrics.accuracy(F.col("t")).alias("a")).first() == (None, None)


def report_frame(spark):
    truth = spark.createDataFrame([(1, 1, 10, "g"), (1, 2, 99, "h"), (2, 3, 20, None), (3, 4, 30, "g")], "case_id long, row_num int, gt_code long, gt_group_1 string")
    r = [(1, 1, [(1, 11, None, 0.9, "g", None, None, None), (2, 10, None, 0.8, "h", None, None, None)]), (2, 2, [(1, 1, None, 0.1, None, None, None, None)]), (2, 3, [(1, 20, None, 0.2, None, None, None, None)]), (3, 4, [])]
    pred = spark.createDataFrame(r, "case_id long, row_num int, ranked " + report.records.RANKED)
    return report.report_level(truth, pred, (1,), (1, 3))


def test_report_level(spark):
    got = {r["case_id"]: r for r in report_frame(spark).collect()}
    assert set(got) == {1, 2}  # case 3 has nothing ranked
    assert (got[1]["gt_code"], got[1]["top1_correct"], got[1]["top3_correct"], got[1]["top1_group_1_correct"]) == (10, False, True, True)
    assert (got[2]["pred_score"], got[2]["top1_correct"], got[2]["top1_group_1_correct"]) == (0.2, True, False)


def test_error_partition(spark):
    df = spark.createDataFrame([(True, True, False), (True, False, None), (False, True, True)], "wrong boolean, a boolean, b boolean")
    got = {r["combination"]: r["fraction"] for r in stratify.error_partition(df, F.col("wrong"), {"A": F.col("a"), "B": F.col("b")}).collect()}
    assert got == {"A": 0.5, "B": 0.0, "A+B": 0.0, "none": 0.5}
    assert stratify.error_partition(df, F.lit(False), {"A": F.col("a")}).count() == 0


@pytest.mark.parametrize("scores", [[0.1, 0.7, 0.7, 0.3, 0.2], [0.5, 0.5], [0.4], []])
def test_threshold_sweep_against_scans(spark, scores):
    df = spark.createDataFrame([(s, k % 2 == 0) for k, s in enumerate(scores)], "pred_score double, top1_correct boolean")
    got = stratify.threshold_sweep(df, ["top1_correct"], steps=11).orderBy("id").collect()
    assert len(got) == (11 if scores else 0)
    for r in got:
        above = [k for k, s in enumerate(scores) if s >= r["threshold"]]
        assert r["coverage"] == len(above) / len(scores)
        assert r["top1_accuracy"] == pytest.approx(sum(k % 2 == 0 for k in above) / len(above))


def test_confusion_rows_without_truth_are_zero(spark):
    df = spark.createDataFrame([("a", "b"), ("a", "a"), (None, "c")], "t string, p string")
    got = {(r["truth"], r["pred"]): r["share"] for r in confusion.normalized(df, "t", "p").collect()}
    assert got == {("a", "a"): 0.5, ("a", "b"): 0.5, ("b", "a"): 0.0, ("b", "b"): 0.0}


def test_major_vote_prefers_the_first_side(spark):
    df = spark.createDataFrame([("x", "m2", "x", "m1")], "t string, tm string, p string, pm string")
    assert confusion.major_groups(df, [("t", "tm"), ("p", "pm")]).first()["major"] == "m2"


def test_positional_merge(spark):
    sheet = spark.createDataFrame([(1, 1), (1, 2), (2, 3), (2, 4), (3, 5), (None, 6)], "id long, row_num int")
    recs = spark.createDataFrame([(1, [("a",), ("b",), ("c",)], "s1"), (2, [("d",)], "s2"), (9, [("z",)], "s9")], "id long, c array<struct<v:string>>, s string")
    got = merge.positional(sheet, recs, "id", "row_num", "c", ["v"], {"status": "s"}).collect()
    rows = {(r["id"], r["ordinal"]): (r["row_num"], r["inserted"], r["v"], r["status"]) for r in got}
    assert rows == {(1, 1): (1, False, "a", "s1"), (1, 2): (2, False, "b", "s1"), (1, 3): (None, True, "c", None), (2, 1): (3, False, "d", "s2"), (2, 2): (4, False, None, "s2"), (3, 1): (5, False, None, None), (None, 1): (6, False, None, None)}


def test_error_stack_drops_empty_parts(spark):
    df = spark.createDataFrame([("r", 0.4, None, None), ("q", 0.9, 0.3, None)], "run string, a double, b double, c double")
    got = {r["run"]: r.asDict() for r in compare.error_stack(df, ["a", "b", "c"]).collect()}
    assert set(got["r"]) == {"run", "a", "b", "Other"} and got["r"]["Other"] == pytest.approx(0.6) and got["q"]["Other"] == 0.0


def test_extraction_splits_good_from_broken(spark):
    reports = spark.createDataFrame([(1, 1, "one"), (2, 2, "two"), (None, 3, "three")], "case_id long, report_index long, text string")
    prompts = extraction.prompts(reports, "P: {input_text}")
    answers = {"P: one": '{"primary_diagnosis": "A"}', "P: two": '{"primary_diagnosis": "Z"}'}
    done = extraction.validate(extraction.generate(prompts, extraction.backend("Replay", answers=answers)), vocabulary=["A"])
    good, broken = extraction.split(done)
    assert [(r["record"]["case_id"], r["record"]["primary_diagnosis"]) for r in good.collect()] == [(1, "A")]
    errors = {r["report_index"]: r["error"] for r in broken.collect()}
    assert errors[2].startswith("vocabulary: primary_diagnosis = Z") and errors[3].startswith("generation: KeyError")
    with pytest.raises(RuntimeError, match="no report"):
        extraction.require_success(extraction.tally(done.where("report_index > 1")))


def test_backends_and_decoders():
    assert isinstance(extraction.backend("vLLM"), extraction.Http)
    with pytest.raises(NotImplementedError):
        extraction.backend("ollama").generate("x")
    with pytest.raises(ValueError, match="unknown backend"):
        extraction.backend("nothing")
    with pytest.raises(ValueError, match="needs one of"):
        extraction.decoder("guidance", "http", "v5")
    assert extraction.decoder("none", "http", "v5") is None
    body = extraction.backend("http", model="m").request("p", extraction.decoder("outlines", "http", "v4"))
    assert body["response_format"]["json_schema"]["name"] == "v4" and body["max_tokens"] == 2048
