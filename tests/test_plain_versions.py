"""De-identification and standardised texts against plain Python over the driver's documents, and plans that do work once."""

from __future__ import annotations

import re
import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from casebook.functions import text
from casebook.operators import dictionary, merge, spans
from casebook.plans import catalogue
from tests.test_operators import plain_merge, plain_select

SF = "/root/testdata/sf0.001"
SPACE = r"[\t\n\x0b\x0c\r \x85\xa0  -     　]"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def documents(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def plain_windows(t, size, overlap):
    tokens = [(m.start(), m.end()) for m in re.finditer(r"[^\t\n\x0b\x0c\r ]+", t)]
    step = size - overlap
    for k, a in enumerate(range(0, len(tokens), step)):
        if a == 0 or a + overlap < len(tokens):
            own = tokens[a : a + size]
            yield k, own[0][0], t[own[0][0] : own[-1][1]]


def plain_mask(t):
    found = []
    for _, start, part in plain_windows(t, 480, 64):
        found += [(start + m.start(), start + m.end(), g, s) for g, p, s in spans.PATTERNS for m in re.finditer(p, part, re.ASCII) if s >= spans.THRESHOLD]
    grown = []
    for a, b, g, s in found:
        if g in spans.GROWING:
            while a > 0 and re.match(spans.GROWS, t[a - 1]):
                a -= 1
            while b < len(t) and re.match(spans.GROWS, t[b]):
                b += 1
        if not any(x[:3] == (a, b, g) for x in grown):
            grown.append((a, b, g, s))
    chosen = plain_merge(plain_select(grown))
    for a, b, g, s in sorted(chosen, reverse=True):
        t = f"{t[:a]}[{g}({b - a}/{s:.2f})]{t[b:]}"
    return len(chosen), t


def test_masked_documents_are_those_of_plain_python(spark):
    got = {r["doc_id"]: (r["n_spans"], r["masked"]) for r in catalogue.phi_mask(spark, SF).collect()}
    want = {d: plain_mask(t or "") for d, t in documents(spark)}
    assert got == want and sum(n for n, _ in want.values()) > 20


def test_windows_are_those_of_plain_python(spark):
    rows = [*documents(spark)[:60], (-1, "\n\n a  b\tc " * 400), (-2, "😀 é " * 900), (-3, " \n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for size, overlap in ((480, 64), (10, 7), (5, 0)):
        got = {(r["doc_id"], r["window"]): (r["window_start"], r["window_text"]) for r in spans.windows(df, "text", size, overlap, r"[^\t\n\x0B\f\r ]+").collect()}
        assert got == {(d, k): (a, w) for d, t in rows for k, a, w in plain_windows(t or "", size, overlap)}


def test_windows_of_a_long_text_take_linear_time(spark):
    df = spark.createDataFrame([(1, "word " * 200_000)], "id int, t string")
    spans.windows(df.limit(0), "t").count()
    began = time.time()
    assert spans.windows(df, "t").agg(F.sum(F.length("window_text"))).count() == 1 and spans.windows(df, "t").count() == 481
    assert time.time() - began < 10


def plain_standard(t):
    if t is None:
        return None
    t = t.lower()
    try:
        t = t.encode("latin-1").decode("utf-8")
    except UnicodeError:
        pass
    t = unicodedata.normalize("NFKC", t).replace("\xa0", " ").replace("Â", "")
    t = re.sub(r"[\x00-\x1f\x7f-\x9f]", " ", t)
    return re.sub(r"^ | $", "", re.sub(f"{SPACE}+", " ", t))


def test_standard_texts_are_those_of_plain_python(spark):
    odd = [(-1, "Ｆｕｌｌ ﬁne\x07\x85x  "), (-2, "CafÃ© Â\xa0x"), (-3, None), (-4, "ÀÉ ß İ"), (-5, "")]
    rows = documents(spark) + odd
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["s"] for r in df.select("doc_id", text.standardize(F.col("text")).alias("s")).collect()}
    assert got == {d: plain_standard(t) for d, t in rows}


def test_match_keys_fold_case(spark):
    df = spark.createDataFrame([("STRASSE", "straße"), ("ΟΔΟΣ", "οδος"), ("ﬁ", "FI"), (" a", "A "), ("a", "b"), (None, None)], "a string, b string")
    assert [r[0] for r in df.select(text.same_key(F.col("a"), F.col("b"))).collect()] == [True, True, True, True, False, False]


def test_detectors_and_models_run_once(spark):
    masked = plan(catalogue.phi_mask(spark, SF))
    assert masked.count("ArrowEvalPython") == 1
    letters = plan(catalogue.dead_letter(spark, SF))
    assert letters.count("Scan parquet") == 1 and letters.count("ArrowEvalPython") == 1
    runs = plan(catalogue.compare_runs(spark, SF))
    assert runs.count("FlatMapCoGroupsInPandas") == 1


@pytest.mark.parametrize(("name", "columns"), [("link_exact_lookup", "p_partkey:bigint,p_name:string"), ("link_match_key_lookup", "p_partkey:bigint,p_brand:string,p_type:string"), ("link_code_groups", "n_nationkey:int,n_name:string,n_regionkey:int"), ("url_first_section", "page_id:bigint,url:string")])
def test_lookups_read_only_what_they_give(spark, name, columns):
    found = set(re.findall(r"ReadSchema: struct<([^>]*)>", plan(catalogue.QUERIES[name](spark, SF))))
    assert any(set(c.split(",")) == set(columns.split(",")) for c in found), found
    assert not any("p_retailprice" in c or "html" in c for c in found)


def test_rows_without_a_key_are_no_one_key(spark):
    df = spark.createDataFrame([(None, 3, "z"), ("a", 1, "x"), (None, 2, "y"), ("a", 5, "w")], "k string, row int, v string")
    assert sorted((r["row"], r["is_first"]) for r in merge.first_occurrence(df, "k", "row").collect()) == [(1, True), (2, True), (3, False), (5, False)]
    recs = spark.createDataFrame([("a", [("m",), ("n",), ("o",)])], "k string, c array<struct<f:string>>")
    got = merge.positional(df, recs, "k", "row", "c", ["f"]).collect()
    assert sorted((r["row"] or 9, r["f"] or "", r["inserted"]) for r in got) == [(1, "m", False), (2, "", False), (3, "", False), (5, "n", False), (9, "o", True)]


def test_lookup_values_may_repeat_the_key_and_order(spark):
    d = spark.createDataFrame([(1, "a", 10), (2, "a", 20)], "row_num int, name string, code int")
    out = dictionary.lookup(spark.createDataFrame([("a",)], "t string"), F.col("t"), d, F.col("name"), {"n": "name", "r": "row_num"}, last=True)
    assert [tuple(r) for r in out.collect()] == [("a", "a", 2)]
