"""The pipeline on benchmark items without an id, on texts that are no language, on odd ids and on no rows."""

from __future__ import annotations

import base64
import random

import pytest

import corpus_pipeline
from casebook.llm import decontaminate, langid

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bits double, lang_bits int"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, lang, "s", None if t is None else len(t), 0.5, 1) for d, t, lang in rows], SCHEMA).repartition(3)


def prose(seed: int, n: int):
    """Labelled texts of two made-up languages."""
    draw = random.Random(seed)
    syllables = {"aa": ["ba", "ko", "mi", "re", "sul", "ten"], "bb": ["zwi", "grö", "cha", "ulm", "pfe", "ix"]}
    out = []
    for k in range(n):
        lang = ("aa", "bb")[k % 2]
        text = " ".join("".join(draw.choices(syllables[lang], k=draw.randint(1, 3))) for _ in range(draw.choice([12, 40, 200])))
        out.append((k, text, lang))
    return out


def noise(seed: int):
    draw = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    return {
        "random": " ".join("".join(draw.choices(letters, k=draw.randint(2, 9))) for _ in range(120)),
        "mash": "".join(draw.choices("asdfghjklqwer", k=600)),
        "base64": base64.b64encode(draw.randbytes(600)).decode(),
    }


def test_texts_that_are_no_language_go_and_labelled_documents_stay(spark):
    known = prose(1, 700)  # more of each label than are sampled
    other = [(5000 + k, t, None) for k, t in enumerate(noise(2).values())]
    short = [(2000, "qx zv", None), (2001, "12 34", None), (2002, None, "aa"), (None, known[0][1], None)]
    docs = frame(spark, known + other + short)
    kept = corpus_pipeline.identify_language(spark, docs, "")
    assert kept.columns == docs.columns
    found = [r["doc_id"] for r in kept.collect()]
    assert sorted(d for d in found if d is not None) == [*range(700), 2000] and found.count(None) == 1


def test_bounds_fall_with_length_and_need_enough_documents(spark):
    rows = [(2.0 + 0.01 * k, 100.0, "aa", 0.0) for k in range(40)] + [(1.0, 5000.0, "aa", 0.0)] * 30 + [(8.0, 90.0, None, 0.0), (8.5, 90.0, "aa", 1.0), (0.5, 1e6, "aa", 0.0)]
    found = spark.createDataFrame(rows, "bits double, letters double, lang string, sampled double")
    most = langid.bounds(found, "lang", "bits", "letters", "sampled")
    assert most[6] == pytest.approx(2.39 * 1.1) and most[7] == most[12] == pytest.approx(1.1) and most[19] == pytest.approx(1.1)
    assert set(langid.bounds(found.limit(20), "lang", "bits", "letters", "sampled").values()) == {langid.MOST_BITS}


@pytest.mark.parametrize("block", [1 << 23, 60])
def test_items_without_an_id_are_searched(spark, monkeypatch, tmp_path, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    ten = "one two three four five six seven eight nine ten"
    spark.createDataFrame([(None, ten), (4, "other words"), (None, "third")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = frame(spark, [(1, f"a {ten} b", "aa"), (2, "one two three", "aa"), (None, f"{ten.upper()}!", "aa"), (3, "the third", "aa"), (5, "other, words", "aa")])
    kept = corpus_pipeline.remove_benchmark(spark, docs, str(tmp_path)).collect()
    assert [r["doc_id"] for r in kept] == [2]


def written(spark, tmp_path, rows):
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "no such words here at all in any of these texts")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_odd_ids_pass_all_stages(spark, tmp_path):
    known = prose(3, 40)
    big = (1 << 60) + 1
    rows = known + [(big, known[0][1], "aa"), (big + 2, prose(9, 2)[1][1], "bb"), (None, prose(10, 2)[0][1], "aa"), (None, prose(11, 2)[0][1], "aa"), (107, None, None), (108, "", "aa"), (-3, "x = password: abcdefghijkl0", None)]
    out = corpus_pipeline.run(spark, written(spark, tmp_path, rows)).collect()
    ids = {r["doc_id"] for r in out}
    assert {big + 2, -3, None} <= ids and not {big, 107, 108} & ids
    assert sum(r["doc_id"] is None and r["piece"] == 0 for r in out) == 2


def test_an_empty_table_passes_all_stages(spark, tmp_path):
    assert corpus_pipeline.run(spark, written(spark, tmp_path, [])).count() == 0
