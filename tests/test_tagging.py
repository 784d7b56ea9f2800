"""The token classifier and subword windows: decoding against brute force, held-out accuracy, offsets against a tokenizer."""

from __future__ import annotations

import itertools
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from casebook.operators import spans, subwords, tagging
from casebook.plans import documents

SF = "/root/testdata/sf0.001"
GROUPS = ("EMAIL", "PHONE")


def test_viterbi_is_the_best_of_all_tag_sequences():
    draw = np.random.default_rng(1)
    for n in (1, 2, 5):
        emit = draw.standard_normal((4, n, 5)).round(1)
        steps = np.where(tagging._allowed(5) < 0, tagging.NEVER, draw.standard_normal((6, 5)).round(1))
        sizes = np.array([n, max(1, n - 1), 1, n])
        got = tagging.viterbi(emit, steps, sizes)
        for k, size in enumerate(sizes):
            value = lambda line, k=k: sum(steps[a, b] + emit[k, t, b] for t, (a, b) in enumerate(zip((5, *line[:-1]), line, strict=True)))
            best = max(value(line) for line in itertools.product(range(5), repeat=size))
            assert value(tuple(got[k, :size])) == pytest.approx(best)


def test_gold_tags_and_joined_spans_are_inverse():
    text = "call +1 (555) 010-9999 or a.b@c.example now"
    found = [(5, 22, "PHONE", 0.9), (26, 39, "EMAIL", 0.9), (5, 7, "OTHER", 0.9)]
    places = tagging.tokens(text)
    best = tagging.gold(places, found, GROUPS)
    assert [s[:3] for s in tagging.joined(places, best, np.ones(len(best)), GROUPS)] == [s[:3] for s in found[:2]]


def prose(n):
    draw = random.Random(3)
    out = []
    for k in range(n):
        words = ["".join(draw.choices("abcdefgh", k=draw.randint(2, 7))) for _ in range(30)]
        if k % 2:
            words[draw.randrange(30)] = draw.choice([f"{words[0]}.{k}@mail{k % 9}.example.com", f"+1 ({draw.randrange(200, 999)}) 555-{draw.randrange(1000, 9999)}"])
        out.append((k, " ".join(words)))
    return out


@pytest.fixture(scope="module")
def fitted(spark):
    docs = spark.createDataFrame(prose(600), "doc_id long, text string").repartition(4)
    found = tagging.sequences(docs, "text", spans.regex_detector(), GROUPS).persist()
    held_out = F.pmod(F.col("number"), F.lit(2)) == 1
    return tagging.fit(found.where(~held_out), GROUPS), found.where(held_out)


def test_held_out_spans_are_found(fitted):
    model, held_out = fitted
    scores = {r["entity_group"]: r["f1"] for r in tagging.evaluate(held_out, model).collect()}
    assert set(scores) == set(GROUPS) and min(scores.values()) > 0.95, scores


def test_a_model_is_a_detector(spark, fitted):
    model, _ = fitted
    text = "abc de joe.5@mail3.example.com fgh +1 (212) 555-0199 cab bdf aceg hfe gab"
    assert [s[:3] for s in model(text)] == [(7, 30, "EMAIL"), (35, 52, "PHONE")]
    assert model("") == [] and model.many(["", "abc", ""]) == [[], [], []]
    docs = spark.createDataFrame([(1, text), (2, None), (3, "plain words")], "id int, t string")
    got = {r["id"]: r["masked"] for r in spans.deidentify(docs, "id", "t", detector=model, threshold=0.5).collect()}
    assert "@" not in got[1] and "555" not in got[1] and got[2] == "" and got[3] == "plain words"


def test_nothing_to_learn_gives_a_model_that_finds_nothing(spark):
    found = tagging.sequences(spark.createDataFrame([(None,), ("",)], "text string"), "text", spans.regex_detector(), GROUPS)
    model = tagging.fit(found, GROUPS, rounds=1)
    assert model("joe@mail.example.com") == [] and tagging.evaluate(found, model).count() == 0


PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "a", "  two  spaces ", "don't we'll", "12,345.67", "é😀ﬁ 漢字 ñandú", "\n\n\tx\r\n", "x" * 3000, "ab" * 700, "'s 've", " nbsp ", "İstanbul ß", "áb"]


def test_offsets_are_those_of_the_tokenizer(spark):
    own, other = subwords.Merges(PATH), Tokenizer.from_file(PATH)
    other.encode_special_tokens = True
    texts = ODD + [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    for t, e in zip(texts, other.encode_batch(texts, add_special_tokens=False), strict=True):
        assert own.offsets(t) == [tuple(o) for o in e.offsets], t[:80]


def test_windows_of_model_tokens(spark):
    other = Tokenizer.from_file(PATH)
    rows = list(enumerate([*ODD, None, " ".join(ODD) * 4]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for size, overlap in ((480, 64), (7, 3), (4, 0)):
        got = {(r["doc_id"], r["window"]): (r["window_start"], r["window_text"]) for r in subwords.windows(df, "text", PATH, size, overlap).collect()}
        want = {}
        for d, t in rows:
            places = other.encode(t or "", add_special_tokens=False).offsets
            for k, a in enumerate(a for a in range(0, len(places), size - overlap) if a == 0 or a + overlap < len(places)):
                own = places[a : a + size]
                want[d, k] = (own[0][0], t[own[0][0] : own[-1][1]])
        assert got == want


def test_queries_over_whole_documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    windows = documents.chunk_subwords(spark, SF)
    assert windows.select("doc_id").distinct().count() == rows.where("length(text) > 0").count()
    scores = {r["entity_group"]: r for r in documents.tag_held_out(spark, SF).collect()}
    assert set(scores) == set(documents.GROUPS)
    masked = documents.phi_mask_tagged(spark, SF)
    assert masked.count() == rows.count()
