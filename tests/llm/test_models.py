"""The models behind language ID, LM scoring and packing, against plain versions of them."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from casebook.llm import langid, lm_scoring, packing, registry, words
from tests.llm.brute import SPACED, lower
from tests.llm.test_llm import corpus, frame

SF = "/root/testdata/sf0.001"


# --- language ID: longest matches by search -----------------------------------------------------


def letters(text):
    """Lower-case letters, each run of others as one space."""
    out = []
    for c in text.lower():
        if c.isalpha():
            out.append(c)
        elif not out or out[-1] != " ":
            out.append(" ")
    return "".join(out)


def plain_cost(text, sample, segment):
    """Bits of a text under a label's sample: phrases are longest matches, a character that occurs nowhere ends one, and each segment starts anew."""
    total = 0.0
    for k in range(0, len(text), segment):
        part = text[k : k + segment]
        phrases, at, size = 0, 0, 0
        while True:
            size = 0
            while at + size < len(part) and part[at : at + size + 1] in sample:
                size += 1
            if at + size >= len(part):
                break  # the phrase under way reaches the end
            phrases += 1
            at += size + (part[at + size] not in sample)
        rest = part[at:]
        often = sum(sample.startswith(rest, i) for i in range(len(sample))) if rest else len(sample) + 1
        total += phrases + 1 - np.log2(often + 1.0) / 32
    return total * np.log2(len(sample) + 2)


def test_parse_and_labels_are_those_of_a_plain_search():
    draw = random.Random(7)
    kinds = {"one": "abcde  ,", "two": "bcdfé \n.", "three": "xyza  -"}
    samples = [(k, "".join(draw.choices(v, k=400))) for k, v in sorted(kinds.items())]
    parser = langid.Parser(samples)
    texts = ["".join(draw.choices(draw.choice(list(kinds.values())), k=draw.randint(1, 1400))) for _ in range(60)]
    total, size = parser.costs(texts)
    labels = parser.predict(texts)[0]
    for i, t in enumerate(texts):
        own = letters(t)
        assert size[i] == (len(own) if any(c.isalpha() for c in own) else 0)
        want = [plain_cost(own, letters(s), langid.SEGMENT) for _, s in samples]
        if size[i]:
            assert total[:, i] == pytest.approx(want)
            assert labels[i] == samples[int(np.argmin(want))][0]
        else:
            assert labels[i] == "und"


def test_every_label_is_learnt_from_distinct_rows(spark):
    rows = [(k, f"l{k % 90}", f"word{k} of {k % 90}") for k in range(900)] + [(None, "l0", "the same text")] * 500 + [(5, "l1", "x" * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(4)
    samples = langid.sample(docs)
    assert [k for k, _ in samples] == sorted({lang for _, lang, _ in rows})
    text = dict(samples)
    assert text["l0"].count("the same text") == 1 and len(text["l1"]) < langid.MODEL_CHARS // 90 + 1 and "word1 " in text["l1"]


def test_scripts_that_no_label_has_are_rejected(spark):
    texts = ["plain words in a language", "漢字" * 60, "漢字", "12", None, "ordinary prose of that language " * 30]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    samples = [("en", "this is ordinary prose and plain words of a language, and of that. " * 20)]
    assert sorted(r["doc_id"] for r in langid.keep_identified(docs, samples).collect()) == [0, 2, 5]


# --- LM scoring: counts, classes and the model's sums in plain Python --------------------------------


def plain_scores(rows, held):
    toks = [[*SPACED.findall(lower(t or "")), None] for _, t in rows]
    counts: dict = {}
    for ws, h in zip(toks, held, strict=True):
        for w in ws:
            counts[w] = counts.get(w, 0) + (not h)
    flat = sorted({w for ws in toks for w in ws if w is not None})
    found = words.split([" ".join(flat).encode()])
    form = dict(zip(flat, lm_scoring._forms(found).tolist(), strict=True)) | {None: 0}
    hashed = dict(zip(flat, found.hash.tolist(), strict=True)) | {None: int(lm_scoring._END)}
    signed = lambda h: h - (1 << 64) if h >= 1 << 63 else h
    known = sorted((w for w in counts if counts[w]), key=lambda w: (-counts[w], signed(hashed[w])))
    own = known[: lm_scoring.predicted_words(len(known))]
    first = known[: lm_scoring.SYMBOLS - lm_scoring.CLASSES - 1]

    def numbered(top):
        place = {w: 1 + k for k, w in enumerate(sorted((w for w in top if w is not None), key=hashed.get))}
        return lambda w: 0 if w is None else place.get(w, 1 + len(place) + form[w]), 1 + len(place) + lm_scoring.CLASSES, len(place)

    (context, n_contexts, _), (symbol, n_symbols, n_own) = numbered(first), numbered(own)
    table = np.zeros((n_contexts, n_symbols), np.int64)
    for ws, h in zip(toks, held, strict=True):
        for a, b in zip([None, *ws], ws, strict=False):
            table[context(a), symbol(b)] += not h
    model = lm_scoring.train(table)
    logs = lm_scoring.log_table(model)
    rest = [w for w in known if w is not None and w not in set(own)]
    mass, size, once, twice = (np.zeros(lm_scoring.CLASSES) for _ in range(4))
    for w in rest:
        mass[form[w]] += counts[w]
        size[form[w]] += 1
        once[form[w]] += counts[w] == 1
        twice[form[w]] += counts[w] == 2
    discount = np.clip([o / max(o + 2 * t, 1) if o else 0.5 for o, t in zip(once, twice, strict=True)], 0.05, 0.95)

    def inside(w):
        f = form[w]
        if symbol(w) <= n_own:
            return 0.0
        if counts[w]:
            return np.log10(max(counts[w] - discount[f], 0.01)) - np.log10(max(mass[f], 1))
        return np.log10(discount[f] * size[f]) - np.log10(mass[f]) if mass[f] else 0.0

    return [sum(logs[context(a), symbol(b)] + inside(b) for a, b in zip([None, *ws], ws, strict=False)) for ws in toks]


@pytest.mark.parametrize("growth", [17, 200])
def test_scores_are_those_of_plain_sums(spark, monkeypatch, growth):
    monkeypatch.setattr(lm_scoring, "SYMBOLS", 220)
    monkeypatch.setattr(lm_scoring, "GROWTH", growth)
    draw = random.Random(3)
    rows = [(k, " ".join(draw.choice(["the", "of", "red,", "blue."]) if draw.random() < 0.5 else f"{draw.choice('abc')}{int(draw.expovariate(0.02))}" for _ in range(60))) for k in range(120)] + [(500, None), (501, "the of unheard")]
    held = [k % 5 == 1 for k, _ in rows]
    got = {r["doc_id"]: r["score"] for r in lm_scoring.score(frame(spark, rows, 1), F.col("doc_id") % 5 == 1).collect()}
    for (k, _), want in zip(rows, plain_scores(rows, held), strict=True):
        assert got[k] == pytest.approx(want, rel=1e-3)


def test_the_model_beats_counts_on_held_out_texts(spark):
    got = [r for r in registry.op4_lm_scoring(spark, SF).collect() if r["held_out"]]
    n = sum(r["n_tokens"] for r in got)
    assert sum(r["score"] for r in got) / n > sum(r["base_score"] for r in got) / n + 0.1


def test_predicted_words_grow_with_the_corpus():
    sizes = [lm_scoring.predicted_words(10**k) for k in range(3, 12)]
    assert sizes == sorted(sizes) and sizes[0] == lm_scoring.SYMBOLS - lm_scoring.CLASSES - 1 and sizes[-1] > 50 * sizes[0]


# --- packing: the bound on open bins acts, and packing is tight ---------------------------------------


def test_open_bins_reach_their_bound_and_sequences_are_nearly_full(spark):
    draw = random.Random(5)
    length = [min(2048, int(draw.lognormvariate(6, 1.2)) + 1) for _ in range(20_000)]
    rows = spark.createDataFrame([(k, 0, n) for k, n in enumerate(length)], "doc_id long, piece int, length long").repartition(6)
    got = packing.pack(rows).collect()
    full: dict = {}
    for r in got:
        full.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert len(got) == len(length) and len(full) <= 1.01 * sum(length) / 2048
    for places in full.values():
        ends = [0, *(o + n for o, n in sorted(places))]
        assert [o for o, _ in sorted(places)] == ends[:-1] and ends[-1] <= 2048
    packer = packing.Packer(2048, packing.OPEN_BINS)
    for k in range(0, len(length), packing.LOOKAHEAD):
        for n in sorted(length[k : k + packing.LOOKAHEAD], reverse=True):
            packer.place(n)
            assert packer.open <= packing.OPEN_BINS
    assert packer.closed > 500


def test_packers_need_no_shuffle(spark):
    rows = frame(spark, corpus())
    plan = packing.pack(rows.selectExpr("doc_id", "0 as piece", "cast(5 as long) as length"))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan
