"""Detectors and windows that hold a part of a batch at a time."""

from __future__ import annotations

import tracemalloc

import numpy as np
import public_tokenizers
import pytest

from casebook.operators import subwords, tagging


def test_many_texts_are_tagged_in_slices():
    draw = np.random.default_rng(1)
    model = tagging.Tagger(("A", "B"), draw.standard_normal((tagging.PLACES, 5)), tagging._allowed(5))
    texts = [" ".join(f"w{k % 7} {k % 11}." for k in range(i, i + 300)) for i in range(2_000)]
    tracemalloc.start()
    tagged = model.many(["", *texts])
    peak = tracemalloc.get_traced_memory()[1]
    kept = sum(len(t) for t in tagged)
    tracemalloc.stop()
    assert tagged[0] == [] and tagged[1:3] == model.many(texts[:1]) + model.many(texts[1:2])
    assert peak - 400 * kept < 150_000_000  # the spans are the result


@pytest.mark.parametrize("size, step", [(5, 3), (1, 1), (480, 416), (7, 7)])
def test_spans_are_those_of_all_offsets(size, step):
    merges = subwords.Merges(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ("", "a", "It's naïve 😀😀 text\n\n  with  runs ", "é" * 100 + " 1234567 " * 40, "日本語のテキスト。" * 30):
        places = merges.offsets(text)
        starts = [a for a in range(0, len(places), step) if a == 0 or a + size - step < len(places)]
        assert merges.spans(text, size, step) == [(places[a][0], places[min(a + size, len(places)) - 1][1]) for a in starts]
