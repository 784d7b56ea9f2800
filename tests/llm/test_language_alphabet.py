"""Languages with more letters in sum than there are classes."""

from __future__ import annotations

import random

import numpy as np
import pytest

from casebook.llm import langid

LATIN = "abcdefghijklmnopqrstuvwxyz"


@pytest.mark.parametrize("letters", [30, 900])
def test_rare_letters_tell_labels_apart(letters):
    draw = random.Random(1)
    # two labels whose letters are three code points apart, and are rare beside the Latin ones
    one, two = ([chr(0x4E00 + 6 * k + shift) for k in range(letters)] for shift in (0, 3))
    text = lambda own, n: " ".join("".join(draw.choices(own, k=4)) for _ in range(n))
    latin = "".join(draw.choices(LATIN + "".join(chr(0x3B1 + k) for k in range(17)) + "".join(chr(0x430 + k) for k in range(32)), k=30_000))
    samples = [("latin", latin), ("one", text(one, 2000)), ("two", text(two, 2000))]
    parser = langid.Parser(samples)
    asked = [text(own, 40) for own in (one, two) * 10]
    labels = parser.predict(asked)[0]
    assert labels == ["one", "two"] * 10
    seen = {tuple(parser.spell(parser.classes(c)[0]).tolist()) for c in [*one, *two]}
    assert len(seen) == 2 * letters
    assert parser.table.size == len(parser.often) * langid._CLASSES and max(max(s) for s in seen) < langid._UNSEEN


def test_few_letters_have_a_class_each():
    parser = langid.Parser([("x", LATIN), ("y", "\u03b1\u03b2")])
    found = parser.classes(LATIN + "\u03b1\u03b2")[0]
    assert len(set(found.tolist())) == 28 and np.array_equal(parser.spell(found), found)
    assert set(parser.classes("\u6f22\u5b57")[0].tolist()) == {langid._UNSEEN}
