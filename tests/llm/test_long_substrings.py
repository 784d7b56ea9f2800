"""Minimisers of texts with more words than a place has room for."""

from __future__ import annotations

import random

import numpy as np
import pytest

from casebook.llm import substring, words


@pytest.mark.parametrize("late", [False, True])
def test_minimisers_do_not_depend_on_the_place(monkeypatch, late):
    monkeypatch.setattr(substring, "_PLACE", np.uint64(63))  # a bound of 64 runs, as if a text had more than 2^24 words
    draw = random.Random(1)
    n, start = 13, (1 << 24) - 100
    passage = [b"w%d" % draw.randrange(1 << 30) for _ in range(300)]
    alone = words.split([b" ".join(passage)])
    frequent = np.unique(words.rolling(alone.hash, substring.RUN, substring._M2) >> np.uint64(25))[:40] if late else np.zeros(0, np.uint64)
    windows = np.arange(300 - n + 1)
    want = substring._minimisers(alone, windows, n, frequent) >> np.uint64(24)
    key = words.rolling(alone.hash, substring.RUN, substring._M2) >> np.uint64(25)
    ranked = key | np.where(np.isin(key, frequent), np.uint64(1 << 39), np.uint64(0))
    assert want.tolist() == [int(ranked[k : k + n - 1].min()) for k in range(len(windows))]
    # the passage across and beyond place 2^24 of one very long text
    monkeypatch.undo()
    far = words.Words(b"", *[np.zeros(0, np.int64)] * 2, np.concatenate([np.full(start, 12345, np.uint64), alone.hash]), np.array([0, start + 300]))
    assert (substring._minimisers(far, start + windows, n, frequent) >> np.uint64(24)).tolist() == want.tolist()
