"""Similarities are held a slice at a time."""

from __future__ import annotations

import tracemalloc
from types import SimpleNamespace

import numpy as np

from casebook.operators import link


def test_a_tile_takes_no_memory_by_its_pairs():
    draw = np.random.default_rng(1)
    ids, q, e = np.arange(2_000), draw.standard_normal((2_000, 8)), draw.standard_normal((8_192, 8))
    asked = SimpleNamespace(query_id=ids.tobytes(), vectors=q.tobytes())
    side = SimpleNamespace(entry_id=np.arange(8_192).tobytes(), code=np.zeros(8_192, np.int64).tobytes(), entries=e.tobytes())
    tracemalloc.start()
    got = link.tile(asked, side, 5, 6)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2_000 * 8_192 * 8  # all similarities at once
    rows, flat = link.nearest(link.similarities(q, e, 6), 5)
    assert got["query_id"].tolist() == rows.tolist() and got["entry_id"].tolist() == flat.tolist()


def test_equal_vectors_take_no_memory_by_their_pairs():
    ids, q, e = np.arange(2_000), np.ones((2_000, 8)), np.ones((8_192, 8))
    asked = SimpleNamespace(query_id=ids.tobytes(), vectors=q.tobytes())
    side = SimpleNamespace(entry_id=np.arange(8_192).tobytes(), code=np.zeros(8_192, np.int64).tobytes(), entries=e.tobytes())
    tracemalloc.start()
    got = link.tile(asked, side, 5, 6)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2_000 * 8_192 * 8  # all similarities at once
    assert got["query_id"].tolist() == np.repeat(ids, 5).tolist() and got["entry_id"].tolist() == [0, 1, 2, 3, 4] * 2_000
