"""Pages of one template that differ in more than similar ones may: they cost a share of rows that does not grow with their number."""

from __future__ import annotations

import random

import pytest

from casebook.llm import minhash


def pages(n, twins=0):
    """Pages with a similarity of 0.78, the last ``twins`` of which come in pairs of 0.9 and more."""
    draw = random.Random(3)
    base = [f"t{k}" for k in range(400)]
    out = []
    for k in range(n):
        own = [f"p{k}x{i}" for i in range(45)]
        if twins and k >= n - twins and (n - k) % 2:
            own = [w if i % 45 else f"q{k}" for i, w in enumerate(out[-1].split()[200:245])]
        out.append(" ".join([*base[:200], *own, *base[245:]]))
    draw.shuffle(order := list(range(n)))
    return [(i, out[k]) for i, k in enumerate(order)]


def shingles(text):
    w = text.split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def linked(spark, rows, monkeypatch):
    met = spark.sparkContext.accumulator(0)
    plain = minhash._similar_sets

    def counted(batches, percent):
        def seen():
            for pdf in batches:
                met.add(len(pdf))
                yield pdf

        return plain(seen(), percent)

    monkeypatch.setattr(minhash, "_similar_sets", counted)
    got = {r["doc_id"]: r["component_id"] for r in minhash.link(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 85).collect()}
    monkeypatch.setattr(minhash, "_similar_sets", plain)
    return got, met.value


def test_pages_of_one_template_meet_few_others(spark, monkeypatch):
    cost = {}
    for n in (1024, 2048):
        rows = pages(n)
        got, cost[n] = linked(spark, rows, monkeypatch)
        assert got == {d: d for d, _ in rows}
    assert cost[2048] <= 2.2 * cost[1024], cost
    assert cost[2048] < 8 * 2048, cost  # an all-pairs comparison of blocks takes 34,896 sets


@pytest.mark.parametrize("block", [256, 16])
def test_links_among_pages_of_one_template_are_found(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "FEW_GROUPS", 1)
    rows = pages(700, 200)
    sets = {d: shingles(t) for d, t in rows}
    by_own: dict = {}
    for d, s in sets.items():
        for x in s:
            if any(w[0] in "pq" for w in x):
                by_own.setdefault(x, []).append(d)
    want = {d: d for d, _ in rows}
    for ds in by_own.values():  # all pairs of other pages have a similarity of 0.78
        for a in ds:
            for b in ds:
                if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    want[b] = min(want[b], want[a])
    got, _ = linked(spark, rows, monkeypatch)
    assert got == want and sum(a != b for a, b in want.items()) == 100
