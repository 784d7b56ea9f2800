"""Queries on their way to an index's lists: many more bytes than the table of queries has."""

from __future__ import annotations

import numpy as np

from casebook.operators import link, vector_index


def test_queries_of_a_list_travel_in_bounded_rows_that_none_broadcasts(spark, tmp_path, monkeypatch):
    draw = np.random.default_rng(1).standard_normal((300, 8))
    entries = spark.createDataFrame([(k, k % 3, v.tolist()) for k, v in enumerate(draw)], "entry_id long, code long, vector array<double>")
    monkeypatch.setattr(vector_index, "BLOCK_BYTES", 8 * 8 * 16)
    index = vector_index.build(entries, f"file://{tmp_path}/index", lists=4)
    asked = entries.select(entries["entry_id"].alias("query_id"), "vector")
    plain = link.tiles

    def tiles(k, digits):
        def run(batches):
            for pdf in batches:
                assert pdf["vectors"].map(len).max() <= 8 * 8 * 16
                yield from plain(k, digits)(iter([pdf]))

        return run

    monkeypatch.setattr(link, "tiles", tiles)
    found = vector_index.search(index, asked, 5, 2)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    got = sorted(map(tuple, vector_index.exact(index, asked, 5).collect()))
    assert got == sorted(map(tuple, link.retrieve(asked, entries, 5).collect()))
