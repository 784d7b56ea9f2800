"""Benchmark items with a null id, against the query's SQL."""

from __future__ import annotations

import duckdb
import pytest

from casebook.llm import decontaminate, registry


@pytest.mark.parametrize("block", [1 << 25, 40])
def test_null_item_ids_are_searched_as_by_the_sql(spark, monkeypatch, tmp_path, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    docs = ["a b c d e f g h i j k l m", "x Y z", "q r", "nothing", None]
    items = [(None, "B c d e f g h i j k l"), (None, "y z"), (7, "q r"), (None, "q"), (8, None), (None, None)]
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    out = registry.op8_decontamination(spark, str(tmp_path))
    assert {r["doc_id"]: (r["n_hit"], r["n_items"], r["contaminated"]) for r in out.collect()} == {0: (11, 1, True), 1: (2, 1, True), 2: (2, 2, True), 3: (0, 0, False), 4: (0, 0, False)}
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert sorted(map(tuple, out.collect())) == sorted(con.execute(registry.ORACLE_SQL["op8_decontamination"]).fetchall())
