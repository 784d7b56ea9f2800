"""Rows of an order in the order of their columns, whatever the size of part and supplier keys, against the queries' SQL."""

from __future__ import annotations

from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from casebook.operators import merge
from casebook.plans import catalogue, roundtrips
from tests.compare import difference

SF = "/root/testdata/sf0.001"
LINES = [
    (1, 1_100_000, 7, 1, 30.0, "N"), (1, 50_000, 7, 2, 25.0, "N"),  # part keys beyond a million, and suppliers beyond 100,000
    (2, 5, 250_000, 1, 30.0, "N"), (2, 6, 1, 1, 40.0, "N"), (2, 2_500_000, 3, 3, 5.0, "N"), (2, 1, 3, 5, 50.0, "A"),
    (3, 9, 9, 1, 30.0, "N"), (3, 9, 9, 1, 30.0, "N"),  # equal rows, of which one is the first
]


@pytest.fixture
def tables(tmp_path):
    for path in Path(SF).iterdir():
        if path.stem not in ("lineitem", "orders"):
            (tmp_path / path.name).symlink_to(path)
    names = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.string()]
    pq.write_table(pa.table([pa.array(c, k) for c, k in zip(zip(*LINES, strict=True), kinds, strict=True)], names), tmp_path / "lineitem.parquet")
    pq.write_table(pa.table({"o_orderkey": [1, 2, 3], "o_orderstatus": ["O", "F", "P"]}), tmp_path / "orders.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["first_occurrence", "first_rows", "merge_positional"])
def test_large_keys(spark, tables, name):
    plans = roundtrips if name == "first_rows" else catalogue
    assert difference(plans.QUERIES[name](spark, tables), plans.ORACLE_SQL[name], tables) == ""


def test_one_of_equal_rows_is_the_first(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), (None, 4), (None, 4)], "k string, row int").repartition(3)
    assert merge.first_occurrence(df, "k", "row").where("is_first").count() == 2
