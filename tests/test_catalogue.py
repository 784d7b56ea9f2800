"""Every catalogue query against its SQL, on the smallest tables."""

import pytest

from casebook.plans import catalogue
from tests.compare import difference

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, name):
    df = catalogue.QUERIES[name](spark, SF)
    if name in catalogue.ORACLE_SQL:
        assert difference(df, catalogue.ORACLE_SQL[name], SF) == ""
    else:
        assert df.count() > 0


def test_relational_queries_stay_in_the_jvm(spark):
    for name in ("eval_mcc", "eval_error_partition", "eval_threshold_sweep", "merge_positional", "compare_group_matrix", "first_occurrence", "chunk_windows"):
        plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan, name


def test_scans_read_only_what_is_asked(spark):
    plan = catalogue.QUERIES["link_group_mapping"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<p_partkey:bigint,p_brand:string,p_type:string>" in plan
