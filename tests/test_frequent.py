"""Texts that most slots have."""

from __future__ import annotations

from casebook.plans import catalogue
from tests.compare import difference

SF = "/root/testdata/sf0.001"


def test_slots_are_counted_before_they_meet_their_text(spark):
    df = catalogue.QUERIES["link_distinct_texts"](spark, SF)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Join Inner")]  # nothing but counts goes to the join
    assert difference(df, catalogue.ORACLE_SQL["link_distinct_texts"], SF) == ""
