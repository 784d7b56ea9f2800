"""Queries that write and read back, against SQL over what was written."""

import pytest

from casebook.operators import extraction
from casebook.plans import roundtrips
from tests.compare import difference

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(roundtrips.QUERIES))
def test_round_trip(spark, name):
    assert difference(roundtrips.QUERIES[name](spark, SF), roundtrips.ORACLE_SQL[name], SF) == ""


def test_a_run_without_success_is_an_error_after_its_handlers(spark, tmp_path):
    seen = []
    reports = spark.createDataFrame([(1, 1, "no record")], "report_index long, case_id long, text string")
    with pytest.raises(RuntimeError, match="no report gave a record"):
        extraction.run(reports, "{input_text}", extraction.Echo(), f"file://{tmp_path}/run", on_success=lambda df: seen.append("good"), on_error=lambda df: seen.append(df.first()["error"][:5]))
    assert seen == ["parse"]
