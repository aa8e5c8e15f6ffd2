"""Plans read the raw tables a bounded number of times; what several branches need is stored once."""

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
#: Query and how often its final plan may scan a file, stored tables included.
SCANS = {"walk_forward_udf": 4, "variant_comparison": 5, "dm_matrix": 6, "excess_returns": 2, "pick_strict": 2, "walk_forward": 4}


@pytest.mark.parametrize("name", sorted(SCANS))
def test_scans(spark, name):
    df = entry.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= SCANS[name], plan.count("FileScan")
