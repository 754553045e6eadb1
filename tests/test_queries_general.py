"""The whole results beside the checked subsets."""

import __spark_entry__

DIR = "/root/testdata/sf0.001"


def test_times_have_their_marks(spark):
    queries = __spark_entry__.queries()
    times = queries["p4_times"](spark, DIR).collect()
    assert times and all(r["resolved"] == (r["reason"] is None) for r in times)
    assert all((r["moment"] is None) == (r["reason"] in ("no_day", "unknown_zone")) for r in times)
    assert {(r["id"], r["moment"]) for r in times if r["moment"]} == {tuple(r) for r in queries["p4_found"](spark, DIR).collect()}


def test_values_hold_the_right_ones_too(spark):
    queries = __spark_entry__.queries()
    rows = queries["p6_values"](spark, DIR).collect()
    values = {(r["id"], r["common_unit"], r["value_common"]) for r in rows if r["value_common"] is not None}
    found = {tuple(r) for r in queries["p6_found"](spark, DIR).collect()}
    assert found < values and len(rows) == len({r["id"] for r in rows})
    assert all((r["value_common"] is None) == (r["reason"] is not None) for r in rows)
