"""Mixed timestamps."""

import pytest

from factloom.operators.timestamps import normalise_times, read

VALUES = "id string, source string, text string"
CONVENTIONS = [("uk", "Europe/London", "DMY"), ("us", "America/New_York", "MDY")]


def _run(spark, rows, conventions=CONVENTIONS):
    values = spark.createDataFrame([(str(i), s, t) for i, (s, t) in enumerate(rows)], VALUES)
    known = spark.createDataFrame(conventions, "source string, time_zone string, date_order string")
    zones = spark.createDataFrame([("IST", 330), ("EST", -300)], "abbreviation string, utc_offset_minutes int")
    return {int(r["id"]): r for r in normalise_times(values, known, zones).collect()}


def test_moments(spark):
    cases = [
        ("uk", "03/04/2021", "2021-04-03"), ("us", "03/04/2021", "2021-03-04"), ("us", "25/12/2020", "2020-12-25"), ("uk", "2021-07-01 12:00", "2021-07-01T11:00:00Z"), ("uk", "2021-07-01T12:00:00+02:00", "2021-07-01T10:00:00Z"),
        (None, "1 July 2021 9:30 pm IST", "2021-07-01T16:00:00Z"), ("uk", "2021-10-31 01:30", "2021-10-31T00:30:00Z"), ("us", "2021-03-14 02:30", "2021-03-14T07:30:00Z"), (None, "1609459200", "2021-01-01T00:00:00Z"), (None, "20210102", "2021-01-02"),
    ]
    got = _run(spark, [(s, t) for s, t, _ in cases])
    assert [got[i]["moment"] for i in range(len(cases))] == [m for _, _, m in cases]
    assert all(r["resolved"] for r in got.values())


def test_what_cannot_be_read_is_marked(spark):
    got = _run(spark, [("uk", "tbc"), ("uk", "2021-01-01 10:00 XYZT"), ("none", "05/06/2021"), ("uk", ""), ("uk", None)])
    assert [got[i]["reason"] for i in range(4)] == ["no_day", "unknown_zone", "ambiguous_order", "no_day"] and 4 not in got
    assert got[0]["moment"] is got[1]["moment"] is None and got[2]["posterior"] == pytest.approx(0.5)


def test_values_decide_where_nothing_is_declared(spark):
    certain = [("new", f"{d}/02/2021") for d in range(13, 29)] + [("new", f"{d}.03.2021") for d in range(13, 29)]
    got = _run(spark, [*certain, ("new", "05/06/2021"), ("alone", "05/06/2021")])
    assert got[32]["moment"] == "2021-06-05" and got[32]["resolved"] and not got[33]["resolved"]


def test_many_values_outweigh_a_wrong_declaration(spark):
    certain = [("us", f"{13 + i % 15}/{1 + i // 15:02d}/20{j}") for i in range(150) for j in range(10, 20)]
    got = _run(spark, [*certain, ("us", "05/06/2021")])
    assert got[len(certain)]["moment"] == "2021-06-05"


def test_readings_and_empty_table(spark):
    assert read("31/02/2021") is None and read(None) is None and read("12/31/2021")[:3] == (None, 18992, None)
    assert _run(spark, []) == {}
