"""Quantities and their units."""

from decimal import Decimal as D

import pytest

from factloom.operators.quantities import Unread, quantity, to_common_units, unit_vector

BASE = {
    "500 ml": ("volume", "0.0005"), "5 mm": ("distance", "0.005"), "20 mg": ("mass", "0.00002"), "30 ms": ("duration", "0.03"), "5 mW": ("power", "0.005"), "5 MW": ("power", "5000000"), "5 mw": ("power", "5000000"), "5 gm": ("mass", "0.005"), "2 Gwh": ("energy", "7200000000000"),
    "3 ML": ("volume", "3000"), "3 MT": ("mass", "3000"), "5 inches": ("distance", "0.127"), "2 weeks": ("duration", "1209600"), "20 °C": ("temperature", "293.15"), "5 volts": ("voltage", "5"), "60 km/h": ("speed", None), "5 t/ha": ("yield", "0.5"), "5 hp": ("power", None), "5 people": ("count", "5"),
    "5 long tons": ("mass", "5080.234544"), "12 lamps": ("count", "12"), "5.78 kilowatt-hours": ("energy", "20808000"), "1.5 lakh sq. ft.": ("area", "13935.456"), "(3) kg": ("mass", "-3"), "2 kg/m³": ("density", "2"),
}


@pytest.mark.parametrize("raw", BASE)
def test_base_values(raw):
    family, value = BASE[raw]
    got = quantity(raw, None, None, ".")
    assert got[0] == family and (value is None or got[2] == D(value))


@pytest.mark.parametrize(("raw", "reason"), [("20 degrees", "unknown_unit"), ("3 kWh per capita", "unknown_dimension"), ("5", "no_unit"), ("none", "no_number"), ("", "no_value"), (None, "no_value"), ("5 of them", "unknown_unit")])
def test_reasons(raw, reason):
    assert quantity(raw, None, None, ".") == Unread(reason)


def test_decimal_marks_and_evidence():
    assert quantity("1.234,5 kg", None, None, ",")[2] == D("1234.5") and quantity("1,234.5 kg", None, None, ".")[2] == D("1234.5")
    assert quantity("525.7", "kg", "Capacity was 525.7, all amounts being stated in MW (2016).", ".")[:1] == ("power",)
    assert quantity("7", "kg", None, ".")[0] == "mass"


def test_offsets_do_not_multiply():
    assert unit_vector("celsius per hour") is None and unit_vector("kelvin")[2] == 0


def test_columns_pass_through(spark):
    rows = [("a", "5 km", None, None, ".", 1), ("a", "5 km", None, None, ".", 1), ("b", None, None, None, None, 2), ("c", "1e", None, None, ".", 3), ("d", "9e99", "km", None, ".", 4), ("e", "99999999999999999999 km", None, None, ".", 5)]
    df = spark.createDataFrame(rows, "id string, value_raw string, unit string, evidence_quote string, decimal_mark string, reason_of_mine int")
    got = {r["id"]: r for r in to_common_units(df, {"distance": "m"}, ["id", "reason_of_mine"]).collect()}
    assert (got["a"]["value_common"], got["a"]["common_unit"], got["a"]["reason_of_mine"]) == (5000, "m", 1)
    assert [got[k]["reason"] for k in "be"] == ["no_value", "beyond_64_bits"] and got["e"]["quantity"] == pytest.approx(1e23)
    assert to_common_units(df.limit(0), {}, ["id"]).count() == 0
