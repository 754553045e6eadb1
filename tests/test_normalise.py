"""Golden values of the normalisers."""

import pytest
from pyspark.sql import functions as F

from factloom.functions import normalise as N

PERIODS = {
    "FY24": "2023-2024", "FY 2024-25": "2024-2025", "2024-25": "2024-2025", "as at end-March 2025": "2025-03-31", "end-December 2024": "2024-12-31", "Q4 FY24": "2024-Q4", "31 July 2023": "2023-07-31",
    "September 30, 2019": "2019-09-30", "2019": "2019", "July 2023": "2023-07-31", "end-February 2024": "2024-02-29", "some time later": None, "": None, None: None, "Q3:2024-25": "2024-Q3", "12-13": "2012-2013", "2024-27": "2024",
}
QUANTITIES = {
    "₹8,142 Cr": (8142.0, "INR", 8.142e10), "₹81,415 Mn": (81415.0, "INR", 8.1415e10), "₹(452) Cr": (-452.0, "INR", -4.52e9), "6.5 per cent (of GDP)": (6.5, "% of GDP", 6.5), "6.5 per cent": (6.5, "%", 6.5),
    "578 Cr": (578.0, None, 5.78e9), "US$ 668.3 billion": (668.3, "USD", 6.683e11), "Rs. 578 Cr": (578.0, "INR", 5.78e9), "740 Mn shipments": (740.0, "shipments", 7.4e8), "25 bps": (25.0, "bps", 25.0), "-3 kg": (-3.0, "kg", -3.0), "none": (None, None, None), "": None, None: None,
}


def _map(spark, values, build):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return {values[r["i"]]: r["x"] for r in rows.select("i", build(F.col("v")).alias("x")).collect()}


def test_periods(spark):
    assert _map(spark, list(PERIODS), N.period_key) == PERIODS


def test_quantities(spark):
    got = _map(spark, list(QUANTITIES), N.parse_quantity)
    for text, want in QUANTITIES.items():
        if want is None:
            assert got[text] is None
        else:
            assert got[text]["unit"] == want[1], text
            assert (got[text]["mantissa"], got[text]["normalized"]) == (want[0], pytest.approx(want[2]) if want[2] is not None else None), text


def test_names_and_metrics(spark):
    names = ["Fleetline Limited", "Fleetline Ltd.", "Fleetline", "Northwind Freight's", "The Group", "", None, "  "]
    assert list(_map(spark, names, N.entity_key).values()) == ["fleetline", "fleetline", "fleetline", "northwind_freight", "the_group", "unknown", "unknown", "unknown"]
    labels = ["foreign exchange reserves", "foreign exchange reserve", "policies in force", "the of", None, "Glasses"]
    assert list(_map(spark, labels, N.predicate_key).values()) == ["foreign_exchange_reserve", "foreign_exchange_reserve", "policy_force", "", "", "glass"]
    acronyms = F.create_map(F.lit("GDP"), F.lit("gross domestic product"))
    assert _map(spark, ["real GDP growth"], lambda c: N.predicate_key(c, acronyms)) == {"real GDP growth": "real_gross_domestic_product_growth"}


@pytest.mark.parametrize(("a", "b", "tier"), [("ebitda_margin", "ebitda_margin", "exact"), ("reserve", "foreign_exchange_reserve", "head"), ("headline_inflation", "core_inflation", None), ("total_income", "freight_tonnage", None), ("real_gdp_growth", "gdp_growth", "phrase"), ("", "x", None)])
def test_tiers(spark, a, b, tier):
    row = spark.createDataFrame([(a, b)], "a string, b string").select(N.predicate_match(F.col("a"), F.col("b")).alias("m"), N.predicates_related(F.col("a"), F.col("b")).alias("r")).first()
    assert row["m"]["tier"] == tier and row["r"] == (tier is None and bool(set(a.split("_")) & set(b.split("_"))))


def test_units_and_rendering(spark):
    pairs = [("USD", "INR", False), ("USD", "%", False), ("INR", "INR", True), (None, "INR", True), ("kg", "tonnes", True), ("kg", "days", False), ("widgets", "lamps", True)]
    rows = spark.createDataFrame(pairs, "a string, b string, w boolean").select(N.units_comparable(F.col("a"), F.col("b")).alias("got"), "w").collect()
    assert all(r["got"] == r["w"] for r in rows)
    values = [(1e9, "INR", "1B INR"), (8.142e10, "INR", "81.42B INR"), (42.5, None, "42.5"), (18.25, "%", "18.25%"), (25.0, "bps", "25 bps"), (None, "kg", "n/a"), (0.0, "kg", "0 kg"), (1234.0, "t", "1.234K t"), (-4.52e9, "INR", "-4.52B INR"), (1e-5, None, "1e-05")]
    got = spark.createDataFrame(values, "v double, u string, w string").select(N.describe_value(F.col("v"), F.col("u")).alias("got"), "w").collect()
    assert [r["got"] for r in got] == [r["w"] for r in got]
