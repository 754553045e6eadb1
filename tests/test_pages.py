"""Page text into lines, and documents into profiles."""

import pytest
from pyspark.sql import functions as F

from factloom.operators.pages import canonical_pages, is_heading, lines_with_offsets, strip_controls, table_blocks
from factloom.operators.profile import clean_name, name_key, profile_documents

PAGES = "document_id string, page_number int, text string"


def _reflow(spark, text):
    return canonical_pages(spark.createDataFrame([("d", 1, text)], PAGES)).first()


def test_reflow(spark):
    prose = "The committee considered the reports of all the departments and agreed\nthat the budget should be raised in the coming year because expendi-\nture had risen in every quarter of the last two years without a break"
    assert _reflow(spark, prose)["text"].count("\n") == 0 and "expenditure" in _reflow(spark, prose)["text"]
    assert _reflow(spark, "42%\nmargin\n₹3,150 Cr\nrevenue")["text"].count("\n") == 3
    assert _reflow(spark, "a  b\t c\n\n\n d ")["text"] == "a b c\nd"
    assert (_reflow(spark, None)["text"], _reflow(spark, None)["is_empty"]) == (None, True) and _reflow(spark, "")["char_length"] == 0
    assert _reflow(spark, "x​y\u0007z")["text"] == "xyz"


def test_very_long_pages(spark):
    got = _reflow(spark, "\n".join(f"Line number {i} of a long page that has no end of sentence" for i in range(3000)))
    assert got["text"].count("\n") == 0


@pytest.mark.parametrize(("line", "want"), [("Annual Quality and Safety Report", True), ("The committee agreed on it", False), ("Report", False), ("Annual Report.", False)])
def test_headings(spark, line, want):
    assert spark.createDataFrame([(line,)], "x string").select(is_heading(F.col("x"))).first()[0] is want


def test_composed_form(spark):
    assert spark.createDataFrame([("é‍",), (None,)], "x string").select(strip_controls(F.col("x"))).collect()[0][0] == "é"


def test_lines_and_tables(spark):
    df = spark.createDataFrame([("d", 1, "One\n\nA 1 2 3\nB 4 5 6\nC 7 8 9\nEnd"), ("e", 1, None)], PAGES)
    rows = [(r["line_no"], r["line"], r["line_start"], r["prev_line"], r["next_line"]) for r in lines_with_offsets(df, ["document_id"]).orderBy("line_no").collect()]
    assert rows[:2] == [(0, "One", 0, "", "A 1 2 3"), (1, "A 1 2 3", 5, "One", "B 4 5 6")] and rows[-1][-1] == ""
    assert sorted((r["first_row"], r["is_table"], r["rows"]) for r in table_blocks(df, ["document_id"]).collect()) == [(0, False, 1), (1, True, 3), (4, False, 1)]


NAMES = [("The Reserve Bank", "Reserve Bank"), ("Independent Audit of Northfield Health", "Northfield Health"), ("Northwind Freight Annual Report", "Northwind Freight"), ("Table 3", None), ("January March", None), ("USD", None), ("GDP CPI WPI", None), ("YoY", None), ("ab", None)]


@pytest.mark.parametrize(("raw", "want"), NAMES)
def test_names(raw, want):
    assert clean_name(raw) == want


def test_profiles(spark):
    text = "GridCo Renewables plc\nOperating Review\nGridCo Renewables plc generated 14.8 TWh in FY24. The Company said Gross Domestic Product (GDP) rose. GridCo Renewables plc sold power of USD 5 million in FY24."
    pages = spark.createDataFrame([("d", n, text) for n in range(1, 30)] + [("e", 1, None), (None, 1, text), ("f", 1, "nothing here")], PAGES)
    titles = spark.createDataFrame([("f", "Annual Report Somewhere")], "document_id string, title string")
    got = {r["document_id"]: r for r in profile_documents(pages, titles).collect()}
    assert got["d"]["default_subject"].startswith("GridCo Renewables") and got["d"]["default_period"] == "fy24" and got["d"]["acronyms"] == {"GDP": "Gross Domestic Product"}
    assert got["e"]["default_subject"] == "Unknown" and got["f"]["default_subject"] == "Somewhere" and set(got) == {"d", "e", "f"}
    assert name_key("GridCo Renewables plc") == "gridco_renewables"
