"""Facts read off invented pages."""

import pytest

from factloom.operators.extract import contents_issues, facts_and_issues, facts_from_proposals, grounded_proposals, read_pages
from factloom.operators.pages import canonical_pages
from factloom.operators.profile import profile_documents

HOSPITAL = ["Northfield Regional Health System", "Annual Quality and Safety Report 2024", "1.1 The System recorded 412,600 outpatient visits in 2024, an increase of 7.2 per cent", "over the 384,900 visits recorded in 2023.", "1.2 The average length of stay declined to 4.3 days in 2024", "from 4.8 days in 2023.", "1.3 The 30-day readmission rate stood at 11.4 per cent in 2024.", "2.1 Net patient service revenue grew to $1,402 million in 2024 from $1,318 million in 2023."]
REGULATOR = ["State Health Commission", "Independent Audit of Northfield Regional Health System, 2024", "The readmission rate for Northfield Regional Health System was 12.8 per cent", "in 2024 on an audited basis.", "Average length of stay was 4.3 days in 2024."]


def _facts(spark, texts, title=None, canonical=True):
    """Facts and issues of one document a text."""
    pages = spark.createDataFrame([(f"d{i}", 1, t) for i, t in enumerate(texts)], "document_id string, page_number int, text string")
    pages = canonical_pages(pages) if canonical else pages
    titles = spark.createDataFrame([("d0", title)], "document_id string, title string") if title else None
    facts, issues = facts_and_issues(read_pages(pages, profile_documents(pages, titles)))
    return facts.collect(), issues.collect()


def _one(spark, text, **kw):
    return _facts(spark, [text], canonical=False, **kw)


def test_prose(spark):
    facts, _ = _one(spark, "The company reported that warehouse throughput reached 42.5 million tonnes in FY24, the highest on record.")
    assert [(f["value_numeric"], f["time_period_normalized"], f["unit"], f["predicate"]) for f in facts] == [(42_500_000.0, "2023-2024", "tonnes", "warehouse_throughput")]


@pytest.mark.parametrize(("text", "word"), [("880 Mn parcels delivered in FY23 across the network.", "parcel"), ("₹3,150 Cr\nFY24 revenue from services\nYoY: 18.2%", "revenue"), ("Zubrowka's sturgeon caviar output reached 91.4 tonnes in 2023.", "caviar")])
def test_labels(spark, text, word):
    assert any(word in f["predicate"] for f in _one(spark, text)[0])


def test_subject_from_the_title(spark):
    facts, _ = _one(spark, "Total income grew to 2,400 crore in FY24. Operating cost fell to 1,900 crore in FY24.", title="Northwind Freight Annual Report")
    assert facts and {f["subject_normalized"] for f in facts} == {"northwind_freight"}


@pytest.mark.parametrize(("text", "reason"), [("See section 4 on page 17 for details.", "bare_number_without_unit"), ("The programme was launched in 2019 and expanded later.", "bare_number_without_unit"), ("Statement of results for the half year ended\ncrore\n250 crore reported", "label_names_a_unit_not_a_metric")])
def test_refusals(spark, text, reason):
    facts, issues = _one(spark, text)
    assert not facts and reason in {i["reason_code"] for i in issues}


def test_every_quote_is_at_its_offsets(spark):
    text = "Revenue was $50 million in 2024. Profit rose to $12 million in 2024, up 3.5 per cent. Staff numbered 300 employees."
    facts, _ = _one(spark, text)
    assert facts and all(text[f["char_start"] : f["char_end"]] == f["evidence_quote"] for f in facts)


def test_inherited_period(spark):
    facts, _ = _one(spark, "Revenue was 300 crore in FY24. Cost was 200 crore in FY24.\n\nOperating margin for the segment stood at 4.5 per cent on a reported basis.")
    flags = {f["value_numeric"]: f["extraction_metadata"]["period_inferred_from_document"] for f in facts}
    assert flags[4.5] and not flags[3e9]


def test_contents(spark):
    text = "Table of Contents\nOverview ........ 3\nRevenue of $5 million ........ 12\nOutlook ........ 20\nNotes ........ 31"
    pages = spark.createDataFrame([("d", 1, text)], "document_id string, page_number int, text string")
    assert not _one(spark, text)[0] and contents_issues(pages).first()["reason_code"] == "table_of_contents_or_index_navigation"
    facts, _ = _one(spark, "Operating revenue reached $150 million in 2024.\nDetailed Segment Analysis …… 45")
    assert [f["value_raw"] for f in facts] == ["$150 million"]


def test_documents_about_one_subject(spark):
    facts, _ = _facts(spark, ["\n".join(HOSPITAL), "\n".join(REGULATOR)])
    mine = [f for f in facts if f["document_id"] == "d0"]
    assert {412600.0, 4.3} <= {f["value_numeric"] for f in mine} and all("Northfield" in f["subject"] for f in facts)
    assert {f["time_period_normalized"] for f in mine if f["value_raw"] == "$1,318 million"} <= {"2023"}


def test_duplicates_and_empty_pages(spark):
    facts, issues = _one(spark, "Revenue was $5 million in 2024.\nRevenue was $5 million in 2024.")
    assert len(facts) == 1 and [i["reason_code"] for i in issues if not i["is_routine_filter"]] == ["duplicate_of_higher_confidence_fact"]
    assert _facts(spark, [None, "", "short"], canonical=False) == ([], [])


def test_proposals_are_checked_against_the_page(spark):
    pages = spark.createDataFrame([("d", 1, "Revenue was 5.")], "document_id string, page_number int, text string")
    given = spark.createDataFrame([("d", 1, "was 5"), ("d", 1, "was 6"), ("d", 2, "was 5"), ("d", 1, None)], "document_id string, page_number int, quote string")
    got = [(r["quote"], r["char_start"], r["char_end"], r["reason"] is None) for r in grounded_proposals(given, pages).collect()]
    assert sorted(got, key=repr) == sorted([("was 5", 8, 13, True), ("was 6", None, None, False), ("was 5", None, None, False), (None, None, None, False)], key=repr)


def test_facts_from_proposals(spark):
    pages = spark.createDataFrame([("d", 1, "Revenue was 5 crore in FY24.")], "document_id string, page_number int, text string")
    rows = [("d", 1, "5 crore", "5 crore", "Revenue", "FY24", 0.99), ("d", 1, "Revenue", "none", "Revenue", None, 0.5), ("d", 1, "Revenue", "5", "the", None, None), ("d", 1, "x y", "5", "Revenue", None, None)]
    given = spark.createDataFrame(rows, "document_id string, page_number int, quote string, value string, metric string, period string, confidence double")
    got = {(r["value"], r["metric"], r["quote"]): r for r in facts_from_proposals(grounded_proposals(given, pages)).collect()}
    good = got["5 crore", "Revenue", "5 crore"]
    assert (good["value_numeric"], good["predicate"], good["time_period_normalized"], good["confidence"], good["reason"]) == (5e7, "revenue", "2023-2024", 0.9, None)
    assert [got[k]["reason"] for k in (("none", "Revenue", "Revenue"), ("5", "the", "Revenue"), ("5", "Revenue", "x y"))] == ["value_could_not_be_normalized", "label_is_only_function_words", "llm_quote_not_present_in_page_text"]
