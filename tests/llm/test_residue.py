"""Template residue and error-page text."""

from factloom.llm.residue import residue, without_residue

REPORT = "The board approved the plan in 2024. Requests answered with a 404 status fell by a third. Readers must sign in at the desk."
CASES = {
    1: (REPORT, None), 2: (REPORT + " Contact {{ first_name }} for more.", "placeholder"), 3: ("404 Not Found\nThe requested report could not be located on this server.", "error"),
    4: ("Reader view\nPlease enable JavaScript in your browser to view this report.", "script"), 5: ("Lorem ipsum dolor sit amet consectetur. Magna aliqua dolore ut labore.", "filler"), 6: ("asdf asdf asdf\nasdf asdf asdf", "filler"),
    7: ("The sample covers the set {2022, 2023} and excludes [sic] one return [3].", None), 8: ("", None), 9: (None, None), 10: ("Annual Report 2024", None), 11: ("خطأ 404: الصفحة المطلوبة غير موجودة.", "error"),
    12: ("Placeholder estimates used in the first edition were replaced by audited figures.", None), 13: ("«company_name» reported a loss.", "placeholder"), 14: ("« La saison sera calme », a dit Mme Roe.", None), 15: ("[region] sales rose.", "placeholder"),
}


def test_reasons(spark):
    rows = [(k, "s", t, "x") for k, (t, _) in CASES.items()]
    texts = spark.createDataFrame([*rows, (None, "s", "404 Not Found", "x")], "doc_id long, source string, text string, kind string")
    found = residue(texts, "doc_id", "source")
    assert {r["doc_id"]: r["reason"] for r in found.collect()} == {k: r for k, (_, r) in CASES.items() if r}
    kept = without_residue(texts.where("doc_id is not null"), found, "doc_id").collect()
    assert {r["doc_id"] for r in kept} == {k for k, (_, r) in CASES.items() if not r} and all(r["kind"] == "x" for r in kept)


def test_a_wide_message_beside_notices_only_is_adopted(spark):
    odd = "This reading room has gone fishing until spring comes round."
    rows = [(i, f"s{i % 3}", f"404 Not Found\n{odd}") for i in range(6)] + [(9, "s", f"{REPORT}\n404 Not Found")]
    texts = spark.createDataFrame(rows, "doc_id long, source string, text string")
    assert {r["doc_id"] for r in residue(texts, "doc_id", "source").collect()} == set(range(6))
    also = texts.union(spark.createDataFrame([(10, "s", f"{odd} {REPORT}")], texts.schema))
    assert not residue(also, "doc_id", "source").collect()


def test_empty_table(spark):
    assert residue(spark.createDataFrame([], "doc_id long, source string, text string"), "doc_id", "source").count() == 0
