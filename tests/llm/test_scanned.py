"""Repair of scanned text."""

from factloom.llm.scanned import Repair, confused, paragraphs, read_numeral, strokes

WORDS = "committee framework municipal revenue progressed corridor electricity deteriorated management considers outcome satisfactory department published separate statement".split()


def test_confusions_and_numerals():
    assert confused("cornmittee", "committee") == 1 and confused("cornrnittee", "committee") == 2 and confused("komittee", "committee") is None
    assert strokes("progressecl") == strokes("progressed") and strokes("reveniie") == strokes("revenue")
    assert [read_numeral(x) for x in ("2O25", "S,2l5.1", "g.99", "1O:07", "€4,49S", "12", "FY23", "3lbs")] == ["2025", "5,215.1", "9.99", "10:07", "€4,495", None, None, None]
    assert read_numeral("12l", units="l") is None and read_numeral("12l") == "121"


def _pages():
    pages = []
    for d in range(3):
        for n in range(1, 9):
            body = "\n".join(" ".join(WORDS[(d + n + i + j) % len(WORDS)] for j in range(9)) + "." for i in range(12))
            pages.append((f"d{d}_p{n}", f"d{d}", n, f"Northfield Accounts 2024\n{body}\n\n[{n}]"))
    return pages


def test_faults_and_repair(spark):
    pages = _pages()
    bad = "Northfield Accounts 2024\nThe cornmittee considers the outcome satisfactory and the electri-\ncity of the municipal corridor.\nThe manage¬\nment progressecl in 2O25.\n\n[9]"
    rows = [*pages, ("d0_p9", "d0", 9, bad), ("d0_p9", "d0", 9, bad), ("x", "d1", None, None), ("y", None, 1, "a"), ("d2_p9", "d2", 9, "")]
    df = spark.createDataFrame(rows, "id string, document_id string, page_number int, text string")
    titles = spark.createDataFrame([(f"d{d}", "Northfield Accounts 2024", None) for d in range(3)], "document_id string, title string, publisher string")
    repair = Repair(df, titles)
    found = {tuple(r) for r in repair.faults().select("line_no", "kind", "word").where("id = 'd0_p9'").collect()}
    assert found == {(1, "header", ""), (2, "char", "committee"), (2, "hyphen", "electricity"), (4, "hyphen", "management"), (5, "char", "progressed"), (5, "char", "2025"), (7, "page_number", "")}
    others = {(r["kind"], r["line_no"]) for r in repair.faults().where("id = 'd1_p3'").collect()}
    assert others == {("header", 1), ("page_number", 15)}
    text = {r["id"]: r["text"] for r in repair.repaired().collect()}
    assert text["d0_p9"] == "The committee considers the outcome satisfactory and the electricity of the municipal corridor. The management progressed in 2025."
    assert text["d2_p9"] == "" and set(text) == {p[0] for p in pages} | {"d0_p9", "d2_p9"}


def test_paragraphs_are_parted_by_blank_lines():
    assert paragraphs("a b\nc\n\nd", []) == "a b c\n\nd"
    assert paragraphs("H\nx wor-\nds y", [{"line_no": 1, "kind": "drop", "written": "", "word": ""}, {"line_no": 2, "kind": "join", "written": "wor\nds", "word": "words"}]) == "x words y"


def test_empty_table(spark):
    df = spark.createDataFrame([], "id string, document_id string, page_number int, text string")
    repair = Repair(df, spark.createDataFrame([], "document_id string, title string, publisher string"))
    assert repair.faults().count() == 0 and repair.repaired().count() == 0
