"""Files in, facts out, in batches and as a stream."""

from factloom.operators.compare import compare_all
from factloom.sources.files import discover, new_files, pages_of, plain_text
from factloom.streaming.ingest import fold_in_pages, relationships, stored

A = "Northwind Freight\nRevenue from services grew to 3,150 crore in FY24. Northwind Freight employed staff."
B = "Northwind Freight\nRevenue from services was 31,500 million in FY24. Northwind Freight employed staff."


def _pdf(lines):
    return b"%PDF-1.4\n1 0 obj\nstream\n" + b"\n".join(b"(" + t.encode("latin-1").replace(b"(", b"\\(").replace(b")", b"\\)") + b") Tj" for t in lines) + b"\nendstream\nendobj"


def test_files(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for name, content in (("01-annual_report.pdf", _pdf(["One (1)", "Two"])), ("deep/copy.pdf", _pdf(["One (1)", "Two"])), ("empty.pdf", b""), ("note.pdf", b"hello"), ("bad.pdf", b"%PDF-1.4 nothing"), ("x.txt", b"%PDF-")):
        (tmp_path / "in" / name).write_bytes(content)
    found = discover(spark, f"{tmp_path}/in")
    rows = {r["filename"]: r for r in found.collect()}
    assert set(rows) == {"01-annual_report.pdf", "copy.pdf", "note.pdf", "bad.pdf"} and rows["01-annual_report.pdf"]["title"] == "Annual Report"
    assert rows["note.pdf"]["error_message"] == "the file is no PDF" and rows["note.pdf"]["status"] == "failed"
    none = found.limit(0)
    assert new_files(found, none).count() == 3 and new_files(found, found).count() == 0
    pages = [(r["text"], r["extract_error"]) for r in pages_of(new_files(found, none), plain_text).collect()]
    assert sorted(pages) == [("", "the file has no page with text"), ("One (1)\nTwo", None)]


def test_stream_equals_batch(spark, tmp_path):
    for name, text in (("a", A), ("b", B)):
        spark.createDataFrame([(name, 1, text)], "document_id string, page_number int, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        fold_in_pages(spark, f"{tmp_path}/in", f"{tmp_path}/store", f"{tmp_path}/mark").awaitTermination()
    facts = stored(spark, f"{tmp_path}/store", "facts")
    assert {r["document_id"] for r in facts.collect()} == {"a", "b"}
    found = {(r["fact_a_id"], r["fact_b_id"], r["relationship_type"]) for r in relationships(spark, f"{tmp_path}/store").collect()}
    assert found == {(r["fact_a_id"], r["fact_b_id"], r["relationship_type"]) for r in compare_all(facts).collect()} and "CORROBORATED" in {t for _, _, t in found}
