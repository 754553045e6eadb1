"""The registered queries of the training-data operators over small tables."""

import __spark_entry__
from factloom.llm.groups import assign_groups

PAIRS = "fact_a_id string, fact_b_id string, relationship_type string"


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_groups(spark, tmp_path):
    spark.createDataFrame([(x,) for x in "abcdef"] + [("a",)], "id string").write.parquet(f"{tmp_path}/facts.parquet")
    links = [("b", "a", " corroborated\n"), ("c", "b", "CORROBORATED"), ("d", "X", "CORROBORATED"), ("X", "a", "CORROBORATED"), ("e", "a", "CONTRADICTED"), ("f", "f", "CORROBORATED"), (None, "f", "CORROBORATED")]
    spark.createDataFrame(links, PAIRS).write.parquet(f"{tmp_path}/fact_relationships.parquet")
    queries = __spark_entry__.queries()
    assert _rows(queries["p1_found"](spark, str(tmp_path))) == [("a", "a"), ("a", "b"), ("a", "c")]
    assert _rows(queries["p1_groups"](spark, str(tmp_path))) == [("a", "a"), ("a", "b"), ("a", "c"), ("d", "d"), ("e", "e"), ("f", "f")]


def test_an_unknown_id_links_nothing(spark):
    records = spark.createDataFrame([("a",), ("b",)], "id string")
    pairs = spark.createDataFrame([("a", "X"), ("X", "b"), ("b", "A")], "l string, r string")
    assert _rows(assign_groups(records, "id", pairs, "l", "r")) == [("a", "a"), ("b", "b")]


def test_repeated_lines(spark, tmp_path):
    head = "Northfield Annual Report {}"
    pages = [(f"d_p{n}", "d", n, f"{head.format(n)}\n\nOnly page {'abcdef'[n]} says this here") for n in range(6)]
    spark.createDataFrame(pages + pages[:1], "id string, document_id string, page_number int, text string").write.parquet(f"{tmp_path}/document_pages.parquet")
    queries = __spark_entry__.queries()
    assert _rows(queries["p3_found"](spark, str(tmp_path))) == [(f"d_p{n}", 1) for n in range(6)]
    cleaned = {r["id"]: r["text"] for r in queries["p3_pages"](spark, str(tmp_path)).collect()}
    assert cleaned == {f"d_p{n}": f"\nOnly page {'abcdef'[n]} says this here" for n in range(6)}


def test_mixture(spark, tmp_path):
    docs = [(n, "some words of a report " * 20, "big" if n < 9 else "small") for n in range(10)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("big", 0.7, 2), ("small", 0.3, 2)], "source string, target_share double, max_repeats int").write.parquet(f"{tmp_path}/mix_targets.parquet")
    queries = __spark_entry__.queries()
    assert _rows(queries["p9_found"](spark, str(tmp_path))) == [("small",)]
    mixed = queries["p9_mixture"](spark, str(tmp_path)).collect()
    assert sorted(r["copy"] for r in mixed if r["source"] == "small") == [0, 1]
    shares = {r["source"]: r for r in queries["p9_shares"](spark, str(tmp_path)).collect()}
    assert shares["small"]["documents"] == 2 and shares["big"]["documents"] == len(mixed) - 2
    assert abs(sum(r["share"] for r in shares.values()) - 1) < 1e-9
