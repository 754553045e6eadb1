"""Verdicts over pairs of facts."""

import pytest
from pyspark.sql import Row

from factloom.operators.compare import candidate_pairs, compare_all, facts_once, relationship_id

SCHEMA = "id string, document_id string, subject string, subject_normalized string, predicate string, predicate_label string, value_raw string, value_text string, value_numeric double, unit string, time_period string, time_period_normalized string, scope string, qualifier string, confidence double, extraction_metadata struct<period_inferred_from_document:boolean>"
BASE = {
    "id": "f1", "document_id": "docA", "subject": "Acme Logistics", "subject_normalized": "acme_logistics", "predicate": "operating_revenue", "predicate_label": "Operating revenue", "value_raw": "100 crore", "value_text": None, "value_numeric": 1e9, "unit": "INR",
    "time_period": "FY24", "time_period_normalized": "2023-2024", "scope": None, "qualifier": None, "confidence": 0.9, "extraction_metadata": (False,),
}
OTHER = {"value_raw": "140 crore", "value_numeric": 1.4e9}
NEXT = {"time_period": "FY25", "time_period_normalized": "2024-2025"}
CASES = [
    ({}, {"value_raw": "1,000 million"}, "CORROBORATED", ""), ({}, {"value_numeric": 1.005e9}, "CORROBORATED", ""), ({}, OTHER, "CONTRADICTED", "140 crore"), ({"qualifier": "First Advance Estimate"}, OTHER | {"qualifier": "Second Advance Estimate"}, "CONTRADICTED", "Second Advance Estimate"),
    ({}, OTHER | NEXT, "CONTEXTUALLY_DIFFERENT", "FY25"), ({"scope": "Standalone"}, OTHER | {"scope": "Consolidated"}, "CONTEXTUALLY_DIFFERENT", "Standalone"), ({}, {"unit": "USD"}, "RELATED_BUT_NOT_COMPARABLE", "exchange rates"), ({}, {"unit": "%"}, "RELATED_BUT_NOT_COMPARABLE", ""),
    ({"confidence": 0.4}, OTHER, None, ""), ({"extraction_metadata": (True,)}, OTHER, "RELATED_BUT_NOT_COMPARABLE", "stated"), ({}, {"document_id": "docA"}, None, ""), ({}, {"subject_normalized": "globex_shipping"}, None, ""), ({}, NEXT, None, ""),
    ({}, {"predicate": "headcount_total"}, None, ""), ({}, {"value_numeric": None, "value_raw": "100 Crore"}, "CORROBORATED", "No number"), ({}, {"value_numeric": None, "value_raw": "many"}, "RELATED_BUT_NOT_COMPARABLE", ""), ({}, OTHER | {"predicate": "revenue"}, None, ""),
    ({}, {"predicate": "revenue"}, "CORROBORATED", ""), ({}, {"subject_normalized": "acme"}, "CORROBORATED", ""), ({"unit": None}, {"unit": "USD"}, "CORROBORATED", ""), ({}, OTHER | {"qualifier": "Audited"}, "CONTRADICTED", "Audited"),
]


@pytest.fixture(scope="module")
def verdicts(spark):
    """Every case in documents and under a subject and metric of its own, judged at once."""
    rows = []
    for i, (a, b, _, _) in enumerate(CASES):
        for side, over in (("a", a), ("b", b)):
            fact = BASE | ({"id": "f2", "document_id": "docB"} if side == "b" else {}) | over
            fact["id"], fact["document_id"] = f"{i}{side}", f"{i}{fact['document_id']}"
            fact["subject_normalized"] = "_".join(f"{w}{i}" for w in fact["subject_normalized"].split("_"))
            rows.append(Row(**fact))
    rows += [Row(**BASE | {"id": "n1", "predicate": None}), Row(**BASE | {"id": "n2", "document_id": None}), Row(**BASE | {"id": None}), Row(**BASE | {"id": "n3", "subject_normalized": ""})]
    facts = spark.createDataFrame([tuple(r[f.split()[0]] for f in SCHEMA.split(", ")) for r in rows] * 2, SCHEMA)
    return {int(r["fact_a_id"][:-1]): r for r in compare_all(facts).collect()}, facts


@pytest.mark.parametrize("i", range(len(CASES)))
def test_verdict(verdicts, i):
    _, _, want, word = CASES[i]
    got = verdicts[0].get(i)
    assert (got and got["relationship_type"]) == want and (want is None or word in got["reasoning"])


def test_pairs_come_once_and_ids_are_stable(spark, verdicts):
    pairs = [(r["id_a"], r["id_b"]) for r in candidate_pairs(facts_once(verdicts[1])).collect()]
    assert len(pairs) == len(set(pairs)) and all(a < b for a, b in pairs)
    from pyspark.sql import functions as F

    row = spark.createDataFrame([("x", "y")], "a string, b string").select(relationship_id(F.col("a"), F.col("b")).alias("p"), relationship_id(F.col("b"), F.col("a")).alias("q")).first()
    assert row["p"] == row["q"] and len(row["p"]) == 24


def test_empty_table(spark):
    assert compare_all(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_hot_metric_is_split_and_whole(spark, monkeypatch):
    import factloom.operators.compare as compare

    monkeypatch.setattr(compare, "HOT", 3)
    rows = [BASE | {"id": f"h{i}", "document_id": f"d{i % 4}"} for i in range(12)]
    facts = spark.createDataFrame([tuple(r[f.split()[0]] for f in SCHEMA.split(", ")) for r in rows], SCHEMA)
    assert compare_all(facts).count() == sum(1 for i in range(12) for j in range(i) if i % 4 != j % 4)


def test_judging_pairs_runs_as_compiled_code(spark):
    from factloom.queries_reference import QUERIES

    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "65535")
    QUERIES["relationship_reasoning"](spark, "/root/testdata/sf0.001")
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_a_hot_metric_has_a_part_for_each_so_many_facts(spark, monkeypatch):
    import factloom.operators.compare as compare

    monkeypatch.setattr(compare, "HOT", 3)
    rows = [BASE | {"id": f"h{i:02}", "document_id": f"d{i % 4}"} for i in range(60)]
    facts = spark.createDataFrame([tuple(r[f.split()[0]] for f in SCHEMA.split(", ")) for r in rows], SCHEMA)
    pairs = candidate_pairs(facts_once(facts))
    assert "(_n" in pairs._jdf.queryExecution().analyzed().toString() and pairs.count() == 60 * 45 // 2
    assert "ceil" in pairs._jdf.queryExecution().analyzed().toString().lower()


def test_values_without_end_are_judged(spark):
    rows = [BASE | {"id": i, "document_id": i, "value_numeric": v} for i, v in (("a", float("nan")), ("b", float("inf")), ("c", 1e9), ("d", None))]
    facts = spark.createDataFrame([tuple(r[f.split()[0]] for f in SCHEMA.split(", ")) for r in rows], SCHEMA)
    got = {(r["fact_a_id"], r["fact_b_id"]): (r["relationship_type"], r["reasoning"] is not None) for r in compare_all(facts).collect()}
    assert len(got) == 6 and all(said for _, said in got.values())
    assert got["a", "b"] == got["a", "c"] == got["b", "c"] == ("CONTRADICTED", True) and got["c", "d"] == ("CORROBORATED", True)


def test_agreement_is_counted_before_titles_are_written(spark):
    from factloom.queries_reference import QUERIES

    import factloom.operators.compare as compare

    long = "m" * 300
    facts = [BASE | {"id": f"{m}{i}", "document_id": f"d{i}", "predicate": f"metric_{m}", "predicate_label": long + m, "value_numeric": v} for m in "xy" for i, v in enumerate((1e9, 1.005e9, None, 5e9))]
    rows = spark.createDataFrame([tuple(r[f.split()[0]] for f in SCHEMA.split(", ")) for r in facts], SCHEMA)
    want = compare_all(rows).where("comparison_summary like 'Not numerically%' or comparison_summary like 'Corroborated%'").groupBy("comparison_summary").count()
    got = {r["comparison_summary"]: r["pairs"] for r in compare.count_agreement(rows).collect()}
    assert got == {r[0]: r[1] for r in want.collect()} and len(got) == 1 and sum(got.values()) == 8
    assert "_step" in QUERIES["textual_compare"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().split("Aggregate")[2].split("\n")[0]
