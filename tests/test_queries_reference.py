"""The reference's queries against their SQL, over whole small tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from factloom import queries_reference

DIR = "/root/testdata/sf0.001"


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return value


@pytest.fixture(scope="module")
def db():
    with duckdb.connect() as con:
        for path in Path(DIR).iterdir():
            con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
        yield con


@pytest.mark.parametrize("name", sorted(queries_reference.ORACLE))
def test_equals_sql(spark, db, name):
    want = db.execute(__spark_entry__.oracle_sql()[name])
    columns, rows = [c[0] for c in want.description], want.fetchall()
    got = __spark_entry__.queries()[name](spark, DIR)
    assert sorted(got.columns) == sorted(columns)
    order = sorted(columns)
    want_rows = sorted((tuple(_plain(r[columns.index(c)]) for c in order) for r in rows), key=repr)
    assert sorted((tuple(_plain(r[c]) for c in order) for r in got.collect()), key=repr) == want_rows


@pytest.mark.parametrize("name", sorted(set(queries_reference.QUERIES) - set(queries_reference.ORACLE)))
def test_runs(spark, name):
    assert queries_reference.QUERIES[name](spark, DIR).count() >= 0


def test_titles(spark):
    rows = [("a", "s real GDP growth has", 1, "q"), ("b", "YoY", 2, "q"), ("c", "Revenue from services excludes goods", 3, "q"), ("d", "qoq", 4, "q"), ("e", "Note due", 5, "q"), ("f", "ab", 6, "q"), ("g", None, 7, "q")]
    facts = spark.createDataFrame([(i, "d", 1, "Acme", t, None, None, n, q) for i, t, n, q in rows] + [("x", "e", 1, "Acme", "growth", None, None, 1, "5% YoY: ₹3,150 Cr; other"), ("y", "f", 1, None, "yoy", None, None, 1, None)], "id string, document_id string, evidence_page int, subject string, predicate_label string, unit string, unit_family string, char_start int, evidence_quote string")
    got = {r["id"]: r["title"] for r in queries_reference.title(facts).collect()}
    assert got == {"a": "real GDP growth", "b": "s real GDP growth has (YoY)", "c": "Revenue from services", "d": "Revenue from services (QoQ)", "e": "Acme Distribution Share", "f": "Acme Metric", "g": "Acme Metric", "x": "other (YoY)", "y": "YoY Growth"}
