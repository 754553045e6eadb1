"""Nulls, ties, repeated rows, empty tables, extra columns and hot keys."""

import random

import pytest

from factloom.llm.bins import fill_containers, unused_room
from factloom.llm.groups import assign_groups, connected_groups
from factloom.llm.mixing import mixture, reached_shares, source_rates
from factloom.llm.repeated_lines import repeated_lines, without_lines
from factloom.plans import joins

PAGES = "id string, document_id string, text string, template string, pages int"


@pytest.fixture(params=["broadcast", "shuffle"])
def either_join(request, monkeypatch):
    if request.param == "shuffle":
        monkeypatch.setattr(joins, "BROADCAST_BYTES", -1)


def _union_find(pairs):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a and b and a != b:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    return {(root(x), x) for x in parent}


def test_groups_with_a_hub_and_chains(spark, either_join):
    rng = random.Random(3)
    pairs = [("hub", f"s{i:03d}") for i in range(120)] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(40)] + [(f"r{rng.randrange(60)}", f"r{rng.randrange(60)}") for _ in range(40)]
    pairs += pairs[:20] + [(b, a) for a, b in pairs[20:40]] + [(None, "x"), ("x", None), ("y", "y")]
    df = spark.createDataFrame([(a, b, 1) for a, b in pairs], "a string, b string, root int")
    assert {tuple(r) for r in connected_groups(df, "a", "b").collect()} == _union_find(pairs)


def test_groups_of_empty_tables(spark):
    none = spark.createDataFrame([], "a string, b string")
    assert connected_groups(none, "a", "b").count() == 0
    records = spark.createDataFrame([("x",), ("x",), (None,)], "k string")
    assert [tuple(r) for r in assign_groups(records, "k", none, "a", "b").collect()] == [("x", "x")]


def test_lines_of_a_hot_report(spark, either_join):
    foot = "This copy may not be passed on, licence {}"
    pages = [(f"h{i}", "hot", f"Body {chr(97 + i % 26) * 20} text\n• {foot.format(i)}\n{foot.format(7).upper()}" if i % 2 else None if i % 10 == 0 else "", "t", 1) for i in range(60)]
    pages += [(f"d{i}", "cold", f"Other words {'abcdef'[i] * 12}", "t", 1) for i in range(6)] + pages[:5] + [(None, "hot", foot, "t", 1), ("z", None, foot, "t", 1)]
    df = spark.createDataFrame(pages, PAGES)
    found = repeated_lines(df, "document_id", "id")
    assert {(r["id"], r["line_no"]) for r in found.collect()} == {(f"h{i}", n) for i in range(1, 60, 2) for n in (2, 3)}
    left = {r["id"]: r["text"] for r in without_lines(df, found, "id").collect()}
    assert left["h1"] == f"Body {'b' * 20} text" and left["h10"] is None and left["h2"] == "" and len(left) == 67


def test_lines_below_the_share_stay(spark):
    line = "A line that recurs on five pages only"
    df = spark.createDataFrame([(f"p{i}", "d", line if i < 5 else f"Page {i} of its own", "t", 1) for i in range(101)], PAGES)
    assert repeated_lines(df, "document_id", "id").count() == 0
    assert repeated_lines(df.where("id < 'p9'"), "document_id", "id").count() == 5
    assert repeated_lines(df.limit(0), "document_id", "id").count() == 0


def test_mixture_of_nulls_and_missing_sources(spark):
    sized = spark.createDataFrame([(1, "a", 100, "r"), (2, "a", None, "r"), (3, None, 50, "r"), (4, "x", 50, "r")], "doc_id long, source string, tokens int, rate string").drop("rate")
    targets = spark.createDataFrame([("a", 0.6, 1), ("b", 0.4, 3), ("c", 0.0, 3)], "source string, target_share double, max_repeats int")
    rates = {r["source"]: r for r in source_rates(sized, targets).collect()}
    assert not rates["a"]["reachable"] and not rates["b"]["reachable"] and rates["c"]["reachable"] and rates["a"]["rate"] == 1.0
    shares = {r["source"]: r["share"] for r in reached_shares(mixture(sized, source_rates(sized, targets), "doc_id"), source_rates(sized, targets)).collect()}
    assert shares == {"a": 1.0, "b": 0.0, "c": 0.0}
    empty = source_rates(sized.limit(0), targets)
    assert {r["reachable"] for r in empty.collect()} <= {True, False} and mixture(sized.limit(0), empty, "doc_id").count() == 0


def test_draws_meet_their_rate(spark):
    sized = spark.range(4000).selectExpr("id as doc_id", "'a' as source", "10 as tokens")
    targets = spark.createDataFrame([("a", 1.0, 5)], "source string, target_share double, max_repeats int")
    rates = source_rates(sized, targets).selectExpr("source", "target_share", "max_repeats", "2.3D as rate", "reachable")
    n = mixture(sized, rates, "doc_id").count()
    assert abs(n - 9200) < 150 and n == mixture(sized.repartition(7), rates, "doc_id").count()


def test_containers_of_nothing(spark):
    kinds = spark.createDataFrame([("k", 10)], "container_kind string, capacity_tokens int")
    sized = spark.createDataFrame([(None, 5), (1, 0), (2, None)], "doc_id long, tokens int")
    filled = fill_containers(sized, kinds, "doc_id")
    assert filled.count() == 0 and unused_room(filled, kinds).first()["containers"] == 0


def test_equal_sizes_fill_up(spark):
    sized = spark.range(100).selectExpr("id as doc_id", "cast(5 as int) as tokens")
    kinds = spark.createDataFrame([("k", 10)], "container_kind string, capacity_tokens int")
    assert unused_room(fill_containers(sized, kinds, "doc_id"), kinds).first()["containers"] == 50
