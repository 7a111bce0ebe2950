"""Plans and steps that must not grow with the pairs of their rows, on small hot inputs."""

import re

import pytest
from pyspark.sql import functions as F

from graphmill.operators import graph, impact, linking, resolution, retrieval, search


def _top(df):
    """The plan above the place where pairs arise."""
    return df._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]


def test_exact_hits_of_a_hot_word(spark):
    methods = spark.range(300).selectExpr("id node", "'a.C' class_name", "'m' method_name", "'see @Cached' comment", "array('java.io.IOException') thrown")
    queries = spark.range(40).selectExpr("id query_id", "'IOException' query")
    entries = spark.range(1).selectExpr("id node", "'/x' path")
    got = search.exact_hits(search.dispatched(queries), methods, entries)
    assert "Aggregate" not in _top(got)
    assert got.count() == got.distinct().count() == 12000
    twice = queries.union(queries).union(spark.createDataFrame([(0, "@Cached")], "query_id long, query string"))  # one id, two texts
    assert search.exact_hits(search.dispatched(twice), methods, entries).count() == 12000


def test_links_of_a_hot_key(spark):
    p = spark.range(400).selectExpr("id", "id % 3 project", "'q' topic", "'k' kind", "'x' key", "'i' interface", "id % 4 = 0 remote")
    for got, n in (
        (linking.topic_links(p.where("id % 2 = 0"), p.where("id % 2 = 1")), 26667),
        (linking.sibling_links(p), 30000),
        (resolution.bridges_from_endpoints(p.where("id % 3 = 0"), p.where("id % 3 = 1")), 134 * 133),
        (linking.all_links(linking.topic_links(p.where("id % 2 = 0"), p.where("id % 2 = 1")), linking.sibling_links(p)), 56667),
    ):
        assert "Aggregate" not in _top(got)
        assert got.count() == got.distinct().count() == n
    again = p.where("id < 8").withColumn("interface", F.lit("j"))
    assert linking.sibling_links(p.union(again)).count() == 30000


def test_texts_are_looked_for_once(spark):
    """Many methods of one class name and many that ask for a part of it meet in one row."""
    asked = spark.range(50).selectExpr("id ask_id", "'hop.Red' class_name", "'f' method_name")
    methods = spark.range(200).selectExpr("id + 7 node", "'com.shop.RedWidget' class_name", "'f' method_name")
    seen = []
    whole = impact._holding

    def holding(*a):
        seen.append(whole(*a).count())
        return whole(*a)

    impact._holding = holding
    try:
        got = impact.resolved_entries(asked, methods).collect()
    finally:
        impact._holding = whole
    assert seen == [1] and len(got) == 50 and {(r["node"], r["step"]) for r in got} == {(7, 3)}


@pytest.mark.parametrize("name", ["reach", "reach_once"])
def test_edges_are_read_once(spark, name):
    read = spark.sparkContext.accumulator(0)

    def seen(r):
        read.add(1)
        return r

    edges = spark.createDataFrame(spark.sparkContext.parallelize([(k, k + 1) for k in range(6)]).map(seen), "src long, dst long")
    got = getattr(graph, name)(edges, spark.range(1).withColumnRenamed("id", "seed"))
    assert got.count() == 7 and read.value == 6


def test_entries_are_walked_once_for_all_seeds(spark, monkeypatch):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "src long, dst long")
    node = lambda *n: spark.createDataFrame([(x,) for x in n], "node long")
    monkeypatch.setattr(graph, "reach", None)  # a row a seed and node
    assert [r[0] for r in impact.entries_reaching(edges, node(1, 9), node(3, 4).withColumnRenamed("node", "seed")).collect()] == [1]
    got = impact.ring_violations(edges, node(1), node(1, 4), node(8, 9), node(8))
    assert sorted(map(tuple, got.collect())) == [("ENTRY_NOT_REACHABLE", 4), ("IMPLEMENTATION_NOT_MODIFIED", 9)]


def test_neighbours_are_cut_before_the_shuffle(spark):
    edges = spark.createDataFrame([(s, 0) for s in (5, 3, 3, 3, 9, 7, 3)], "src long, dst long")
    got = retrieval.enriched(spark.range(1), edges, 2)
    assert tuple(got.select("callers").first()) == ("3,5",)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Aggregate \[src#\d+L, dst#\d+L\]", plan)  # no distinct of all edges
