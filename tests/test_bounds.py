"""Searches whose targets are near end near them, however large the graph is."""

import pytest
from pyspark.sql import functions as F

from tests.test_graph import graph, rows
from waygraph.operators import index, paths, timedep
from waygraph.tables import Graph


@pytest.fixture
def rounds(monkeypatch):
    """Counts the tables of labels that loops write, the first before any round."""
    seen, write = [], paths.materialise
    monkeypatch.setattr(paths, "materialise", lambda df, name="step": (name == "labels" and seen.append(name)) or write(df, name))
    return seen


def chain(spark, n=90):
    return graph(spark, [(k, k + 1, 1) for k in range(n)])


def near(spark):
    return spark.createDataFrame([(0, 1, 3), (1, 4, 2), (2, 5, 5)], "qid int, src long, dst long")


def test_fewest_hops_end_at_their_targets(spark, rounds):
    assert rows(paths.fewest_hops(chain(spark), near(spark)), "qid", "cost") == [(0, 2.0), (1, 2.0), (2, 0.0)]
    assert len(rounds) <= 4


def test_climbs_end_at_their_meeting(spark, rounds):
    """Without any contracted node the core is the whole chain."""
    found = index.Contraction.build(chain(spark), max_rounds=0).pair_costs(near(spark))
    assert rows(found, "qid", "cost") == [(0, 2.0), (1, 2.0), (2, 0.0)]
    assert len(rounds) <= 5


def test_climbing_paths_end_at_their_meeting(spark, rounds):
    found = index.Contraction.build(chain(spark), max_rounds=0).pair_paths(near(spark))
    assert rows(found, "qid", "k", "id") == [(0, 0, 1), (0, 1, 2), (0, 2, 3), (1, 0, 4), (1, 1, 3), (1, 2, 2), (2, 0, 5)]
    assert len(rounds) <= 5


def test_timed_search_ends_at_its_target(spark, rounds):
    g = graph(spark, [(k, k + 1, 10) for k in range(90)])
    g = Graph(g.nodes, g.edges.withColumn("tier", F.lit(1)))
    found = timedep.scan_departures(g, 3, 5, samples=2)
    assert found.where("duration IS NOT NULL").count() == 2
    assert len(rounds) <= 6


def test_two_sided_searches_deal_their_edges_once(spark, monkeypatch):
    import re

    plans, write = [], paths.materialise
    monkeypatch.setattr(paths, "materialise", lambda df, name="step": plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, name))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        g = graph(spark, [(0, 1, 2), (1, 2, 2), (2, 3, 2)])
        pairs = spark.createDataFrame([(0, 0, 3)], "qid int, src long, dst long")
        assert [tuple(r) for r in paths.bidirectional_costs(g, pairs).collect()] == [(0, 6.0)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(plans) > 2  # the first round plans before the edges lie dealt
    assert not [p for p in plans[2:] if re.search(r"hashpartitioning\(src#\d+L, edge_side#\d+, \d+\), ENSURE_REQUIREMENTS", p)]


def test_bellman_ford_settles_on_a_path_through_all_nodes(spark):
    """Its last round may only confirm, whatever hops a round looks ahead; with a negative cycle it still doesn't settle."""
    source = spark.createDataFrame([(0, 0)], "qid int, id long")
    edges = spark.createDataFrame([(k, k + 1, -1.0) for k in range(6)], "src long, dst long, w double")
    found, settled = paths.bellman_ford(Graph(spark.range(7), edges), source)
    assert settled and rows(found, "id", "cost") == [(k, -float(k)) for k in range(7)]
    around = edges.unionAll(spark.createDataFrame([(6, 0, 5.0)], edges.schema))
    assert not paths.bellman_ford(Graph(spark.range(7), around), source)[1]
