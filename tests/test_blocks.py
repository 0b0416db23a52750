"""Least costs settled block by block."""

import random

from pyspark.sql import functions as F

from tests.test_bounds import rounds  # noqa: F401  (a fixture)
from tests.test_graph import graph, rows, sources
from waygraph.operators import paths
from waygraph.operators.blocks import block_costs
from waygraph.tables import Graph


def test_a_long_placed_chain_takes_no_round_an_arc(spark, rounds):  # noqa: F811
    g = graph(spark, [(k, k + 1, 2) for k in range(90)], places={k: (float(k), 0.0) for k in range(91)}, space="planar")
    assert rows(paths.costs(g, sources(spark, 0)), "id", "cost") == [(k, 2.0 * k) for k in range(91)]
    assert not rounds


def test_blocks_agree_with_the_loop(spark):
    """Some nodes share a place, some have none, one end is no node at all."""
    r = random.Random(5)
    at = {k: (float(k % 9), float(k // 9)) if k % 7 else (3.0, 3.0) for k in range(90)}
    arcs = [(k, k + s, r.randint(0, 9) / 7) for k in range(90) for s in (1, 9) if k + s < 90 and r.random() < 0.9]
    g = graph(spark, arcs, places=at, space="planar")
    nodes = g.nodes.where("id <> 40").withColumn("x", F.when(F.col("id") % 11 != 0, F.col("x")))
    asked = sources(spark, 0, 50, 40)
    for most in (None, 4.0):
        plain = rows(paths.costs(Graph(nodes, g.edges), asked, max_cost=most), "qid", "id", "cost")
        assert rows(block_costs(nodes, paths.cheapest(g), asked, most, size=12), "qid", "id", "cost") == plain


def test_cut_off_costs_of_a_placed_chain_take_no_round_an_arc(spark, rounds):  # noqa: F811
    g = graph(spark, [(k, k + 1, 2) for k in range(90)], places={k: (float(k), 0.0) for k in range(91)}, space="planar")
    assert rows(paths.costs(g, sources(spark, 0), max_cost=100.0), "id", "cost") == [(k, 2.0 * k) for k in range(51)]
    assert not rounds


def test_hull_of_a_cut_off_search_of_a_placed_grid(spark, rounds):  # noqa: F811
    from waygraph.operators import spatial

    at = {9 * i + j: (float(i), float(j)) for i in range(9) for j in range(9)}
    g = graph(spark, [(k, k + 9, 1) for k in range(72)] + [(k, k + 1, 1) for k in range(81) if k % 9 < 8], places=at, space="planar")
    reached = spatial.isochrone(paths.costs(g, sources(spark, 0), max_cost=6.0).drop("qid"), [6.0])
    assert rows(spatial.convex_hull(reached.join(g.nodes, "id").select("cutoff", "id", "x", "y"), "cutoff"), "id") == [(0,), (6,), (54,)]
    assert not rounds


def test_betweenness_searches_no_further_than_blocks(spark, monkeypatch):
    """Triangles in a row: searches between all nodes would be 21 * 21 labels, within triangles 10 * 9."""
    from waygraph.operators import analysis

    arcs = [(2 * k, 2 * k + s, 1) for k in range(10) for s in (1, 2)] + [(2 * k + 1, 2 * k + 2, 1) for k in range(10)]
    seen, write = [], analysis.materialise
    monkeypatch.setattr(analysis, "materialise", lambda df, name="step": seen.append((name, write(df, name))) or seen[-1][1])
    found = dict(rows(analysis.betweenness(graph(spark, arcs)), "id", "score"))
    assert found == {k: 0.0 if k % 2 or k in (0, 20) else 2.0 * k * (20 - k) for k in range(21)}
    assert next(df for name, df in seen if name == "costs").count() == 90
