"""Greedy search in batches against one search at a time."""

import heapq
import math
import random

import pytest

from waygraph.operators.greedy import greedy, greedy_paths
from waygraph.operators.harness import REGISTRY, race
from waygraph.tables import Graph


def alone(places, arcs, a, b):
    """The path of one greedy search with a heap, and its cost; None without one."""
    if a not in places or b not in places:
        return None
    best = {}
    for u, v, w in arcs:
        best.setdefault(u, {})
        best[u][v] = min(w, best[u].get(v, math.inf))
    line = lambda n: math.dist(places[n], places[b]) if None not in places[n] + places[b] else math.inf
    waits, parent = [(line(a), a)], {a: None}
    while waits:
        _, u = heapq.heappop(waits)
        if u == b:
            path = [b]
            while parent[path[-1]] is not None:
                path.append(parent[path[-1]])
            path.reverse()
            return path, sum(best[x][y] for x, y in zip(path, path[1:]))
        for v in best.get(u, {}):
            if v not in parent:
                parent[v] = u
                heapq.heappush(waits, (line(v), v))
    return None


@pytest.mark.parametrize("prune", [False, True])
def test_random_graphs_against_one_search_at_a_time(spark, prune):
    rng = random.Random(7)
    places = {n: (float(rng.randrange(40)), float(rng.randrange(40))) for n in range(16)}
    places[15] = (None, None)
    arcs = [(rng.randrange(16), rng.randrange(16), float(rng.randrange(1, 9))) for _ in range(34)]
    g = Graph(
        spark.createDataFrame([(n, *p) for n, p in places.items()], "id long, x double, y double"),
        spark.createDataFrame(arcs, "src long, dst long, w double"),
        "planar",
    )
    asked = [(q, rng.randrange(16), rng.randrange(16)) for q in range(10)] + [(90, 3, 3), (91, 3, 777), (92, 15, 4), (93, 4, 15)]
    pairs = spark.createDataFrame(asked, "qid int, src long, dst long")
    wanted = {q: alone(places, arcs, a, b) for q, a, b in asked}
    if prune:
        walks = {}
        for r in greedy_paths(g, pairs, prune).collect():
            walks.setdefault(r["qid"], []).append((r["k"], r["id"]))
        assert {q: [n for _, n in sorted(w)] for q, w in walks.items()} == {q: w[0] for q, w in wanted.items() if w}
    else:
        got = {r["qid"]: (r["cost"], r["hops"]) for r in greedy(g, pairs, prune).collect()}
        assert got == {q: (w[1], len(w[0]) - 1) if w else (None, None) for q, w in wanted.items()}


def test_no_pairs_and_no_places(spark):
    nodes = spark.createDataFrame([(0, 0.0, 0.0)], "id long, x double, y double")
    edges = spark.createDataFrame([], "src long, dst long, w double")
    none = spark.createDataFrame([], "qid int, src long, dst long")
    assert greedy(Graph(nodes, edges, "planar"), none).collect() == []
    with pytest.raises(ValueError):
        greedy(Graph(nodes, edges), none)
    one = spark.createDataFrame([(1, 0, 0)], "qid int, src long, dst long")
    assert REGISTRY["greedy"].needs_places and not REGISTRY["greedy"].optimal
    assert {r["verdict"] for r in race(Graph(nodes, edges), one, ["greedy"]).collect()} == {"declined"}
