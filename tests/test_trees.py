"""Paths as rows: branches of shortest-path trees, unpacked shortcuts, and re-weighted hierarchies, against a heap search."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from waygraph.operators import index, paths, trees
from waygraph.tables import Graph


def random_graph(spark, seed=3, n=40):
    rng = random.Random(seed)
    edges = [(rng.randrange(i), i, float(rng.randint(0, 9))) for i in range(1, 32)] + [(rng.randrange(32), rng.randrange(32), float(rng.randint(1, 20))) for _ in range(60)]
    edges += [(b, a, w) for a, b, w in edges[::2]] + [(36, 37, 1.0)]
    nodes = spark.createDataFrame([(i, 0.0, 0.0) for i in range(n)], "id long, x double, y double")
    return Graph(nodes, spark.createDataFrame(edges, "src long, dst long, w double")), edges


def heap(edges, source):
    near, best, todo = {}, {}, [(0.0, source)]
    for a, b, w in edges:
        near.setdefault(a, []).append((b, w))
    while todo:
        d, x = heapq.heappop(todo)
        if x not in best:
            best[x] = d
            for y, w in near.get(x, []):
                heapq.heappush(todo, (d + w, y))
    return best


PAIRS = [(q, (q * 7) % 36, (q * 11 + 5) % 38) for q in range(14)] + [(90, 3, 3), (91, 36, 37), (92, 37, 36), (93, 39, 0)]


def check(rows, edges):
    """Every path runs from source to target over arcs of the graph, at the least cost; pairs without a path have no rows."""
    arc = {}
    for a, b, w in edges:
        arc[a, b] = min(w, arc.get((a, b), w))
    by = {}
    for r in rows.collect():
        by.setdefault(r["qid"], []).append((r["k"], r["id"]))
    for q, s, t in PAIRS:
        best = heap(edges, s).get(t)
        if best is None:
            assert q not in by
            continue
        steps = sorted(by[q])
        ids = [i for _, i in steps]
        assert [k for k, _ in steps] == list(range(len(steps))) and ids[0] == s and ids[-1] == t
        assert sum(arc[p] for p in zip(ids, ids[1:])) == best


@pytest.mark.parametrize("how", ["tree", "contraction with a core"])
def test_paths_of_pairs(spark, how):
    g, edges = random_graph(spark)
    pairs = spark.createDataFrame(PAIRS, "qid int, src long, dst long")
    if how == "tree":
        rows = trees.pair_paths(g, pairs)
    else:
        rows = index.Contraction.build(g, max_rounds=3, hops=2).pair_paths(pairs)
    check(rows, edges)


def test_a_tree_over_arcs_without_weight_has_no_loops(spark):
    edges = [(0, 1, 0.0), (1, 0, 0.0), (1, 2, 0.0), (2, 1, 0.0), (2, 3, 1.0), (0, 3, 1.0)]
    g = Graph(spark.range(5).select("id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), spark.createDataFrame(edges, "src long, dst long, w double"))
    got = trees.shortest_tree(g, spark.createDataFrame([(0, 0)], "qid int, id long"))
    assert {(r["id"], r["cost"], r["hops"], r["parent"]) for r in got.collect()} == {(0, 0.0, 0, None), (1, 0.0, 1, 0), (2, 0.0, 2, 1), (3, 1.0, 1, 0)}
    near = trees.shortest_tree(g, spark.createDataFrame([(0, 0)], "qid int, id long"), max_cost=0.5)
    assert {r["id"] for r in near.collect()} == {0, 1, 2}


def test_two_thousand_hops_in_log_rounds(spark, monkeypatch):
    n, tables = 2_000, []
    keep = trees.materialise
    monkeypatch.setattr(trees, "materialise", lambda df, name="": (tables.append(name), keep(df, name))[1])
    labels = spark.range(n + 1).select(F.lit(0).alias("qid"), ((F.col("id") * 7) % (n + 1)).alias("id"), F.col("id").cast("int").alias("hops"), F.when(F.col("id") > 0, ((F.col("id") - 1) * 7) % (n + 1)).alias("parent"))
    ends = spark.createDataFrame([(1, 0, (n * 7) % (n + 1)), (2, 0, 7), (3, 0, 0), (4, 0, -5)], "path int, qid int, id long")
    got = {}
    for r in trees.trace_back(labels, ends).collect():
        got.setdefault(r["path"], []).append((r["k"], r["id"]))
    assert sorted(got[1]) == [(k, (k * 7) % (n + 1)) for k in range(n + 1)]
    assert sorted(got[2]) == [(0, 0), (1, 7)] and got[3] == [(0, 0)] and 4 not in got
    assert len(tables) <= 26


def test_witnesses_keep_shortcuts_out(spark):
    """A ring of five arcs around the contracted node: longer searches see it, shorter ones add a shortcut."""
    via = spark.createDataFrame([(0, 5, 10.0), (0, 9, 10.0)], "u long, v long, c double")
    rest = spark.createDataFrame([(i, i + 1, 2.0) for i in range(5)] + [(0, 9, 10.5)], "src long, dst long, w double")
    for hops, want in ((4, set()), (5, {(0, 5)})):
        seen, cached = index._witnesses(via, rest, hops)
        assert {tuple(r) for r in seen.collect()} == want
        for table in cached:
            table.unpersist()


def test_hierarchy_with_other_weights(spark):
    g, edges = random_graph(spark, seed=8)
    hour = [(a, b, w * (1 + (a + b) % 3) + 1) for a, b, w in edges if (a * b) % 7]
    built = index.Hierarchy.build(g)
    weights = spark.createDataFrame(hour, "src long, dst long, w double")
    pairs = spark.createDataFrame(PAIRS, "qid int, src long, dst long")
    at_hour = built.customise(weights)
    want = {q: heap(hour, s).get(t) for q, s, t in PAIRS}
    assert {r["qid"]: r["cost"] for r in at_hour.pair_costs(pairs).collect()} == want
    check(at_hour.pair_paths(pairs), hour)
    assert paths.path_costs(Graph(g.nodes, weights), trees.as_arrays(at_hour.pair_paths(pairs).withColumnRenamed("qid", "path"))).where("cost IS NULL").isEmpty()
