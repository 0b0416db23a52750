"""Bridges and articulation points by Euler tours, against searches on small graphs and on a long chain."""

import random

from pyspark.sql import functions as F

from waygraph.functions.order import next_in_order
from waygraph.operators import analysis, tour
from waygraph.tables import Graph


def graph(spark, n, pairs):
    nodes = spark.createDataFrame([(i, 0.0, 0.0) for i in range(n)], "id long, x double, y double")
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src long, dst long, w double")
    return Graph(nodes, edges)


def reach(n, pairs, start, without=None, edge=None):
    near = {i: set() for i in range(n)}
    for a, b in pairs:
        if a != b and {a, b} != edge and without not in (a, b):
            near[a].add(b), near[b].add(a)
    seen, todo = {start}, [start]
    while todo:
        for y in near[todo.pop()] - seen:
            seen.add(y), todo.append(y)
    return seen


def test_random_graphs_against_searches(spark, monkeypatch):
    monkeypatch.setattr(tour, "BLOCK", 4)
    rng = random.Random(4)
    n = 60
    pairs = [(rng.randrange(i), i) for i in range(1, 40)] + [(rng.randrange(40), rng.randrange(40)) for _ in range(9)]
    pairs += [(i, i + 1) for i in range(41, 55)] + [(44, 50), (50, 44), (56, 56)]
    g = graph(spark, n, pairs)
    want = set()
    for a, b in {(min(p), max(p)) for p in pairs if p[0] != p[1]}:
        if b not in reach(n, pairs, a, edge={a, b}):
            root = min(reach(n, pairs, a))
            side_a = reach(n, pairs, a, edge={a, b})
            want.add((a, b, len(reach(n, pairs, b, edge={a, b}))) if root in side_a else (b, a, len(side_a)))
    assert {tuple(r) for r in analysis.bridges(g).collect()} == want
    cuts = set()
    for x in range(n):
        near = reach(n, pairs, x) - {x}
        if near and any(reach(n, pairs, y, without=x) != near for y in list(near)[:1]):
            cuts.add(x)
    assert {r["id"] for r in analysis.articulation_points(g).collect()} == cuts


def test_small_blocks_give_the_same_extremes(spark):
    rng = random.Random(2)
    parent = [None] + [rng.randrange(max(0, i - 3), i) for i in range(1, 80)]
    children = {i: [c for c in range(80) if parent[c] == i] for i in range(80)}
    pre, size = {}, {}

    def number(i):
        pre[i] = len(pre)
        for c in children[i]:
            number(c)
        size[i] = len(pre) - pre[i]

    number(0)
    lo, hi = {i: rng.randrange(100) for i in range(80)}, {i: rng.randrange(100) for i in range(80)}
    at = {pre[i]: i for i in range(80)}
    want = {i: (min(lo[at[p]] for p in range(pre[i], pre[i] + size[i])), max(hi[at[p]] for p in range(pre[i], pre[i] + size[i]))) for i in range(80)}
    rows = spark.createDataFrame([(i, pre[i], size[i], lo[i], hi[i]) for i in range(80)], "id long, pre long, size long, lo long, hi long")
    for block in (3, 16, 1000):
        assert {r["id"]: (r["low"], r["high"]) for r in tour.subtree_extremes(rows, block).collect()} == want


def test_a_chain_of_ten_thousand_takes_log_rounds(spark, monkeypatch):
    n, jobs = 10_000, []
    keep = tour.materialise
    monkeypatch.setattr(tour, "materialise", lambda df, name="": (jobs.append(name), keep(df, name))[1])
    nodes = spark.range(n).select("id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    # ids along the chain are mixed, so that the root is in its middle
    mixed = lambda c: (c * 7919 + 4000) % n
    edges = spark.range(n - 1).select(mixed(F.col("id")).alias("src"), mixed(F.col("id") + 1).alias("dst"), F.lit(1.0).alias("w"))
    found = analysis.bridges(Graph(nodes, edges))
    assert found.count() == n - 1 and found.agg(F.sum("isolated")).first()[0] > n
    assert jobs.count("ranks") < 20


def test_next_in_order_of_a_large_group(spark):
    rows = spark.range(500).select((F.col("id") % 7 == 0).cast("int").alias("g"), (F.col("id") * 3).alias("v")).repartition(5)
    got = {(r["g"], r["v"]): r["after"] for r in next_in_order(rows, ["g"], "v").collect()}
    for g in (0, 1):
        mine = sorted(v for h, v in got if h == g)
        assert [got[g, v] for v in mine] == [*mine[1:], None]
    assert not next_in_order(rows.where("v < 0"), ["g"], "v").collect()


def test_no_edges(spark):
    assert not analysis.bridges(graph(spark, 3, [])).collect()
    assert not analysis.articulation_points(graph(spark, 3, [(1, 1)])).collect()
