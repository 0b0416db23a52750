"""Greedy best-first search for many pairs at once: one head a query and round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waygraph.functions.geo import straight_line
from waygraph.loop import materialise, release
from waygraph.operators.paths import cheapest, hops
from waygraph.operators.trees import trace_back
from waygraph.tables import Graph

#: Rounds that are written as one table: a round is short, so jobs cost more than its work.
AHEAD = 2


def _co_reachable(graph: Graph, pairs: DataFrame) -> DataFrame:
    """(goal, id): the nodes with a path to each distinct target, found backwards."""
    goals = pairs.select(F.col("dst").alias("qid"), F.col("dst").alias("id")).distinct()
    return hops(graph.reverse(), goals).select(F.col("qid").alias("goal"), "id")


def greedy_tree(graph: Graph, pairs: DataFrame, prune: bool = False, max_rounds: int = 1_000_000) -> DataFrame:
    """What the search of each pair(qid, src, dst) discovers: (qid, id, goal, cost, hops, parent, far).

    Each round takes from every open query the waiting node with the shortest
    straight line to its target (ties: the smallest id; nodes without a place
    last) and lets its unseen neighbours wait; a node keeps the parent that saw
    it first. A query ends once its target is seen (it would be taken next, and
    keeps its parent), or nothing waits. Pairs with an end that is no node have no rows.

    Rounds are as many as the longest search takes nodes; a round costs one pass
    over what all open queries have discovered. A pair without a path takes
    everything that its source reaches, so with prune the nodes without a path to
    the target are left out from the start: they lead to nothing but their like,
    paths stay the same, and such pairs cost no rounds. Finding those nodes is a
    search over the whole graph for each distinct target.
    """
    if graph.space is None:
        raise ValueError("greedy search needs places")
    # by sorting both: a graph is never broadcast whole, however small its files are
    place = lambda end, x, y: graph.nodes.select(F.col("id").alias(end), F.col("x").alias(x), F.col("y").alias(y)).hint("merge")
    arcs = cheapest(graph).join(place("dst", "x", "y"), "dst")
    arcs = arcs.select("src", "dst", "w", "x", "y")
    asked = pairs.join(place("src", "x", "y"), "src").join(place("dst", "gx", "gy"), "dst")
    may = None
    if prune:
        may = materialise(_co_reachable(graph, pairs), "may")
        asked = asked.join(may.select(F.col("goal").alias("dst"), F.col("id").alias("src")), ["src", "dst"], "left_semi")
    arcs = arcs.repartition("src").persist()  # dealt once; what a lost executor held is made again
    far = F.coalesce(straight_line(graph.space, F.col("x"), F.col("y"), F.col("gx"), F.col("gy")), F.lit(float("inf")))
    about = ["goal", "gx", "gy", "cost", "hops", "parent", "far"]
    row = lambda cost, hops_, parent: ["qid", "id", F.struct("goal", "gx", "gy", cost.alias("cost"), hops_.alias("hops"), parent.cast("long").alias("parent"), far.alias("far")).alias("about"), F.lit(True).alias("waits")]
    asked = asked.withColumns({"id": F.col("src"), "goal": F.col("dst")})
    state = materialise(asked.select(*row(F.lit(0.0), F.lit(0), F.lit(None))), "greedy")

    def heads(state: DataFrame) -> DataFrame:
        rank = F.struct("about.far", "id", "about")
        best = state.groupBy("qid").agg(F.min(F.when(F.col("waits"), rank)).alias("m"), F.max(F.col("id") == F.col("about.goal")).alias("found"))
        return best.where("m IS NOT NULL AND NOT found").select("qid", F.col("m.id").alias("src"), *[F.col(f"m.about.{c}").alias(c) for c in about])

    def taken(state: DataFrame) -> DataFrame:
        head = heads(state)
        beside = head.drop("far").join(arcs, "src").withColumnRenamed("dst", "id")
        if may is not None:
            beside = beside.join(may, ["goal", "id"], "left_semi")
        seen = beside.select(*row(F.col("cost") + F.col("w"), F.col("hops") + 1, F.col("src"))).withColumn("age", F.lit(1))
        gone = head.select("qid", F.col("src").alias("id"), F.lit(None).cast(state.schema["about"].dataType).alias("about"), F.lit(False).alias("waits"), F.lit(2).alias("age"))
        every = state.withColumn("age", F.lit(0)).unionByName(seen).unionByName(gone)
        return every.groupBy("qid", "id").agg(F.min_by("about", "age").alias("about"), F.min("waits").alias("waits"))

    for _ in range(0, max_rounds, AHEAD):
        # a round in which a query has ended changes nothing of it, so several go into one table
        after = state
        for _ in range(AHEAD):
            after = taken(after)
        after = materialise(after, "greedy")
        release(state)
        state = after
        if heads(state).isEmpty():
            arcs.unpersist()
            return state.select("qid", "id", *[F.col(f"about.{c}").alias(c) for c in ("goal", "cost", "hops", "parent", "far")])
    raise RuntimeError(f"greedy searches did not end within {max_rounds} rounds")


def greedy(graph: Graph, pairs: DataFrame, prune: bool = False) -> DataFrame:
    """(qid, cost, hops) of the path that greedy search takes, which need not be the cheapest; null without one."""
    found = greedy_tree(graph, pairs, prune).where("id = goal").select("qid", "cost", "hops")
    return pairs.select("qid").join(found, "qid", "left")


def greedy_paths(graph: Graph, pairs: DataFrame, prune: bool = False) -> DataFrame:
    """Those paths as rows (qid, k, id)."""
    labels = greedy_tree(graph, pairs, prune)
    ends = labels.where("id = goal").select(F.col("qid").alias("path"), "qid", "id")
    return trace_back(labels, ends).withColumnRenamed("path", "qid")
