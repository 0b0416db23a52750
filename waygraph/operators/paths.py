"""Shortest paths as level-synchronous DataFrame loops over batches of queries.

State is one table (qid, id, d) written to the shared folder after each round;
a round joins the nodes that improved with the edges, which stay dealt by their
source, and keeps the minima, which combine before the shuffle. Many queries share the rounds: their rows differ in
qid only. Rounds number as many as the longest shortest path has hops.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waygraph.functions.geo import straight_line
from waygraph.loop import materialise, release
from waygraph.operators.blocks import block_costs
from waygraph.tables import Graph

#: Hops that a round takes at once while not more than SMALL labels are to be expected: short fronts cost jobs, not work.
AHEAD, SMALL = 3, 20_000
#: Sources that a block's task takes at once.
FEW = 32


def _loop(
    edges: DataFrame,
    start: DataFrame,
    step: Column,
    max_rounds: int,
    bound: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
    keys: tuple[str, ...] = ("qid", "id"),
) -> tuple[DataFrame, bool]:
    """Label-correcting loop. step: the new label from `d` and the edge's columns. Returns the labels, and whether they settled.

    Labels are of any type that has an order, structs too.
    """
    edges = edges.repartition("src").persist()  # dealt once; what a lost executor held is made again
    others = [k for k in keys if k != "id"]

    def relaxed(front: DataFrame) -> DataFrame:
        reached = front.join(edges, F.col("id") == F.col("src")).select(*others, F.col("dst").alias("id"), step.alias("d"))
        return reached.groupBy(*keys).agg(F.min("d").alias("d"))

    state = materialise(start.select(*keys, "d").groupBy(*keys).agg(F.min("d").alias("d")).withColumn("new", F.lit(True)), "labels")
    waiting, growth, done = 1, SMALL + 1, 0
    while done < max_rounds:
        front = state.where("new").drop("new")
        if bound is not None:
            front = bound(front, state)
        found = [relaxed(front)]
        while len(found) < AHEAD and waiting * growth ** len(found) <= SMALL and done + len(found) < max_rounds:
            found.append(relaxed(found[-1]))
        merged = state.select(*keys, "d", F.col("d").alias("old"))
        for reached in found:
            merged = merged.unionByName(reached.withColumn("old", F.lit(None).cast(state.schema["d"].dataType)))
        merged = (
            merged.groupBy(*keys)
            .agg(F.min("d").alias("d"), F.min("old").alias("old"))
            .select(*keys, "d", (F.col("old").isNull() | (F.col("d") < F.col("old"))).alias("new"))
        )
        after = materialise(merged, "labels")
        release(state)
        state, done = after, done + len(found)
        before, waiting = waiting, state.where("new").count()
        growth = max(1.0, waiting / before)  # where nodes have many arcs a hop ahead may be most of the graph
        if not waiting:
            break
    edges.unpersist()
    return state.drop("new"), not waiting


def hops(graph: Graph, sources: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """Breadth-first hop counts from sources(qid, id): (qid, id, hops)."""
    labels, _ = _loop(graph.edges.select("src", "dst"), sources.withColumn("d", F.lit(0.0)), F.col("d") + 1.0, max_rounds)
    return labels.select("qid", "id", F.col("d").cast("int").alias("hops"))


def fewest_hops(graph: Graph, pairs: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(qid, cost) of pairs(qid, src, dst): the cheapest of the paths with the fewest arcs; null without a path.

    A label is the arcs and then their cost; a search ends at its target's
    level, as nodes that are as far away lie on none of its paths.
    """
    goal = pairs.select("qid", F.col("dst").alias("goal"))

    def bound(front: DataFrame, state: DataFrame) -> DataFrame:
        best = goal.join(state.select("qid", F.col("id").alias("goal"), F.col("d.hops").alias("best")), ["qid", "goal"], "left")
        return front.join(best, "qid").where(F.col("best").isNull() | (F.col("d.hops") < F.col("best"))).select("qid", "id", "d")

    start = pairs.select("qid", F.col("src").alias("id"), F.struct(F.lit(0).alias("hops"), F.lit(0.0).alias("cost")).alias("d"))
    step = F.struct((F.col("d.hops") + 1).alias("hops"), (F.col("d.cost") + F.col("w")).alias("cost"))
    labels, _ = _loop(cheapest(graph), start, step, max_rounds, bound)
    found = labels.select("qid", F.col("id").alias("dst"), F.col("d.cost").alias("cost"))
    return pairs.select("qid", "dst").join(found, ["qid", "dst"], "left").select("qid", "cost")


def costs(graph: Graph, sources: DataFrame, max_cost: float | None = None, max_rounds: int = 10_000) -> DataFrame:
    """Least costs over non-negative weights from sources(qid, id): (qid, id, cost). Labels above max_cost are dropped.

    From few sources of a network with places they are settled block by block, as its paths have many arcs.
    """
    edges = cheapest(graph)
    if graph.space is not None and sources.limit(FEW + 1).count() <= FEW:
        return block_costs(graph.nodes, edges, sources, max_cost)
    keep = None if max_cost is None else (lambda front, state: front.where(F.col("d") <= max_cost))
    labels, _ = _loop(edges, sources.withColumn("d", F.lit(0.0)), F.col("d") + F.col("w"), max_rounds, keep)
    out = labels.select("qid", "id", F.col("d").alias("cost"))
    return out if max_cost is None else out.where(F.col("cost") <= max_cost)


def cheapest(graph: Graph) -> DataFrame:
    """One edge for each (src, dst): the cheapest of parallels."""
    return graph.edges.groupBy("src", "dst").agg(F.min("w").alias("w"))


def pair_costs(graph: Graph, pairs: DataFrame, goal_directed: bool = False, max_rounds: int = 10_000) -> DataFrame:
    """Least cost for each pair(qid, src, dst): (qid, cost), cost null without a path.

    A label goes on only while it is below the best known cost at its target;
    with goal_directed, the straight line that is still to go is added (the
    caller has checked that the graph is admissible). Labels then carry their
    node's place, so that no round looks for places among all nodes.
    """
    edges, goal = cheapest(graph), pairs.select("qid", F.col("dst").alias("goal"))
    start = pairs.select("qid", F.col("src").alias("id"), F.lit(0.0).alias("d"))
    cost, step, rest = F.col("d"), F.col("d") + F.col("w"), F.lit(0.0)
    if goal_directed:
        # by sorting both: a graph is never broadcast whole, however small its files are
        place = lambda end, x, y: graph.nodes.select(F.col("id").alias(end), F.col("x").alias(x), F.col("y").alias(y)).hint("merge")
        goal = materialise(goal.join(place("goal", "gx", "gy"), "goal", "left"), "goals")
        edges = graph.edges.where("w IS NOT NULL").join(place("dst", "x", "y"), "dst", "left").select("src", "dst", "w", "x", "y")
        start = start.join(place("id", "x", "y"), "id", "left").select("qid", "id", F.struct(F.col("d").alias("cost"), "x", "y").alias("d"))
        cost, step = F.col("d.cost"), F.struct((F.col("d.cost") + F.col("w")).alias("cost"), "x", "y")
        rest = F.coalesce(straight_line(graph.space, F.col("d.x"), F.col("d.y"), F.col("gx"), F.col("gy")), F.lit(0.0)) * (1 - 1e-9)

    def bound(front: DataFrame, state: DataFrame) -> DataFrame:
        best = goal.join(state.select("qid", F.col("id").alias("goal"), cost.alias("best")), ["qid", "goal"], "left")
        return front.join(best, "qid").where(F.col("best").isNull() | (cost + rest < F.col("best"))).select("qid", "id", "d")

    labels, _ = _loop(edges, start, step, max_rounds, bound)
    found = goal.select("qid", F.col("goal").alias("id")).join(labels, ["qid", "id"])
    return pairs.select("qid").join(found.select("qid", cost.alias("cost")), "qid", "left")


def both_sides(
    ahead: DataFrame, back: DataFrame, pairs: DataFrame, start: Column, step: Column, cost: Column, max_rounds: int = 100_000
) -> tuple[DataFrame, DataFrame]:
    """Labels (qid, id, d) from both ends of pairs(qid, src, dst), over ahead(src, dst, w) and over back, turned round.

    Both sides share the rounds; a label that costs more than the best meeting
    so far goes no further. cost: a label's own, from `d`; step is as in `_loop`,
    but `src` and `dst` are structs (side, id).
    """
    at = lambda side, c: F.struct(F.lit(side).alias("side"), F.col(c).alias("id"))
    turn = lambda df, side: df.select(at(side, "src").alias("src"), at(side, "dst").alias("dst"), "w")
    ends = pairs.select("qid", F.explode(F.array(at(0, "src"), at(1, "dst"))).alias("id")).withColumn("d", start)

    def of(state: DataFrame, side: int, name: str) -> DataFrame:
        return state.where(F.col("id.side") == side).select("qid", F.col("id.id").alias("node"), cost.alias(name))

    def bound(front: DataFrame, state: DataFrame) -> DataFrame:
        met = of(state, 0, "ca").join(of(state, 1, "cb"), ["qid", "node"]).groupBy("qid").agg(F.min(F.col("ca") + F.col("cb")).alias("best"))
        return front.join(met, "qid", "left").where(F.col("best").isNull() | (cost <= F.col("best"))).select("qid", "id", "d")

    labels, _ = _loop(turn(ahead, 0).unionByName(turn(back, 1)), ends, step, max_rounds, bound)
    side = lambda k: labels.where(F.col("id.side") == k).select("qid", F.col("id.id").alias("id"), "d")
    return side(0), side(1)


def bidirectional_costs(graph: Graph, pairs: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(qid, cost) by two label sets that grow towards one another; a side stops where it can't beat the best meeting."""
    ahead = cheapest(graph).withColumn("side", F.lit(0))
    back = cheapest(graph.reverse()).withColumn("side", F.lit(1))
    edges = ahead.unionByName(back).withColumnRenamed("side", "edge_side").repartition("src", "edge_side").persist()
    start = pairs.select("qid", F.lit(0).alias("side"), F.col("src").alias("id"), F.lit(0.0).alias("d")).unionAll(
        pairs.select("qid", F.lit(1).alias("side"), F.col("dst").alias("id"), F.lit(0.0).alias("d"))
    )

    def meetings(state: DataFrame) -> DataFrame:
        a = state.where("side = 0").select("qid", "id", F.col("d").alias("da"))
        b = state.where("side = 1").select("qid", "id", F.col("d").alias("db"))
        return a.join(b, ["qid", "id"]).groupBy("qid").agg(F.min(F.col("da") + F.col("db")).alias("best"))

    state = materialise(start.withColumn("new", F.lit(True)), "labels")
    for _ in range(max_rounds):
        # a path's middle node has at most half of its cost on one side, so labels above half the best meeting are done
        front = state.where("new").join(meetings(state), "qid", "left").where(F.col("best").isNull() | (2 * F.col("d") <= F.col("best")))
        reached = front.join(edges, (F.col("id") == F.col("src")) & (F.col("side") == F.col("edge_side")))
        merged = (
            state.select("qid", "side", "id", "d", F.col("d").alias("old"))
            .unionByName(reached.select("qid", "side", F.col("dst").alias("id"), (F.col("d") + F.col("w")).alias("d"), F.lit(None).cast("double").alias("old")))
            .groupBy("qid", "side", "id")
            .agg(F.min("d").alias("d"), F.min("old").alias("old"))
            .select("qid", "side", "id", "d", (F.col("old").isNull() | (F.col("d") < F.col("old"))).alias("new"))
        )
        after = materialise(merged, "labels")
        release(state)
        state = after
        if state.where("new").isEmpty():
            break
    edges.unpersist()
    return pairs.select("qid").join(meetings(state).withColumnRenamed("best", "cost"), "qid", "left")


def bellman_ford(graph: Graph, sources: DataFrame) -> tuple[DataFrame, bool]:
    """(qid, id, cost) with negative weights allowed, and False if a reachable negative cycle keeps the labels from settling."""
    many = graph.nodes.count() + AHEAD  # a round marks as new what any of its hops found, so the last of them may only confirm
    labels, settled = _loop(cheapest(graph), sources.withColumn("d", F.lit(0.0)), F.col("d") + F.col("w"), many)
    return labels.select("qid", "id", F.col("d").alias("cost")), settled


def dial_declines(graph: Graph, most_buckets: int = 4_000_000) -> DataFrame:
    """Whether bucketed search takes the graph: one row (declined, reason)."""
    w = F.col("w")
    checks = graph.edges.agg(
        F.coalesce(F.max(F.abs(w - F.round(w)) > 1e-9), F.lit(False)).alias("fraction"),
        F.coalesce(F.min(w) < 0, F.lit(False)).alias("negative"),
        F.coalesce(2 * F.max(w) + 2 > most_buckets, F.lit(False)).alias("large"),
    )
    reason = (
        F.when(F.col("negative"), "negative weight").when(F.col("fraction"), "weights are not integers")
        .when(F.col("large"), "too many buckets").otherwise("")
    )
    return checks.select((reason != "").alias("declined"), reason.alias("reason"))


def dial(graph: Graph, sources: DataFrame, width: float | None = None, max_rounds: int = 100_000) -> DataFrame | None:
    """Bucketed least costs (delta-stepping): nodes go on bucket by bucket, so that few labels are ever corrected.

    Returns (qid, id, cost), or None if `dial_declines` says so.
    """
    if dial_declines(graph).first()["declined"]:
        return None
    edges = cheapest(graph).repartition("src").persist()
    width = width or max(1.0, edges.agg(F.max("w")).first()[0] or 1.0)
    state = materialise(sources.select("qid", "id", F.lit(0.0).alias("d"), F.lit(True).alias("new")), "labels")
    for _ in range(max_rounds):
        lowest = state.where("new").groupBy("qid").agg(F.floor(F.min("d") / width).alias("bucket"))
        front = state.where("new").join(lowest, "qid").where(F.floor(F.col("d") / width) == F.col("bucket"))
        reached = front.join(edges, F.col("id") == F.col("src")).select("qid", F.col("dst").alias("id"), (F.col("d") + F.col("w")).alias("d"))
        marked = state.join(front.select("qid", "id", F.lit(True).alias("went")), ["qid", "id"], "left")
        merged = (
            marked.select("qid", "id", "d", F.col("d").alias("old"), (F.col("new") & F.col("went").isNull()).alias("waits"))
            .unionByName(reached.withColumns({"old": F.lit(None).cast("double"), "waits": F.lit(False)}))
            .groupBy("qid", "id")
            .agg(F.min("d").alias("d"), F.min("old").alias("old"), F.max("waits").alias("waits"))
            .select("qid", "id", "d", (F.col("waits") | F.col("old").isNull() | (F.col("d") < F.col("old"))).alias("new"))
        )
        after = materialise(merged, "labels")
        release(state)
        state = after
        if state.where("new").isEmpty():
            break
    edges.unpersist()
    return state.select("qid", "id", F.col("d").alias("cost"))


def all_pairs(graph: Graph, most_nodes: int = 5000) -> DataFrame | None:
    """Least costs between all pairs by min-plus squaring: (src, dst, cost).

    None (declined) for more nodes than `most_nodes`, as a round joins that
    number cubed, and for a graph with a negative cycle.
    """
    if graph.nodes.count() > most_nodes:
        return None
    d = cheapest(graph).withColumnRenamed("w", "cost").unionAll(graph.nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("cost")))
    d = materialise(d.groupBy("src", "dst").agg(F.min("cost").alias("cost")), "apsp")
    for _ in range(64):
        through = d.alias("a").join(d.alias("b"), F.col("a.dst") == F.col("b.src")).select("a.src", "b.dst", (F.col("a.cost") + F.col("b.cost")).alias("cost"))
        after = materialise(through.groupBy("src", "dst").agg(F.min("cost").alias("cost")), "apsp")
        if not after.where("src = dst AND cost < 0").isEmpty():
            return None
        changed = after.join(d.withColumnRenamed("cost", "old"), ["src", "dst"], "left").where("old IS NULL OR cost < old - 1e-9")
        settled = changed.isEmpty()
        release(d)
        d = after
        if settled:
            return d
    return d


def johnson(graph: Graph, sources: DataFrame) -> DataFrame | None:
    """(qid, id, cost) with negative weights: potentials first, then searches over weights that are not negative.

    None (declined) if there is a negative cycle anywhere.
    """
    everywhere = graph.nodes.select(F.lit(0).alias("qid"), "id")
    h, settled = bellman_ford(graph, everywhere)
    if not settled:
        return None
    h = materialise(h.select("id", F.col("cost").alias("h")), "potentials")
    moved = (
        graph.edges.join(h.select(F.col("id").alias("src"), F.col("h").alias("hs")), "src")
        .join(h.select(F.col("id").alias("dst"), F.col("h").alias("hd")), "dst")
        .select("src", "dst", F.greatest(F.lit(0.0), F.col("w") + F.col("hs") - F.col("hd")).alias("w"))
    )
    found = costs(Graph(graph.nodes, moved), sources.select("qid", "id"))
    from_h = sources.select("qid", "id").join(h, "id").select("qid", F.col("h").alias("h0"))
    return found.join(h, "id").join(from_h, "qid").select("qid", "id", (F.col("cost") - F.col("h0") + F.col("h")).alias("cost"))


def path_costs(graph: Graph, paths: DataFrame) -> DataFrame:
    """Cost of each path(qid, path): the cheapest parallel arc a hop; null for an empty path or one with a hop that is no edge."""
    step = paths.select("qid", F.size("path").alias("n"), F.posexplode("path").alias("k", "src"), "path")
    legs = step.where("k < n - 1").select("qid", "src", F.expr("path[k + 1]").alias("dst"))
    # by sorting both: a graph is never broadcast whole, however small its files are
    priced = legs.join(cheapest(graph).hint("merge"), ["src", "dst"], "left").groupBy("qid").agg(F.sum("w").alias("cost"), F.count("w").alias("real"))
    joined = paths.select("qid", F.size("path").alias("n")).join(priced, "qid", "left")
    cost = F.when(F.col("n") == 1, F.lit(0.0)).when(F.col("real") == F.col("n") - 1, F.col("cost"))
    return joined.select("qid", cost.alias("cost"))


def least_paths(graph: Graph, pairs: DataFrame) -> DataFrame:
    """(qid, cost, path): of the cheapest paths for each pair the lexicographically least, over positive weights."""
    edges = materialise(cheapest(graph), "cheapest")
    back = costs(graph.reverse(), pairs.select("qid", F.col("dst").alias("id"))).withColumnRenamed("cost", "rest")
    back = materialise(back, "rest")
    at = pairs.join(back.select("qid", F.col("id").alias("src"), F.col("rest").alias("total")), ["qid", "src"])
    grown = materialise(at.select("qid", F.col("src").alias("id"), "dst", "total", F.array("src").alias("path")), "paths")
    done = grown.where("id = dst")
    while True:
        front = grown.where("id <> dst")
        if front.isEmpty():
            return done.select("qid", F.col("total").alias("cost"), "path")
        here = front.join(back, ["qid", "id"]).withColumnRenamed("dst", "goal")
        after = here.join(edges, F.col("id") == F.col("src")).join(back.select("qid", F.col("id").alias("dst"), F.col("rest").alias("after")), ["qid", "dst"])
        tight = after.where(F.abs(F.col("w") + F.col("after") - F.col("rest")) <= 1e-9 * F.greatest(F.lit(1.0), F.col("rest")))
        best = tight.groupBy("qid", "goal", "total", "path").agg(F.min("dst").alias("id"))
        grown = materialise(best.select("qid", "id", F.col("goal").alias("dst"), "total", F.concat("path", F.array("id")).alias("path")), "paths")
        done = done.unionByName(grown.where("id = dst"))


def k_shortest(graph: Graph, pairs: DataFrame, k: int = 3) -> DataFrame:
    """Yen's k cheapest loopless paths: (qid, rank, cost, path), by cost and then path.

    Each round branches off the last accepted path of every query at all of its
    nodes at once: the spur searches are one batch whose rows carry their bans.
    """
    first = least_paths(graph, pairs)
    accepted = materialise(first.select("qid", F.lit(1).alias("rank"), "cost", "path"), "accepted")
    pool = None
    edges = materialise(cheapest(graph), "cheapest")
    goal = pairs.select("qid", F.col("dst").alias("goal"))
    for rank in range(2, k + 1):
        last = accepted.where(F.col("rank") == rank - 1).select("qid", "path")
        spurs = last.select("qid", "path", F.explode(F.sequence(F.lit(1), F.greatest(F.size("path") - 1, F.lit(1)))).alias("n")).where("n < size(path)")
        spurs = spurs.select("qid", "n", F.slice("path", F.lit(1), F.col("n")).alias("root")).withColumn("sid", F.concat_ws(":", "qid", "n"))
        banned = (
            accepted.select("qid", F.col("path").alias("old")).join(spurs, "qid")
            .where(F.slice("old", F.lit(1), F.col("n")) == F.col("root"))
            .select("sid", F.expr("old[n - 1]").alias("src"), F.expr("old[n]").alias("dst")).where("dst IS NOT NULL").distinct()
        )
        spurs = materialise(spurs.join(goal, "qid"), "spurs")
        banned = materialise(banned, "banned")
        # paths grow with their nodes; a label is dropped where a cheaper one of the same spur stands at the node
        front = materialise(spurs.select("sid", "root", F.element_at("root", -1).alias("id"), "goal", F.lit(0.0).alias("d"), F.expr("array(root[n - 1])").alias("tail")), "front")
        best = front
        while not front.isEmpty():
            grown = (
                front.where("id <> goal").join(edges, F.col("id") == F.col("src"))
                .join(banned, ["sid", "src", "dst"], "left_anti")
                .where(~F.array_contains("root", F.col("dst")) & ~F.array_contains("tail", F.col("dst")))
                .select("sid", "root", F.col("dst").alias("id"), "goal", (F.col("d") + F.col("w")).alias("d"), F.concat("tail", F.array("dst")).alias("tail"))
            )
            both = best.withColumn("new", F.lit(False)).unionByName(grown.withColumn("new", F.lit(True)))
            least = both.groupBy("sid", "id").agg(F.min(F.struct("d", "tail", "new", "root", "goal")).alias("m"))
            best = materialise(least.select("sid", "m.root", "id", "m.goal", "m.d", "m.tail", "m.new"), "front")
            front = best.where("new").drop("new")
            best = best.drop("new")
        reached = best.where("id = goal").join(spurs.select("sid", "qid", "n"), "sid")
        whole = reached.select("qid", F.concat(F.expr("slice(root, 1, n - 1)"), "tail").alias("path"))
        more = path_costs(graph, whole.select(F.struct("qid", "path").alias("qid"), "path")).select("qid.qid", "cost", "qid.path")
        pool = more if pool is None else pool.unionByName(more)
        pool = materialise(pool.dropDuplicates(["qid", "path"]).join(accepted.select("qid", "path"), ["qid", "path"], "left_anti"), "pool")
        chosen = pool.groupBy("qid").agg(F.min(F.struct("cost", "path")).alias("m")).select("qid", F.lit(rank).alias("rank"), "m.cost", "m.path")
        accepted = materialise(accepted.unionByName(chosen), "accepted")
    return accepted
