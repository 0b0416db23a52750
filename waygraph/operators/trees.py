"""Paths as rows: shortest-path trees, and their branches by pointer doubling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waygraph.loop import materialise, release
from waygraph.operators.paths import _loop, both_sides, cheapest
from waygraph.tables import Graph


def _start() -> Column:
    return F.struct(F.lit(0.0).alias("cost"), F.lit(0).alias("hops"), F.lit(None).cast("long").alias("parent"))


def _step(parent: str) -> Column:
    return F.struct((F.col("d.cost") + F.col("w")).alias("cost"), (F.col("d.hops") + 1).alias("hops"), F.col(parent).alias("parent"))


def tree(edges: DataFrame, sources: DataFrame, bound=None, max_rounds: int = 100_000) -> DataFrame:
    """(qid, id, cost, hops, parent) over edges(src, dst, w), not negative, from sources(qid, id); bound as `_loop` takes it.

    A label is a cost, the arcs so far, and the node before; by their order the
    parents lead to the source even over arcs without weight.
    """
    labels, _ = _loop(edges.select("src", "dst", "w"), sources.select("qid", "id", _start().alias("d")), _step("src"), max_rounds, bound)
    return labels.select("qid", "id", "d.cost", "d.hops", "d.parent")


def shortest_tree(graph: Graph, sources: DataFrame, max_cost: float | None = None) -> DataFrame:
    """Least costs from sources(qid, id) with the node before on a cheapest path of fewest arcs (ties: the smallest): (qid, id, cost, hops, parent)."""
    keep = None if max_cost is None else (lambda front, state: front.where(F.col("d.cost") <= max_cost))
    out = tree(cheapest(graph), sources, keep)
    return out if max_cost is None else out.where(F.col("cost") <= max_cost)


def trace_back(labels: DataFrame, targets: DataFrame) -> DataFrame:
    """The tree's paths to targets(path, qid, id): (path, k, id), k counting the arcs from the source.

    labels: (qid, id, hops, parent). A round doubles the length of what is known
    of every path, by a table that jumps twice as far up as in the round before;
    so rounds grow with the log of the longest path. Targets that the tree does
    not reach have no rows.
    """
    jump = labels.where("parent IS NOT NULL").select("qid", "id", F.col("parent").alias("up"))
    found = targets.select("path", "qid", "id").join(labels.select("qid", "id", F.col("hops").alias("k")), ["qid", "id"]).select("path", "qid", "id", "k")
    found, jump, far = materialise(found, "branch"), materialise(jump, "jump"), 1
    longest = found.agg(F.max("k")).first()[0] or 0
    while far <= longest:
        more = found.join(jump, ["qid", "id"]).select("path", "qid", F.col("up").alias("id"), (F.col("k") - far).alias("k"))
        after = materialise(found.unionByName(more), "branch")
        far *= 2
        if far <= longest:
            twice = jump.alias("a").join(jump.alias("b"), (F.col("a.qid") == F.col("b.qid")) & (F.col("a.up") == F.col("b.id"))).select("a.qid", "a.id", "b.up")
            twice = materialise(twice, "jump")
            release(jump)
            jump = twice
        release(found)
        found = after
    return found.select("path", "k", "id")


def as_arrays(rows: DataFrame) -> DataFrame:
    """(qid, path) of (path, k, id); a path must fit into a row."""
    return rows.groupBy(F.col("path").alias("qid")).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "id"))), lambda x: x["id"]).alias("path"))


def pair_paths(graph: Graph, pairs: DataFrame) -> DataFrame:
    """A cheapest path of each pair(qid, src, dst) as rows (qid, k, id); none without a path. Labels stop at the target's best cost."""
    goal = pairs.select("qid", F.col("dst").alias("goal"))

    def bound(front: DataFrame, state: DataFrame) -> DataFrame:
        best = goal.join(state.select("qid", F.col("id").alias("goal"), F.col("d.cost").alias("best")), ["qid", "goal"], "left")
        # of equal costs the one with fewer arcs may still come
        return front.join(best, "qid").where(F.col("best").isNull() | (F.col("d.cost") <= F.col("best"))).select("qid", "id", "d")

    labels = materialise(tree(cheapest(graph), pairs.select("qid", F.col("src").alias("id")), bound), "tree")
    return trace_back(labels, pairs.select(F.col("qid").alias("path"), "qid", F.col("dst").alias("id"))).withColumnRenamed("path", "qid")


def unpack(legs: DataFrame, arcs: DataFrame) -> DataFrame:
    """Original arcs (qid, k, src, dst) of legs(qid, k, src, dst), k being the arcs before.

    arcs: (src, dst, n, mid), each pair once; mid is the node that a shortcut
    leaves out, null for an arc of the graph, n the arcs that it stands for. A
    round takes every shortcut apart, so rounds are as many as they are nested.
    """
    left, done = materialise(legs.select("qid", "k", "src", "dst"), "legs"), None
    mids = arcs.select("src", "dst", "mid")
    sizes = arcs.select("src", F.col("dst").alias("mid"), F.col("n").alias("first"))
    while not left.isEmpty():
        known = materialise(left.join(mids, ["src", "dst"]), "known")
        flat = known.where("mid IS NULL").select("qid", "k", "src", "dst")
        done = flat if done is None else done.unionAll(flat)
        nested = known.where("mid IS NOT NULL").join(sizes, ["src", "mid"])
        halves = F.array(F.struct("k", "src", F.col("mid").alias("dst")), F.struct((F.col("k") + F.col("first")).alias("k"), F.col("mid").alias("src"), "dst"))
        after = materialise(nested.select("qid", F.explode(halves).alias("h")).select("qid", "h.k", "h.src", "h.dst"), "legs")
        release(left)
        left = after
    return left if done is None else done


def meeting_paths(ahead: DataFrame, back: DataFrame, arcs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(qid, k, id) of pairs(qid, src, dst): both ends climb, over ahead and over back (turned round), to their cheapest meeting; shortcuts of arcs(src, dst, n, mid) are unpacked."""
    sides = both_sides(ahead, back, pairs, _start(), _step("src.id"), F.col("d.cost"))
    a, b = (materialise(labels.select("qid", "id", "d.cost", "d.hops", "d.parent"), "side") for labels in sides)
    met = a.select("qid", "id", F.col("cost").alias("ca"), F.col("hops").alias("ha")).join(b.select("qid", "id", F.col("cost").alias("cb")), ["qid", "id"])
    top = met.groupBy("qid").agg(F.min(F.struct((F.col("ca") + F.col("cb")).alias("cost"), "id", "ha")).alias("m")).select("qid", "m.id", "m.ha")
    top = materialise(top, "top")
    ends = top.select(F.col("qid").alias("path"), "qid", "id")
    rise, fall = trace_back(a, ends), trace_back(b, ends)
    leg = lambda rows, way: rows.withColumn("other", way("id").over(Window.partitionBy("path").orderBy("k"))).where("other IS NOT NULL")
    up = leg(rise, F.lead).select(F.col("path").alias("qid"), F.col("k").alias("at"), F.col("id").alias("src"), F.col("other").alias("dst"))
    down = leg(fall, F.lag).select(F.col("path").alias("qid"), (-F.col("k")).alias("at"), F.col("id").alias("src"), F.col("other").alias("dst"))
    both = up.withColumn("side", F.lit(0)).unionByName(down.withColumn("side", F.lit(1))).join(arcs.select("src", "dst", "n"), ["src", "dst"])
    before = Window.partitionBy("qid").orderBy("side", "at").rowsBetween(Window.unboundedPreceding, -1)
    legs = both.withColumn("k", F.coalesce(F.sum("n").over(before), F.lit(0)))
    flat = unpack(legs, arcs).select("qid", (F.col("k") + 1).alias("k"), F.col("dst").alias("id"))
    return pairs.join(top.select("qid"), "qid", "left_semi").select("qid", F.lit(0).cast("long").alias("k"), F.col("src").alias("id")).unionAll(flat)
