"""Search traces as events, and their replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waygraph.loop import materialise
from waygraph.operators.paths import cheapest, costs, hops
from waygraph.tables import Graph

DISCOVER, EXPAND, RELAX = 0, 1, 2


def bfs_trace(graph: Graph, sources: DataFrame) -> DataFrame:
    """Events (qid, step, op, node, parent): a node is discovered in the step of its hop count and expanded in the next."""
    h = hops(graph, sources)
    up = h.select("qid", F.col("id").alias("src"), "hops").join(graph.edges.select("src", "dst"), "src").select("qid", "src", F.col("dst").alias("id"), (F.col("hops") + 1).alias("hops"))
    up = up.groupBy("qid", "id", "hops").agg(F.min("src").alias("parent"))
    found = materialise(h.join(up, ["qid", "id", "hops"], "left"), "found")
    discover = found.select("qid", F.col("hops").alias("step"), F.lit(DISCOVER).alias("op"), F.col("id").alias("node"), "parent")
    expand = found.select("qid", (F.col("hops") + 1).alias("step"), F.lit(EXPAND).alias("op"), F.col("id").alias("node"), "parent")
    return discover.unionAll(expand)


def cost_trace(graph: Graph, sources: DataFrame) -> DataFrame:
    """Events (qid, step, op, node, parent) of a search by least costs; a step is the cost at which something happens.

    A node is expanded at its own cost. What it can reach is discovered if
    nothing expanded before it reaches that (ties by id), and relaxed if it
    offers less than all before it.
    """
    c = materialise(costs(graph, sources), "costs")
    a = c.select("qid", F.col("id").alias("src"), F.col("cost").alias("step"))
    met = a.join(cheapest(graph), "src").select("qid", "step", F.col("dst").alias("node"), F.col("src").alias("parent"), (F.col("step") + F.col("w")).alias("offer"))
    own = sources.select("qid", F.lit(-1.0).alias("step"), F.col("id").alias("node"), F.lit(None).cast("long").alias("parent"), F.lit(0.0).alias("offer"))
    before = F.min("offer").over(Window.partitionBy("qid", "node").orderBy("step", "parent").rowsBetween(Window.unboundedPreceding, -1))
    op = F.when(F.col("before").isNull(), DISCOVER).when(F.col("offer") < F.col("before"), RELAX)
    found = own.unionByName(met).withColumn("before", before).select("qid", F.greatest("step", F.lit(0.0)).alias("step"), op.alias("op"), "node", "parent")
    expand = c.select("qid", F.col("cost").alias("step"), F.lit(EXPAND).alias("op"), F.col("id").alias("node"), F.lit(None).cast("long").alias("parent"))
    return found.where("op IS NOT NULL").unionByName(expand)


def replay(events: DataFrame, step: int) -> DataFrame:
    """The state after a step: (qid, id, explored, in_frontier, parent)."""
    seen = events.where(F.col("step") <= step).groupBy("qid", F.col("node").alias("id")).agg(
        F.max(F.col("op") == EXPAND).alias("explored"), F.max_by("parent", F.when(F.col("parent").isNotNull(), F.struct("step", "parent"))).alias("parent")
    )
    return seen.select("qid", "id", "explored", (~F.col("explored")).alias("in_frontier"), "parent")
