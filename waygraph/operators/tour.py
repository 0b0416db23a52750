"""Rooted spanning forests by Euler tours: preorder numbers, subtree sizes and subtree extremes in logarithmic rounds.

A spanning forest comes from Boruvka rounds. Its arcs, both ways, form a closed
walk for each component (after an arc into a node goes the arc to the next
neighbour around it), which is a linked list; pointer doubling ranks it. The
ranks give parents, preorder numbers and subtree sizes, and a subtree is a range
of preorder numbers, so its least and greatest values are range minima and
maxima: within blocks of numbers in one task each, across them by a sparse
table over the blocks. No step goes level by level, so a long chain costs no
more rounds than a bush of its size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waygraph.functions.order import next_in_order, running_total
from waygraph.loop import materialise, release
from waygraph.operators.analysis import components, spanning_forest
from waygraph.tables import Graph

#: Preorder numbers of a block: what one task holds.
BLOCK = 1 << 16


def list_ranks(links: DataFrame) -> DataFrame:
    """Steps to the end of each element's list: links(at, next), next null at an end, to (at, steps). Rounds grow with the log of the longest list."""
    state = materialise(links.select("at", "next", F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("steps")), "ranks")
    while not state.where("next IS NOT NULL").isEmpty():
        ahead = state.select(F.col("at").alias("next"), F.col("next").alias("then"), F.col("steps").alias("more"))
        after = state.join(ahead, "next", "left").select("at", F.col("then").alias("next"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"))
        after = materialise(after, "ranks")
        release(state)
        state = after
    return state.select("at", "steps")


def rooted_forest(graph: Graph) -> tuple[DataFrame, DataFrame]:
    """A spanning forest rooted at each component's smallest id, and the simple pairs (u, v) of the graph.

    Returns (id, root, parent, pre, size): pre numbers all nodes from 0, each
    subtree in a row; parent is null for roots.
    """
    pairs = materialise(graph.undirected().select("u", "v"), "pairs")
    comp = materialise(components(graph), "comp")
    # weights by a hash, so that a chain's picked edges form short pieces in each round
    forest = materialise(spanning_forest(pairs.withColumn("w", F.xxhash64("u", "v"))).select("u", "v"), "forest")
    arcs = materialise(forest.select(F.col("u").alias("src"), F.col("v").alias("dst")).unionAll(forest.select(F.col("v").alias("src"), F.col("u").alias("dst"))), "arcs")
    around = next_in_order(arcs, ["src"], "dst", "after")
    first = arcs.groupBy("src").agg(F.min("dst").alias("first"))
    roots = comp.where("id = component").select(F.col("id").alias("src"), F.lit(True).alias("is_root"))
    around = around.join(first, "src").join(roots, "src", "left")
    # the walk ends where it would leave its root for the first neighbour again
    then = F.when(F.col("after").isNotNull(), F.col("after")).when(F.col("is_root").isNull(), F.col("first"))
    links = around.select(F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")).alias("at"), F.when(then.isNotNull(), F.struct("src", then.alias("dst"))).alias("next"))
    ranks = materialise(list_ranks(links).select(F.col("at.src").alias("u"), F.col("at.dst").alias("v"), "steps"), "ranks")
    back = ranks.select(F.col("u").alias("v"), F.col("v").alias("u"), F.col("steps").alias("returns"))
    # of an edge's two arcs the one further from the end goes down
    down = ranks.join(back, ["u", "v"]).where("steps > returns").select(F.col("v").alias("id"), F.col("u").alias("parent"), "steps", F.expr("(steps - returns + 1) div 2").alias("size"))
    sizes = comp.groupBy("component").agg(F.count("*").alias("whole"))
    nodes = comp.join(down, "id", "left").join(sizes, "component")
    order = F.struct("component", F.coalesce(-F.col("steps"), -2 * F.col("whole")).alias("s"))
    nodes = nodes.select("id", F.col("component").alias("root"), "parent", F.coalesce("size", "whole").alias("size"), order.alias("_order"))
    numbered = running_total(nodes, "_order", F.lit(1).cast("long"), "pre")
    return materialise(numbered.select("id", "root", "parent", "pre", "size"), "tree"), pairs


def _in_block(pdf):
    """Of one block's rows by pre: the extremes of each row's subtree as far as it lies in the block, and from the block's start to the row."""
    import numpy as np

    pdf = pdf.sort_values("pre")
    n, start = len(pdf), pdf["pre"].iloc[0]
    at = np.arange(n)
    last = np.minimum(pdf["pre"].to_numpy() + pdf["size"].to_numpy() - 1 - start, n - 1)
    power = np.frexp((last - at + 1).astype(float))[1] - 1  # the largest power of two that fits
    for source, out, best, prefix in (("lo", "low", np.minimum, "plow"), ("hi", "high", np.maximum, "phigh")):
        table = pdf[source].to_numpy()
        pdf[prefix] = best.accumulate(table)
        result = np.empty(n, np.int64)
        for k in range(int(power.max()) + 1):
            here = power == k
            result[here] = best(table[at[here]], table[last[here] - (1 << k) + 1])
            if (1 << k) < n:
                table = np.concatenate([best(table[: -(1 << k)], table[1 << k :]), table[len(table) - (1 << k) :]])
        pdf[out] = result
    return pdf[["id", "pre", "size", "low", "high", "plow", "phigh"]]


def subtree_extremes(values: DataFrame, block: int = BLOCK) -> DataFrame:
    """(id, low, high) over each node's subtree of values(id, pre, size, lo, hi), pre being all numbers from 0 on."""
    own = values.select("id", "pre", "size", "lo", "hi", F.expr(f"pre div {block}").alias("b"))
    schema = "id long, pre long, size long, low long, high long, plow long, phigh long"
    inside = materialise(own.groupBy("b").applyInPandas(lambda pdf: _in_block(pdf.drop(columns="b")), schema), "inside")
    span = inside.withColumns({"b": F.expr(f"pre div {block}"), "e": F.expr(f"(pre + size - 1) div {block}")})
    done = span.where("b = e").select("id", "low", "high")
    over = materialise(span.where("e > b").select("id", "b", "e", "low", "high", (F.col("pre") + F.col("size") - 1).alias("end")), "over")
    tails = inside.select(F.col("pre").alias("end"), F.col("plow").alias("tl"), F.col("phigh").alias("th"))
    over = over.join(tails, "end").select("id", "b", "e", F.least("low", "tl").alias("low"), F.greatest("high", "th").alias("high"))
    over = materialise(over, "over")
    # whole blocks in between, by ranges of 2^k blocks that may overlap
    table = own.groupBy("b").agg(F.min("lo").alias("l"), F.max("hi").alias("h"))
    table = materialise(table, "sparse")
    widest = over.agg(F.max(F.col("e") - F.col("b") - 1)).first()[0] or 0
    done = done.unionAll(over.where("e = b + 1").select("id", "low", "high"))
    k = 0
    while 1 << k <= widest:
        mine = over.where(f"e - b - 1 >= {1 << k} AND e - b - 1 < {2 << k}")
        left = table.select((F.col("b") - 1).alias("b"), F.col("l").alias("l1"), F.col("h").alias("h1"))
        right = table.select((F.col("b") + (1 << k)).alias("e"), F.col("l").alias("l2"), F.col("h").alias("h2"))
        met = mine.join(left, "b").join(right, "e").select("id", F.least("low", "l1", "l2").alias("low"), F.greatest("high", "h1", "h2").alias("high"))
        done = done.unionAll(materialise(met, "low"))
        beside = table.select((F.col("b") - (1 << k)).alias("b"), F.col("l").alias("l1"), F.col("h").alias("h1"))
        after = materialise(table.join(beside, "b").select("b", F.least("l", "l1").alias("l"), F.greatest("h", "h1").alias("h")), "sparse")
        release(table)
        table, k = after, k + 1
    return done


def low_high(graph: Graph, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Each node with the least and greatest preorder number that its subtree touches beside tree edges, and the pairs that are no tree edges.

    Returns (id, parent, pre, size, low, high) and (u, v, pu, pv), the p being preorder numbers.
    """
    nodes, pairs = rooted_forest(graph)
    number = lambda c: nodes.select(F.col("id").alias(c), F.col("pre").alias(f"p{c}"), F.col("parent").alias(f"up{c}"))
    other = pairs.join(number("u"), "u").join(number("v"), "v").where("NOT (upu <=> v) AND NOT (upv <=> u)")
    other = materialise(other.select("u", "v", "pu", "pv"), "other")
    touch = other.select(F.col("u").alias("id"), F.col("pv").alias("t")).unionAll(other.select(F.col("v").alias("id"), F.col("pu").alias("t")))
    own = nodes.join(touch.groupBy("id").agg(F.min("t").alias("l"), F.max("t").alias("h")), "id", "left")
    own = materialise(own.select("id", "parent", "pre", "size", F.least("pre", "l").alias("lo"), F.greatest("pre", "h").alias("hi")), "own")
    found = subtree_extremes(own, block)
    return own.select("id", "parent", "pre", "size").join(found, "id"), other
