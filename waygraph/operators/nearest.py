"""Nearest neighbours over k-d cells that follow the points' density.

Cells are split four by four at sampled quantiles until none holds many
points, so dense places get small cells and an outlier one of its own. A query
goes down the levels with the cells that can hold one of its nearest: those
whose box is not further than the furthest corner of a box with enough points.
Its nearest leaf is looked at first; that gives a distance, and only leaves
within it are looked at then. All joins are by a cell's key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waygraph.functions.geo import euclidean
from waygraph.loop import materialise, release

#: Points of a cell that is split no further.
LEAF = 128
#: Levels at most; each takes a sixteenth of the points.
LEVELS = 15
#: Places of cells that a task holds against its queries: their number isn't seen from the bytes of the queries.
HELD = 500_000


def _strip(of: str, cuts: str) -> Column:
    """Which of four strips: how many cuts a value lies above."""
    return F.aggregate(F.col(cuts), F.lit(0), lambda n, c: n + (F.col(of) > c).cast("int"))


def kd_cells(points: DataFrame, leaf: int = LEAF) -> tuple[DataFrame, DataFrame, int]:
    """Leaf of each point (id, x, y, level, cell), and the boxes of all cells: (level, cell, up, n, is_leaf, ax, bx, ay, by).

    A cell's children have cell * 16 to cell * 16 + 15 at the next level, `up`
    is their parent's. Points must be distinct places, else a cell may not get smaller; such cells stay whole after LEVELS.
    """
    quarters = lambda c: F.percentile_approx(c, F.array(*map(F.lit, (0.25, 0.5, 0.75))), F.lit(200))
    box = [F.count("*").alias("n"), F.min("x").alias("ax"), F.max("x").alias("bx"), F.min("y").alias("ay"), F.max("y").alias("by")]
    open_, leaves, boxes = materialise(points.select("id", "x", "y", F.lit(0).cast("long").alias("cell")), "cells"), None, None
    for level in range(LEVELS + 1):
        found = materialise(open_.groupBy("cell").agg(*box, quarters("x").alias("cx")), "boxes")
        is_leaf = (F.col("n") <= leaf) if level < LEVELS else F.lit(True)
        one = found.select(F.lit(level).alias("level"), "cell", F.expr("cell div 16").alias("up"), "n", is_leaf.alias("is_leaf"), "ax", "bx", "ay", "by")
        boxes = one if boxes is None else boxes.unionAll(one)
        end = open_.join(found.where(is_leaf).select("cell"), "cell", "left_semi").select("id", "x", "y", F.lit(level).alias("level"), "cell")
        leaves = materialise(end, "leaves") if leaves is None else leaves.unionAll(materialise(end, "leaves"))
        cut = found.where(~is_leaf).select("cell", "cx")
        if cut.isEmpty():
            return leaves, boxes, level
        strips = open_.join(cut, "cell").select("id", "x", "y", "cell", _strip("x", "cx").alias("sx"))
        across = strips.groupBy("cell", "sx").agg(quarters("y").alias("cy"))
        below = strips.join(across, ["cell", "sx"]).select("id", "x", "y", (F.col("cell") * 16 + F.col("sx") * 4 + _strip("y", "cy")).alias("cell"))
        below = materialise(below, "cells")
        release(open_)
        open_ = below
    raise AssertionError("the last level has leaves only")


def _gap(q: str, a: str, b: str) -> Column:
    return F.greatest(F.lit(0.0), F.col(a) - F.col(q), F.col(q) - F.col(b))


def _far(q: str, a: str, b: str) -> Column:
    return F.greatest(F.abs(F.col(q) - F.col(a)), F.abs(F.col(q) - F.col(b)))


def k_nearest(queries: DataFrame, points: DataFrame, k: int = 1, skip_self: bool = False, leaf: int = LEAF) -> DataFrame:
    """For each planar query (qid, qx, qy) the k nearest points (id, x, y), ties to the smaller id: (qid, id, dist).

    Exact: cells are left out by their boxes only. Of points at one place only
    the k smallest ids (one more with skip_self) can count, so a hot place costs
    no more than any other, and queries at one place are looked for once.
    Points and queries without a place are left out.
    """
    asked = materialise(queries.select("qid", "qx", "qy").where("qx IS NOT NULL AND qy IS NOT NULL"), "asked")
    # -0.0 is 0.0, as a grouping takes them; a place is named by one of its queries
    spots = materialise(asked.groupBy("qx", "qy").agg(F.min("qid").alias("spot")), "spots")
    need = k + int(skip_self)
    here = Window.partitionBy("x", "y").orderBy("id")
    p = points.select("id", "x", "y").where("x IS NOT NULL AND y IS NOT NULL")
    p = p.withColumn("r", F.row_number().over(here)).where(F.col("r") <= need)  # Spark cuts before it exchanges, too
    places = materialise(p.groupBy("x", "y").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("id"), "x", "y", "ids"), "places")
    leaves, boxes, deepest = kd_cells(places, max(leaf, 4 * need))
    boxes = materialise(boxes, "boxes")
    front = spots.select(F.col("spot").alias("qid"), "qx", "qy", F.lit(0).cast("long").alias("up"), F.lit(float("inf")).alias("bound"))
    slack = 1 + 1e-12  # a box's distance may be rounded up
    reached = None
    for level in range(deepest + 1):
        children = boxes.where(F.col("level") == level).drop("level")
        met = front.join(children, "up").select(
            "qid", "qx", "qy", "bound", F.col("cell").alias("up"), "n", "is_leaf",
            F.sqrt(F.pow(_gap("qx", "ax", "bx"), 2) + F.pow(_gap("qy", "ay", "by"), 2)).alias("gap"),
            F.sqrt(F.pow(_far("qx", "ax", "bx"), 2) + F.pow(_far("qy", "ay", "by"), 2)).alias("far"),
        )
        met = met.where(F.col("gap") <= F.col("bound") * slack)
        best = F.min(F.when(F.col("n") >= need, F.col("far"))).over(Window.partitionBy("qid"))  # the few cells of a query
        met = met.withColumn("bound", F.least("bound", F.coalesce(best, F.col("bound"))))
        met = materialise(met.where(F.col("gap") <= F.col("bound") * slack), "met")
        ends = met.where("is_leaf").select("qid", "qx", "qy", F.lit(level).alias("level"), F.col("up").alias("cell"), "gap")
        reached = ends if reached is None else reached.unionAll(ends)
        front = met.where("NOT is_leaf").select("qid", "qx", "qy", "up", "bound")
    rank = Window.partitionBy("qid").orderBy("dist", "id")

    leaves = leaves.join(places.select("id", "ids"), "id")
    order = Window.partitionBy("qid").orderBy("gap", "level", "cell")
    ranked = materialise(reached.withColumn("r", F.row_number().over(order)), "reached")
    tasks = ranked.count() * max(leaf, 4 * need) // HELD + 1

    def look(at: DataFrame) -> DataFrame:
        met = at.repartition(tasks, "level", "cell").join(leaves, ["level", "cell"])
        found = met.select("qid", euclidean(F.col("qx"), F.col("qy"), F.col("x"), F.col("y")).alias("dist"), "id", "ids")
        # each place has an id of its own, so no more places than ids are needed
        found = found.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= need).select("qid", "dist", F.explode("ids").alias("id"))
        return found.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= need).drop("r")

    near = materialise(look(ranked.where("r = 1")), "near")
    known = near.groupBy("qid").agg(F.max("dist").alias("kth"), F.count("*").alias("n")).where(F.col("n") == need).select("qid", "kth")
    rest = ranked.where("r > 1").join(known, "qid", "left").where(F.col("kth").isNull() | (F.col("gap") <= F.col("kth") * slack))
    both = near.unionByName(look(rest))
    best = both.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= need).select(F.col("qid").alias("spot"), "dist", "id")
    of = asked.join(spots, ["qx", "qy"]).select("qid", "spot")
    found = of.join(best, "spot").select("qid", "id", "dist")
    if not skip_self:
        return found
    return found.where("qid <> id").withColumn("r", F.row_number().over(rank)).where(F.col("r") <= k).select("qid", "id", "dist")
