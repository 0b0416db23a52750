"""Turn-by-turn directions over paths, with window functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waygraph.functions.geo import bearing, planar_bearing, straight_line, turn_angle


def maneuver(turn, straight: float = 20.0):
    """Fixed bounds: up to `straight` on, 45 slight, 120 turn, below 150 sharp, from there a U-turn."""
    size = F.abs(turn)
    side = F.when(turn > 0, F.lit("right")).otherwise(F.lit("left"))
    return (
        F.when(size >= 150, F.lit("u-turn")).when(size <= straight, F.lit("straight"))
        .when(size <= 45, F.concat(F.lit("slight "), side)).when(size <= 120, side).otherwise(F.concat(F.lit("sharp "), side))
    )


def format_distance(metres, space: str):
    """`12.3 units` on a plane, else metres below a kilometre and kilometres above."""
    if space != "geographic":
        return F.format_string("%.1f units", metres)
    return F.when(metres >= 1000, F.format_string("%.1f km", metres / 1000)).otherwise(F.format_string("%.0f m", metres))


def build_directions(paths: DataFrame, nodes: DataFrame, space: str = "planar", straight: float = 20.0) -> DataFrame:
    """Steps (qid, step, maneuver, at, distance, bearing, turn) of paths(qid, path) over nodes(id, x, y).

    Distances are straight lines between nodes, not weights. A turn is held
    against the leg just before; legs that go straight on join the step before.
    The last step arrives, with distance 0. A path of fewer than two nodes has no steps.
    """
    at = paths.where("size(path) >= 2").select("qid", F.posexplode("path").alias("k", "id")).join(nodes.select("id", "x", "y"), "id")
    order = Window.partitionBy("qid").orderBy("k")
    nx, ny = F.lead("x").over(order), F.lead("y").over(order)
    point = bearing(F.col("y"), F.col("x"), ny, nx) if space == "geographic" else planar_bearing(F.col("x"), F.col("y"), nx, ny)
    legs = at.withColumns({"leg": straight_line(space, F.col("x"), F.col("y"), nx, ny), "bearing": point})
    turn = F.when(F.col("leg").isNotNull(), turn_angle(F.lag("bearing").over(order), F.col("bearing")))
    legs = legs.withColumn("turn", turn)
    kind = F.when(F.col("k") == 0, F.lit("depart")).when(F.col("leg").isNull(), F.lit("arrive")).otherwise(maneuver(F.col("turn"), straight))
    legs = legs.withColumn("maneuver", kind).withColumn("starts", (F.col("maneuver") != "straight").cast("int"))
    legs = legs.withColumn("step", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    first = lambda c: F.min_by(c, "k").alias(c)
    return legs.groupBy("qid", "step").agg(
        first("maneuver"), F.min_by("id", "k").alias("at"), F.coalesce(F.sum("leg"), F.lit(0.0)).alias("distance"), first("bearing"),
        F.coalesce(F.min_by("turn", "k"), F.lit(0.0)).alias("turn"),
    )
