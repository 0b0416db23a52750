"""Radius joins on a grid, convex hulls and isochrones."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waygraph.functions.geo import EARTH_RADIUS, straight_line
from waygraph.operators.nearest import k_nearest  # noqa: F401  (a name of this module)


def _cells(points: DataFrame, x: str, y: str, size: float) -> DataFrame:
    return points.withColumns({"cx": F.floor(F.col(x) / size), "cy": F.floor(F.col(y) / size)})


def _around(points: DataFrame) -> DataFrame:
    """Each point once in its cell and the eight around it."""
    step = F.array(F.lit(-1), F.lit(0), F.lit(1))
    return (
        points.withColumn("dx", F.explode(step)).withColumn("dy", F.explode(step))
        .withColumns({"cx": F.col("cx") + F.col("dx"), "cy": F.col("cy") + F.col("dy")}).drop("dx", "dy")
    )


def _columns(row: Column, size: float, radius: float) -> Column:
    """Cells into which a row of latitudes is cut: each is as wide as the radius reaches from the rows beside it, one near a pole."""
    top = F.greatest(F.abs(row - 1), F.abs(row + 2)) * size
    ratio = math.sin(min(radius / EARTH_RADIUS, math.pi / 2)) / F.cos(F.radians(F.least(top, F.lit(89.999999))))
    wide = F.degrees(F.asin(F.least(F.lit(1.0), ratio))) * 1.0001
    return F.when((top >= 89.9) | (ratio >= 0.9999), F.lit(1)).otherwise(F.greatest(F.lit(1), F.floor(360 / wide))).cast("long")


def within(queries: DataFrame, points: DataFrame, radius: float, space: str = "planar") -> DataFrame:
    """All points within the radius (inclusive) of each query: (qid, id, dist). Cells of one radius are joined by key.

    In geographic space (metres; x = lon, y = lat) rows of latitudes are cut into
    as many cells as their circle holds, all around it, so that places near the
    poles and across the date line meet too.
    """
    p = points.select("id", "x", "y")
    if space == "geographic":
        size = max(math.degrees(radius / EARTH_RADIUS) * 1.0001, 1e-9)
        at = lambda x: F.floor(F.pmod(F.col(x) + 180, F.lit(360.0)) / 360 * F.col("n"))
        cells = p.withColumn("cy", F.floor(F.col("y") / size)).withColumn("n", _columns(F.col("cy"), size, radius))
        cells = cells.withColumn("cx", F.pmod(at("x"), F.col("n"))).drop("n")
        rows = F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda k: F.floor(F.col("qy") / size) + k)
        asked = queries.withColumn("cy", F.explode(rows)).withColumn("n", _columns(F.col("cy"), size, radius))
        beside = F.array_distinct(F.array(*[F.pmod(at("qx") + k, F.col("n")) for k in (-1, 0, 1)]))
        met = asked.withColumn("cx", F.explode(beside)).drop("n").join(cells, ["cx", "cy"])
    else:
        size = radius * 1.0000001 or 1e-12
        met = _around(_cells(queries, "qx", "qy", size)).join(_cells(p, "x", "y", size), ["cx", "cy"])
    d = straight_line(space, F.col("qx"), F.col("qy"), F.col("x"), F.col("y"))
    return met.withColumn("dist", d).where(F.col("dist") <= radius).select("qid", "id", "dist")


HULL_POINTS = 100_000


def convex_hull(points: DataFrame, group: str, parts: int | None = None) -> DataFrame:
    """Hull corners (group, id, x, y) of each group's points (group, id, x, y); collinear and repeated points are none.

    Two levels: a point that is no corner of its part's hull is none of the
    whole, so parts (by default of about HULL_POINTS points) are reduced first
    and only their corners meet in one task.
    """
    parts = parts or points.count() // HULL_POINTS + 1

    def corners(pdf):  # monotone chain over sorted points
        p = pdf.sort_values(["x", "y", "id"]).drop_duplicates(["x", "y"])
        if len(p) < 3:
            return p
        xs, ys = p["x"].to_numpy(), p["y"].to_numpy()

        def chain(order):
            out = []
            for i in order:
                while len(out) > 1:
                    a, b = out[-2], out[-1]
                    if (xs[b] - xs[a]) * (ys[i] - ys[a]) - (ys[b] - ys[a]) * (xs[i] - xs[a]) > 0:
                        break
                    out.pop()
                out.append(i)
            return out[:-1]

        keep = [*chain(range(len(p))), *chain(range(len(p) - 1, -1, -1))]
        return p.iloc[keep]

    p = points.select(group, "id", "x", "y")
    schema = p.schema
    first = p.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts))).groupBy(group, "part").applyInPandas(lambda pdf: corners(pdf.drop(columns="part")), schema)
    return first.groupBy(group).applyInPandas(corners, schema)


def isochrone(costs: DataFrame, cutoffs: list[float]) -> DataFrame:
    """Nodes (cutoff, id, cost) within each cutoff (inclusive) of one run of shortest paths (id, cost)."""
    bands = costs.sparkSession.createDataFrame([(float(c),) for c in sorted(set(cutoffs))], "cutoff double")
    return costs.join(F.broadcast(bands), F.col("cost") <= F.col("cutoff")).select("cutoff", "id", "cost")  # as many rows as cutoffs given
