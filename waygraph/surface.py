"""SQL surface: a graph as temporary views, and table functions over them in plain SQL.

`publish` writes hub labels of a hierarchy: for each node the nodes above it
that its climbing search reaches, with their costs. Any cheapest path has a
highest node that both ends' labels hold, so costs are a join of two label sets
and a minimum: plain SQL that the optimiser sees whole, and no search runs when
a question is asked.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waygraph.functions.geo import EARTH_RADIUS
from waygraph.loop import materialise
from waygraph.operators.index import Contraction
from waygraph.operators.paths import _loop
from waygraph.tables import Graph


def labels(index: Contraction, nodes: DataFrame, max_rounds: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """(id, hub, cost) of all nodes(id), from them and to them; a node is its own hub at no cost."""
    start = nodes.select(F.col("id").alias("qid"), "id", F.lit(0.0).alias("d"))

    def climb(arcs: DataFrame, name: str) -> DataFrame:
        found, _ = _loop(arcs.select("src", "dst", "w"), start, F.col("d") + F.col("w"), max_rounds)
        return materialise(found.select(F.col("qid").alias("id"), F.col("id").alias("hub"), F.col("d").alias("cost")), name)

    return climb(index.ahead, "labels_from"), climb(index.back, "labels_to")


def _box(space: str, x: str, y: str, r: str) -> str:
    """A filter that scans can use: no place outside of it is within r of (x, y). Across the date line and at the poles x is left free."""
    if space != "geographic":
        return f"n.x BETWEEN {x} - {r} AND {x} + {r} AND n.y BETWEEN {y} - {r} AND {y} + {r}"
    high = f"degrees({r} / {EARTH_RADIUS}) * 1.000001"
    # the widest longitude of a circle is asin(sin(radius) / cos(latitude))
    wide = f"degrees(asin(least(1.0D, sin(least({r} / {EARTH_RADIUS}, pi() / 2)) / greatest(cos(radians({y})), 1e-12D)))) * 1.000001"
    free = f"abs({y}) + {high} >= 90 OR {x} - {wide} < -180 OR {x} + {wide} > 180"
    return f"n.y BETWEEN {y} - {high} AND {y} + {high} AND ({free} OR n.x BETWEEN {x} - {wide} AND {x} + {wide})"


def _line(space: str, x: str, y: str) -> str:
    if space != "geographic":
        return f"sqrt((n.x - {x}) * (n.x - {x}) + (n.y - {y}) * (n.y - {y}))"
    half = f"power(sin(radians(n.y - {y}) / 2), 2) + cos(radians({y})) * cos(radians(n.y)) * power(sin(radians(n.x - {x}) / 2), 2)"
    return f"2 * {EARTH_RADIUS} * asin(sqrt(least(1.0D, {half})))"


def _plain(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
        raise ValueError(f"not a plain identifier: {name!r}")
    return name


MAKE = "CREATE OR REPLACE TEMPORARY FUNCTION"


def publish_places(graph: Graph, name: str) -> None:
    """Views `name_nodes` and `name_edges`, and with places the functions around a point.

    `name_around(px, py, radius)`: rows (id, dist). `name_nearest(px, py, radius)`:
    the closest of those (ties: the smallest id), no row without any. Both scan the
    nodes once with a filter on x and y that reaches the files. They are for single
    points: for a table of points use `waygraph.within` and `waygraph.nearest`,
    which join by cells, where LATERAL would compare everything with everything.
    """
    name, spark = _plain(name), graph.nodes.sparkSession
    graph.nodes.createOrReplaceTempView(f"{name}_nodes")
    graph.edges.createOrReplaceTempView(f"{name}_edges")
    if graph.space is None:
        return
    line, box = _line(graph.space, "px", "py"), _box(graph.space, "px", "py", "radius")
    rows = f"SELECT n.id, {line} FROM {name}_nodes n WHERE {box} AND {line} <= radius"
    spark.sql(f"{MAKE} {name}_around(px DOUBLE, py DOUBLE, radius DOUBLE) RETURNS TABLE (id BIGINT, dist DOUBLE) RETURN {rows}")
    spark.sql(f"{MAKE} {name}_nearest(px DOUBLE, py DOUBLE, radius DOUBLE) RETURNS TABLE (id BIGINT, dist DOUBLE) RETURN {rows} ORDER BY 2, 1 LIMIT 1")


def publish(graph: Graph, name: str, index: Contraction | None = None) -> None:
    """Make a graph known to the session's SQL under `name`, a plain identifier; an old one of that name is replaced.

    Besides what `publish_places` makes: views `name_from` and `name_to` (id, hub,
    cost), and for single questions the functions `name_route(a, b)`, one row
    (cost), null without a path, and `name_isochrone(a, within)`, rows (id, cost);
    their arguments reach the files as filters. A table of questions (qid, a, b)
    is joined with the views instead, by node and then by node and hub:

        SELECT q.qid, min(f.cost + t.cost) AS cost FROM q LEFT JOIN name_from f ON f.id = q.a
        LEFT JOIN name_to t ON t.hub = f.hub AND t.id = q.b GROUP BY q.qid

    Don't call the functions in a LATERAL join: the optimiser takes the argument
    out of the function, and so computes the answers of all nodes first.

    Labels are as many as the climbing searches reach nodes: few for hierarchies
    that are built to the end, up to the core's nodes each where building stopped
    early.
    """
    name, spark = _plain(name), graph.nodes.sparkSession
    publish_places(graph, name)
    away, home = labels(index or Contraction.build(graph), graph.nodes)
    away.createOrReplaceTempView(f"{name}_from")
    home.createOrReplaceTempView(f"{name}_to")
    spark.sql(
        f"{MAKE} {name}_route(a BIGINT, b BIGINT) RETURNS TABLE (cost DOUBLE) RETURN "
        f"SELECT min(f.cost + t.cost) FROM {name}_from f JOIN {name}_to t ON f.hub = t.hub WHERE f.id = a AND t.id = b"
    )
    spark.sql(
        f"{MAKE} {name}_isochrone(a BIGINT, within DOUBLE) RETURNS TABLE (id BIGINT, cost DOUBLE) RETURN "
        f"SELECT t.id, min(f.cost + t.cost) FROM {name}_from f JOIN {name}_to t ON f.hub = t.hub "
        "WHERE f.id = a AND f.cost <= within AND f.cost + t.cost <= within GROUP BY t.id"
    )
