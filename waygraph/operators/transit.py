"""Multi-modal networks: station tables, filters, and roads combined with rails."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waygraph.functions.geo import equirectangular
from waygraph.loop import materialise
from waygraph.operators.spatial import k_nearest, within
from waygraph.tables import Graph

#: Metres a second on foot and by car, metres to a station, seconds to board, road nodes a station,
#: what is added to a station's id, and the seconds of a link that has none.
WALK, DRIVE, RADIUS, BOARD, TRANSFERS = 1.35, 8.33, 400.0, 180.0, 4
STATION_BASE, LINK_SECONDS = 1_000_000_000, 60.0


def check_links(stations: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links whose stations are both known, and the others."""
    ids = stations.select("id").distinct()
    known = links.join(ids.withColumnRenamed("id", "from"), "from", "left_semi").join(ids.withColumnRenamed("id", "to"), "to", "left_semi")
    a = links.join(ids.withColumnRenamed("id", "from"), "from", "left_anti")
    b = links.join(ids.withColumnRenamed("id", "from"), "from", "left_semi").join(ids.withColumnRenamed("id", "to"), "to", "left_anti")
    return known, a.unionByName(b)


def filter_network(stations: DataFrame, links: DataFrame, needle: str) -> tuple[DataFrame, DataFrame]:
    """Stations whose system or city is the needle, in any case; if none is, those that contain it. Links keep both ends."""
    n = needle.lower()
    exact = (F.lower("system") == n) | (F.lower("city") == n)
    part = F.lower("system").contains(n) | F.lower("city").contains(n)
    any_exact = stations.agg(F.coalesce(F.max(exact), F.lit(False)).alias("any"))
    kept = stations.crossJoin(F.broadcast(any_exact)).where(F.when(F.col("any"), exact).otherwise(part)).drop("any")
    return kept, check_links(kept, links)[0]


def systems(stations: DataFrame, links: DataFrame) -> DataFrame:
    """(system, stations, links), links counted at their first station's system."""
    s = stations.groupBy("system").agg(F.count("*").alias("stations"))
    of = links.join(stations.select(F.col("id").alias("from"), "system"), "from").groupBy("system").agg(F.count("*").alias("links"))
    return s.join(of, "system", "left").select("system", "stations", F.coalesce("links", F.lit(0)).alias("links"))


def resolve_station(stations: DataFrame, name: str) -> DataFrame:
    """The station with the least id whose name, in any case, or whose id is `name`."""
    return stations.where((F.lower("name") == name.lower()) | (F.col("id").cast("string") == name)).orderBy("id").limit(1)


def rail_only(stations: DataFrame, links: DataFrame) -> Graph:
    """Stations and links both ways, in seconds; parallels stay."""
    nodes = stations.select((F.col("id") + STATION_BASE).alias("id"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    w = F.when(F.col("seconds") > 0, F.col("seconds")).otherwise(F.lit(LINK_SECONDS))
    a, b = F.col("from") + STATION_BASE, F.col("to") + STATION_BASE
    edges = links.select(a.alias("src"), b.alias("dst"), w.alias("w")).unionAll(links.select(b.alias("src"), a.alias("dst"), w.alias("w")))
    return Graph(nodes, edges, "geographic")


def _reachable(alone: DataFrame, nodes: DataFrame, radius: float) -> DataFrame:
    """(qid, id): for each station the nodes up to twice the metres of one of them, so that the nearest in metres is there.

    The one is the nearest in degrees. Stations of like distances are looked up together, as cells have one size.
    """
    base = max(radius, 1.0)
    one = k_nearest(alone, nodes, 1).select("qid", "id").join(alone, "qid").join(nodes.select("id", "x", "y"), "id")
    m = equirectangular(F.col("qy"), F.col("qx"), F.col("y"), F.col("x"))
    one = materialise(one.select("qid", "qx", "qy", F.greatest(F.lit(0), F.ceil(F.log(F.greatest(F.lit(1.0), m * 2 / base)) / F.log(F.lit(4.0)))).cast("int").alias("far")), "alone")
    out = one.select("qid", F.col("qid").alias("id")).limit(0)
    for row in one.select("far").distinct().collect():  # a few powers of four between the radius and the earth's girth
        those = one.where(F.col("far") == row["far"])
        out = out.unionAll(within(those, nodes, base * 4 ** row["far"] * 1.001, "geographic").select("qid", "id"))
    return out


def combine(
    road: Graph, stations: DataFrame, links: DataFrame, radius: float = RADIUS, board: float = BOARD, walk: float = WALK, drive: float = DRIVE
) -> Graph:
    """Roads and rails in seconds, joined by walks from each station to up to TRANSFERS road nodes within the radius, else the nearest."""
    if road.space != "geographic":
        raise ValueError("roads and stations are combined on geographic coordinates only")
    rail = rail_only(stations, links)
    stands = rail.nodes.select(F.col("id").alias("station"), F.col("x").alias("qx"), F.col("y").alias("qy"))
    q = stands.groupBy("qx", "qy").agg(F.min("station").alias("qid"))  # stations at one place walk to the same nodes
    near = within(q, road.nodes, radius, "geographic").select("qid", "id")
    near = materialise(near, "near")
    alone = q.join(near.select("qid").distinct(), "qid", "left_anti")
    rest = _reachable(alone, road.nodes, radius).withColumn("alone", F.lit(True))
    met = near.withColumn("alone", F.lit(False)).unionByName(rest).join(q, "qid").join(road.nodes.select("id", "x", "y"), "id")
    met = met.withColumn("m", equirectangular(F.col("qy"), F.col("qx"), F.col("y"), F.col("x")))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("m", "id"))
    met = met.withColumn("r", rank).where(F.when(F.col("alone"), F.col("r") == 1).otherwise(F.col("r") <= TRANSFERS))
    met = met.join(stands, ["qx", "qy"])
    walks = met.select(F.col("id").alias("src"), F.col("station").alias("dst"), (F.col("m") / walk + board).alias("w")).unionAll(
        met.select(F.col("station").alias("src"), F.col("id").alias("dst"), (F.col("m") / walk).alias("w"))
    )
    edges = road.edges.select("src", "dst", (F.col("w") / drive).alias("w")).unionAll(rail.edges).unionAll(walks)
    nodes = road.nodes.select("id", "x", "y").unionAll(rail.nodes)
    return Graph(nodes, edges, "geographic")


def journey(paths: DataFrame, stations: DataFrame) -> DataFrame:
    """(qid, k, layer, name) of the nodes of paths(qid, path): rail by the station's id, or road."""
    at = paths.select("qid", F.posexplode("path").alias("k", "node")).withColumn("id", F.col("node") - STATION_BASE)
    named = at.join(stations.select("id", "name"), "id", "left")
    return named.select("qid", "k", F.when(F.col("node") >= STATION_BASE, "rail").otherwise("road").alias("layer"), "name")
