"""Map extracts: tiles and their merge, rails with their stations, and rapid-transit routes."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waygraph.functions.geo import haversine
from waygraph.functions.order import running_total
from waygraph.operators.etl import junctions, road_edges
from waygraph.operators.spatial import within

#: Square degrees of a tile; metres to pin and to snap a station, and between platforms of one (metro, rail).
TILE, PIN, SNAP, MERGE, RAIL_MERGE = 0.06, 400.0, 450.0, 400.0, 1000.0
#: Metres a second by kind of route, and of other kinds; the least seconds of a link.
SPEEDS, SPEED, LEAST_SECONDS = {"subway": 9.5, "light_rail": 8.0, "monorail": 8.0, "train": 13.9}, 9.0, 45.0
#: Roles of members that are stops.
ROLES = ("stop", "stop_entry_only", "stop_exit_only", "platform", "platform_entry_only", "platform_exit_only", "")
#: Networks known by another name, with their cities.
ALIASES = {
    "MMMOCL": ("Mumbai Monorail", "Mumbai"),
    "Madhya Pradesh Metro Rail Corporation Limited": ("Indore Metro", "Indore"),
    "Bhoj Metro": ("Bhopal Metro", "Bhopal"),
    "RapidX": ("Namo Bharat (RRTS)", "Delhi NCR"),
    "Namma Metro": ("Namma Metro", "Bengaluru"),
    "Rapid Metro Gurgaon": ("Rapid Metro Gurugram", "Gurugram"),
}
#: Endings of a network's name after its city, the name of the national railway, and of an unknown network.
SUFFIXES, RAILWAY, UNKNOWN = (" Metro Rail", " Metro", " Monorail", " Light Rail"), "Indian Railways", "Unknown Network"


def tiles(boxes: DataFrame, most: float = TILE) -> DataFrame:
    """(box, tile, south, west, north, east) of boxes(box, south, west, north, east): as many rows as columns, each tile of `most` square degrees or less."""
    n = F.greatest(F.lit(1), F.ceil(F.sqrt((F.col("north") - F.col("south")) * (F.col("east") - F.col("west")) / most))).cast("long")
    cut = boxes.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.expr("n * n - 1"))))
    at = lambda a, b, k: F.col(a) + (F.col(b) - F.col(a)) * k / F.col("n")
    row, column = F.expr("k div n"), F.expr("k % n")
    return cut.select(
        "box", (F.col("k") + 1).cast("int").alias("tile"),
        at("south", "north", row).alias("south"), at("west", "east", column).alias("west"),
        at("south", "north", row + 1).alias("north"), at("west", "east", column + 1).alias("east"),
    )


def empty_tiles(asked: DataFrame, elements: DataFrame) -> DataFrame:
    """The rows of asked(tile, ...) for which no element of elements(tile, ...) came: the extract would have a hole there."""
    return asked.join(elements.select("tile").distinct(), "tile", "left_anti")


def merge_tiles(elements: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """One row for each (type, id) of elements(type, id, tile, ...): that of the least tile.

    With the tiles asked(tile, ...) for, one that is empty raises ValueError.
    """
    if asked is not None and (hole := empty_tiles(asked, elements).agg(F.count("*").alias("n"), F.min("tile").alias("tile")).first())["n"]:
        raise ValueError(f"{hole['n']} tiles are empty, the first is {hole['tile']}")
    rest = [c for c in elements.columns if c not in ("type", "id", "tile")]
    kept = elements.groupBy("type", "id").agg(F.min(F.struct("tile", *rest)).alias("e"))
    return kept.select("type", "id", *[F.col(f"e.{c}").alias(c) for c in ["tile", *rest]])


def rounded(places: DataFrame) -> DataFrame:
    """places(id, lat, lon) to five decimals, as they are before anything is measured."""
    return places.withColumns({c: F.round(c, 5) for c in ("lat", "lon")})


def _nearest(stations: DataFrame, points: DataFrame, metres: float) -> DataFrame:
    """(station, id, dist): the nearest point below `metres` of each station(id, lat, lon); ties by id."""
    q = stations.select(F.col("id").alias("qid"), F.col("lon").alias("qx"), F.col("lat").alias("qy"))
    met = within(q, points.select("id", F.col("lon").alias("x"), F.col("lat").alias("y")), metres, "geographic").where(F.col("dist") < metres)
    best = met.groupBy("qid").agg(F.min(F.struct("dist", "id")).alias("b"))
    return best.select(F.col("qid").alias("station"), "b.id", "b.dist")


def pin_stations(stations: DataFrame, ways: DataFrame, places: DataFrame, metres: float = PIN) -> DataFrame:
    """(station, id): the nearest track node of each station that is none itself."""
    track = ways.select(F.explode("nodes").alias("id")).distinct()
    aside = stations.join(track, "id", "left_anti")
    return _nearest(aside, places.join(track, "id", "left_semi"), metres).select("station", "id")


def rail_keep(ways: DataFrame, stations: DataFrame, places: DataFrame, metres: float = PIN) -> DataFrame:
    """(id) of the track nodes that stay: junctions, ends, stations on the track, and the nodes pinned for others."""
    track = ways.select(F.explode("nodes").alias("id")).distinct()
    on = stations.select("id").join(track, "id", "left_semi")
    return junctions(ways).unionAll(on).unionAll(pin_stations(stations, ways, places, metres).select("id")).distinct()


def rail_edges(ways: DataFrame, places: DataFrame, keep: DataFrame) -> DataFrame:
    """Least metres (u, v, w) between kept nodes, always both ways."""
    plain = ways.select("way_id", "nodes", F.lit(None).cast("string").alias("oneway"), F.lit(None).cast("string").alias("junction"))
    return road_edges(plain, places, keep)


def snap_stations(stations: DataFrame, nodes: DataFrame, metres: float = SNAP) -> DataFrame:
    """(node, station, name): stations on the graph's nodes(id, lat, lon), else at the nearest below `metres`.

    A node has one name: its own station's, else that of the least id.
    """
    own = stations.join(nodes.select("id"), "id", "left_semi").select(F.col("id").alias("node"), F.col("id").alias("station"), "name", F.lit(0).alias("far"))
    aside = stations.join(nodes.select("id"), "id", "left_anti")
    near = _nearest(aside, nodes, metres).join(stations.select(F.col("id").alias("station"), "name"), "station")
    both = own.unionByName(near.select(F.col("id").alias("node"), "station", "name", F.lit(1).alias("far")))
    first = both.groupBy("node").agg(F.min(F.struct("far", "station", "name")).alias("s"))
    return first.select("node", "s.station", "s.name")


def _known(names: dict[str, str], raw: Column) -> Column:
    return F.try_element_at(F.create_map(*map(F.lit, chain(*names.items()))), raw)


def _tag(tags: Column, key: str) -> Column:
    value = F.try_element_at(tags, F.lit(key))
    return F.when(value != "", F.trim(value))


def system_name(tags: Column, rail: bool = False) -> Column:
    """The network's name, else the operator's, as riders know it."""
    if rail:
        return F.lit(RAILWAY)
    raw = F.coalesce(_tag(tags, "network"), _tag(tags, "operator"))
    return F.coalesce(_known({k: v[0] for k, v in ALIASES.items()}, raw), raw, F.lit(UNKNOWN))


def city_name(tags: Column, rail: bool = False) -> Column:
    """The city of a known network, else the one that is tagged, else the network's name without its ending."""
    if rail:
        return F.lit(RAILWAY)
    cities = {k: v[1] for k, v in ALIASES.items()}
    aliases = [_known(cities, F.coalesce(_tag(tags, k), F.lit(""))) for k in ("network", "operator")]
    tagged = [_tag(tags, k) for k in ("network:city", "city", "addr:city")]
    net = system_name(tags)
    cut = F.lit(None)
    for s in reversed(SUFFIXES):
        cut = F.when(net.endswith(s), F.trim(F.substring(net, F.lit(1), F.length(net) - len(s)))).otherwise(cut)
    return F.coalesce(*aliases, *tagged, cut, net)


def route_stops(relations: DataFrame, nodes: DataFrame, rail: bool = False) -> DataFrame:
    """(route_id, k, id, name, lat, lon, line, system, city, speed): the named stops of routes with two of them at least.

    relations(route_id, tags map, members array of (type, ref, role)), nodes(id,
    name, lat, lon). Only nodes with a stop's role count; a stop with the name of the one before is dropped.
    """
    tags = F.col("tags")
    of = relations.select(
        "route_id", F.coalesce(_tag(tags, "name"), _tag(tags, "ref"), F.lit("Unnamed Line")).alias("line"),
        system_name(tags, rail).alias("system"), city_name(tags, rail).alias("city"),
        F.coalesce(_known({k: str(v) for k, v in SPEEDS.items()}, F.coalesce(_tag(tags, "route"), F.lit("subway"))).cast("double"), F.lit(SPEED)).alias("speed"),
        F.posexplode("members").alias("k", "m"),
    )
    of = of.where((F.col("m.type") == "node") & F.coalesce(F.col("m.role"), F.lit("")).isin(*ROLES)).withColumn("id", F.col("m.ref")).drop("m")
    named = of.join(nodes.select("id", "name", "lat", "lon").where("name <> ''"), "id")
    route = Window.partitionBy("route_id")
    kept = named.withColumn("before", F.lag("name").over(route.orderBy("k"))).where("before IS NULL OR before <> name")
    many = kept.withColumn("many", F.count("*").over(route)).where("many >= 2")
    return many.select("route_id", "k", "id", "name", "lat", "lon", "line", "system", "city", "speed")


def stop_stations(stops: DataFrame) -> DataFrame:
    """(id, name, system, city, lat, lon) of each stop where it first occurs."""
    first = stops.groupBy("id").agg(F.min(F.struct("route_id", "k", "name", "system", "city", "lat", "lon")).alias("s"))
    return first.select("id", "s.name", "s.system", "s.city", "s.lat", "s.lon")


def stop_links(stops: DataFrame) -> DataFrame:
    """(from, to, line, seconds) between consecutive stops; of the same two ends and line the first stands."""
    order = Window.partitionBy("route_id").orderBy("k")
    legs = stops.withColumns({f"n{c}": F.lead(c).over(order) for c in ("id", "lat", "lon")}).where("nid IS NOT NULL AND nid <> id")
    metres = haversine(F.col("lat"), F.col("lon"), F.col("nlat"), F.col("nlon"))
    legs = legs.withColumn("seconds", F.round(F.greatest(F.lit(LEAST_SECONDS), metres / F.col("speed")), 1))
    first = legs.groupBy(F.least("id", "nid"), F.greatest("id", "nid"), "line").agg(F.min(F.struct("route_id", "k", "id", "nid", "seconds")).alias("l"))
    return first.select(F.col("l.id").alias("from"), F.col("l.nid").alias("to"), "line", "l.seconds")


def rewrite_links(links: DataFrame, canonical: DataFrame, stations: DataFrame) -> DataFrame:
    """Links between the canonical(id, canonical) stations: without loops and unknown ends, once for both ends and line (the one of the least ends)."""
    own = canonical.select("id", "canonical")
    moved = links.join(own.toDF("from", "a"), "from", "left").join(own.toDF("to", "b"), "to", "left")
    moved = moved.withColumns({"a": F.coalesce("a", "from"), "b": F.coalesce("b", "to")}).where("a <> b")
    ids = stations.select("id").distinct()
    moved = moved.join(ids.toDF("a"), "a", "left_semi").join(ids.toDF("b"), "b", "left_semi")
    first = moved.groupBy(F.least("a", "b"), F.greatest("a", "b"), "line").agg(F.min(F.struct("from", "to", "a", "b", "seconds")).alias("l"))
    return first.select(F.col("l.a").alias("from"), F.col("l.b").alias("to"), "line", "l.seconds")


def renumber(stations: DataFrame) -> DataFrame:
    """stations(id, name, system, city, ...) with number: from 1 by city, system, name and id."""
    ordered = stations.withColumn("_order", F.struct("city", "system", "name", "id"))
    return running_total(ordered, "_order", F.lit(1), "number").withColumn("number", F.col("number") + 1).drop("_order")
