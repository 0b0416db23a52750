"""From map extracts to road graphs: junctions, segments, one-way rules, station names and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waygraph.functions.geo import EARTH_RADIUS, haversine
from waygraph.functions.order import running_total

#: Platforms of a bucket, about: what one call clusters at once.
BUCKET = 20_000


def junctions(ways: DataFrame) -> DataFrame:
    """(id) of nodes that end a way or are used more than once, in one way or several; ways(way_id, nodes array)."""
    steps = ways.select(F.posexplode("nodes").alias("pos", "id"), (F.size("nodes") - 1).alias("last"))
    ends = ((F.col("pos") == 0) | (F.col("pos") == F.col("last"))).cast("int")
    return steps.groupBy("id").agg(F.count("*").alias("uses"), F.max(ends).alias("ends")).where("uses > 1 OR ends = 1").select("id")


def road_edges(ways: DataFrame, places: DataFrame, keep: DataFrame | None = None) -> DataFrame:
    """Least metres (u, v, w) between junctions and the nodes of keep(id).

    ways(way_id, nodes array, oneway, junction), places(id, lat, lon). A node is a
    junction if it ends a way or is used more than once, in one way or several.
    Ways are cut there; a cut's length is the sum of its legs. `oneway` yes, true
    or 1, or a roundabout, goes forward only, -1 backward only. Loops and cuts
    without length are dropped; legs to unknown places too.
    """
    steps = ways.select("way_id", "oneway", "junction", F.posexplode("nodes").alias("pos", "id"), (F.size("nodes") - 1).alias("last"))
    uses = steps.groupBy("id").agg(F.count("*").alias("uses"))
    steps = steps.join(uses, "id").join(places, "id")
    if keep is not None:
        steps = steps.join(keep.select("id", F.lit(True).alias("kept")).distinct(), "id", "left")
    order = Window.partitionBy("way_id").orderBy("pos")
    cut = ((F.col("pos") == 0) | (F.col("pos") == F.col("last")) | (F.col("uses") > 1) | (F.lit(False) if keep is None else F.coalesce("kept", F.lit(False)))).cast("int")
    leg = haversine(F.lag("lat").over(order), F.lag("lon").over(order), F.col("lat"), F.col("lon"))
    steps = steps.withColumns({"cut": cut, "leg": F.coalesce(leg, F.lit(0.0))})
    # a segment is what lies after one junction up to and with the next
    part = F.coalesce(F.sum("cut").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    length = steps.withColumn("part", part).groupBy("way_id", "part").agg(
        F.sum("leg").alias("w"), F.max_by("id", "pos").alias("v"), F.first("oneway").alias("oneway"), F.first("junction").alias("junction")
    )
    ends = Window.partitionBy("way_id").orderBy("part")
    pairs = length.withColumn("u", F.lag("v").over(ends)).where("u IS NOT NULL AND u <> v AND w > 0")
    one = F.coalesce(F.lower("oneway").isin("yes", "true", "1"), F.lit(False)) | F.coalesce(F.col("junction") == "roundabout", F.lit(False))
    back_only = F.coalesce(F.col("oneway") == "-1", F.lit(False))
    ahead = pairs.where(~back_only).select("u", "v", "w")
    back = pairs.where(back_only | ~one).select(F.col("v").alias("u"), F.col("u").alias("v"), "w")
    return ahead.unionAll(back).groupBy("u", "v").agg(F.min("w").alias("w"))


def dense_ids(nodes: DataFrame) -> DataFrame:
    """(id, dense): 0 and up in the order of ids."""
    return running_total(nodes.select("id").distinct(), "id", F.lit(1), "dense").select("id", "dense")


def normal_name(name: Column) -> Column:
    """Lower case, without dots, dashes, apostrophes and underscores, single spaces."""
    return F.trim(F.regexp_replace(F.translate(F.lower(name), ".-–—_'", ""), r"\s+", " "))


def station_links(routes: DataFrame, stations: DataFrame) -> DataFrame:
    """(a, b, line, seconds) between consecutive named stops of routes(route_id, line, speed, stops array).

    A stop with the name of the one before is dropped; a link is kept once for
    each (smaller, larger, line); seconds are at least 45, to one decimal.
    """
    at = routes.select("route_id", "line", "speed", F.posexplode("stops").alias("k", "id")).join(stations.select("id", "name", "lat", "lon"), "id").where("name <> ''")
    order = Window.partitionBy("route_id").orderBy("k")
    at = at.where("name IS NOT NULL").withColumn("before", F.lag("name").over(order)).where("before IS NULL OR before <> name")
    nxt = {f"n{c}": F.lead(c).over(order) for c in ("id", "lat", "lon")}
    legs = at.withColumns(nxt).where("nid IS NOT NULL AND nid <> id")
    metres = haversine(F.col("lat"), F.col("lon"), F.col("nlat"), F.col("nlon"))
    seconds = F.round(F.greatest(F.lit(45.0), metres / F.col("speed")), 1)
    found = legs.select(F.least("id", "nid").alias("a"), F.greatest("id", "nid").alias("b"), "line", seconds.alias("seconds"))
    return found.groupBy("a", "b", "line").agg(F.min("seconds").alias("seconds"))


def merge_platforms(stations: DataFrame, metres: float = 400.0) -> DataFrame:
    """(id, canonical, lat, lon): stations of a city with one normal name within `metres` of a cluster's first are one.

    In the order of ids a station joins the first cluster whose head is near
    enough; the canonical id is the head's, lat and lon the cluster's centre. A
    group is the platforms of one name in one city.
    """
    import numpy as np

    def clusters(pdf):  # all groups of a bucket at once
        group = pdf.groupby(["city", "name"], dropna=False).ngroup().to_numpy()
        order = np.lexsort((pdf["id"].to_numpy(), group))
        pdf, group = pdf.iloc[order], group[order]
        ids, lat, lon = pdf["id"].to_numpy(), np.radians(pdf["lat"].to_numpy()), np.radians(pdf["lon"].to_numpy())
        out = np.zeros(len(ids), np.int64)
        left = np.arange(len(ids))
        while len(left):  # the first that is left of a group is a head, and takes what is near
            first = np.r_[True, group[left][1:] != group[left][:-1]]
            h = left[np.maximum.accumulate(np.where(first, np.arange(len(left)), 0))]
            x = np.sin((lat[left] - lat[h]) / 2) ** 2 + np.cos(lat[h]) * np.cos(lat[left]) * np.sin((lon[left] - lon[h]) / 2) ** 2
            near = first | (2 * EARTH_RADIUS * np.arcsin(np.sqrt(np.minimum(1.0, x))) <= metres)
            out[left[near]] = ids[h[near]]
            left = left[~near]
        return pdf.assign(canonical=out)[["id", "canonical", "lat", "lon"]]

    named = stations.select("id", "lat", "lon", "city", normal_name(F.col("name")).alias("name"))
    # a call for each bucket of groups, as a call costs more than a group of few platforms
    bucket = F.pmod(F.xxhash64("city", "name"), F.lit(stations.count() // BUCKET + 1))
    found = named.groupBy(bucket.alias("bucket")).applyInPandas(clusters, "id long, canonical long, lat double, lon double")
    of = found.groupBy("canonical").agg(F.avg("lat").alias("clat"), F.avg("lon").alias("clon"))
    return found.join(of, "canonical").select("id", "canonical", F.col("clat").alias("lat"), F.col("clon").alias("lon"))
