"""Registered queries of extracts, sinks and helpers, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waygraph.operators import analysis, etl, extract, harness, paths, trace
from waygraph.plans import derive
from waygraph.plans import oracles as o
from waygraph.plans.queries import _WAYS, ORACLES, kept, query
from waygraph.sources import sinks
from waygraph.tables import Graph


@query("""WITH b AS (SELECT n_nationkey AS box, n_nationkey * 0.1 AS s, n_nationkey * 0.2 AS w, n_nationkey * 0.1 + (n_nationkey % 5 + 1) * 0.15 AS n, n_nationkey * 0.2 + (n_nationkey % 3 + 1) * 0.25 AS e FROM nation),
c AS (SELECT *, greatest(1, CAST(ceil(sqrt((n - s) * (e - w) / 0.06)) AS BIGINT)) AS k FROM b), t AS (SELECT *, unnest(range(k * k)) AS i FROM c)
SELECT box, CAST(i + 1 AS INTEGER) AS tile, round(s + (n - s) * (i // k) / k, 9) AS south, round(w + (e - w) * (i % k) / k, 9) AS west,
 round(s + (n - s) * (i // k + 1) / k, 9) AS north, round(w + (e - w) * (i % k + 1) / k, 9) AS east FROM t""")
def tile_grid(spark, sf):
    boxes = derive.table(spark, sf, "nation").selectExpr(
        "n_nationkey AS box", "n_nationkey * 0.1D AS south", "n_nationkey * 0.2D AS west",
        "n_nationkey * 0.1D + (n_nationkey % 5 + 1) * 0.15D AS north", "n_nationkey * 0.2D + (n_nationkey % 3 + 1) * 0.25D AS east",
    )
    return extract.tiles(boxes).select("box", "tile", *[F.round(c, 9).alias(c) for c in ("south", "west", "north", "east")])


@query("""SELECT type, id, tile, event FROM (SELECT event_type AS type, user_id AS id, CAST(event_id % 7 AS BIGINT) AS tile, event_id AS event,
 row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id % 7, event_id) AS r FROM events) WHERE r = 1""")
def tile_merge(spark, sf):
    return extract.merge_tiles(derive.table(spark, sf, "events").selectExpr("event_type AS type", "user_id AS id", "event_id % 7 AS tile", "event_id AS event"))


@query("SELECT p_partkey AS id, round(13 + p_partkey / 777.0, 5) AS lat, round(77 + p_size / 333.0, 5) AS lon FROM part")
def rounded_places(spark, sf):
    return extract.rounded(derive.table(spark, sf, "part").selectExpr("p_partkey AS id", "13 + p_partkey / 777.0D AS lat", "77 + p_size / 333.0D AS lon"))


def _ways(spark: SparkSession, sf: str) -> DataFrame:
    e = derive.table(spark, sf, "events")
    ways = e.groupBy(F.col("user_id").alias("way_id")).agg(F.sort_array(F.collect_list(F.struct("ts", "event_id"))).alias("m"))
    return ways.select("way_id", F.transform("m", lambda x: x["event_id"] % 400).alias("nodes"))


def _places(spark: SparkSession) -> DataFrame:
    return spark.range(400).selectExpr("id", "13 + ((id * 37) % 100) / 250.0D AS lat", "77 + ((id * 61) % 100) / 250.0D AS lon")


def _rail_stations(spark: SparkSession) -> DataFrame:
    """A third of them on the track, the others up to 666 metres beside it."""
    k = spark.range(60).selectExpr("id AS k", "id * 17 % 400 AS m")
    return k.selectExpr("CASE WHEN k % 3 = 0 THEN k * 5 ELSE 1000 + k END AS id", "concat('S', k % 20) AS name", "13 + ((m * 37) % 100) / 250.0D + 0.001D * (k % 7) AS lat", "77 + ((m * 61) % 100) / 250.0D AS lon")


_RAIL = f"""{_WAYS}, track AS (SELECT DISTINCT id FROM step), rs AS (SELECT CASE WHEN k % 3 = 0 THEN k * 5 ELSE 1000 + k END AS id, 'S' || (k % 20) AS name,
 13 + ((m * 37) % 100) / 250.0 + 0.001 * (k % 7) AS lat, 77 + ((m * 61) % 100) / 250.0 AS lon FROM (SELECT range AS k, range * 17 % 400 AS m FROM range(60))),
d AS (SELECT rs.id AS station, rs.name, pl.id, 2 * 6371008.8 * asin(sqrt(least(1.0, power(sin(radians(pl.lat - rs.lat) / 2), 2) + cos(radians(rs.lat)) * cos(radians(pl.lat)) * power(sin(radians(pl.lon - rs.lon) / 2), 2)))) AS m FROM rs, pl),
pin AS (SELECT station, arg_min(id, [m, id]) AS id FROM d WHERE m < 400 AND station NOT IN (SELECT id FROM track) AND id IN (SELECT id FROM track) GROUP BY station),
keep AS (SELECT id FROM step GROUP BY id HAVING count(*) > 1 UNION SELECT arg_min(id, pos) FROM step GROUP BY way_id UNION SELECT arg_max(id, pos) FROM step GROUP BY way_id
 UNION SELECT id FROM rs WHERE id IN (SELECT id FROM track) UNION SELECT id FROM pin)"""


@query(f"WITH {_RAIL} SELECT station, id FROM pin")
def rail_pins(spark, sf):
    return extract.pin_stations(_rail_stations(spark), _ways(spark, sf), _places(spark))


@query(f"WITH {_RAIL} SELECT id FROM keep")
def rail_keep(spark, sf):
    return extract.rail_keep(_ways(spark, sf), _rail_stations(spark), _places(spark))


@query(f"""WITH {_RAIL}, s AS (SELECT step.*, lat, lon, step.id IN (SELECT id FROM keep) AS cut FROM step JOIN pl USING (id)),
g AS (SELECT *, lag(lat) OVER w AS la, lag(lon) OVER w AS lo FROM s WINDOW w AS (PARTITION BY way_id ORDER BY pos)),
p AS (SELECT *, coalesce(sum(CAST(cut AS INTEGER)) OVER (PARTITION BY way_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part,
 coalesce(2 * 6371008.8 * asin(sqrt(least(1.0, power(sin(radians(lat - la) / 2), 2) + cos(radians(la)) * cos(radians(lat)) * power(sin(radians(lon - lo) / 2), 2)))), 0) AS leg FROM g),
l AS (SELECT way_id, part, sum(leg) AS w, arg_max(id, pos) AS v FROM p GROUP BY 1, 2), q AS (SELECT way_id, lag(v) OVER (PARTITION BY way_id ORDER BY part) AS u, v, w FROM l),
x AS (SELECT u, v, w FROM q WHERE u IS NOT NULL AND u <> v AND w > 0)
SELECT u, v, round(min(w), 3) AS w FROM (SELECT * FROM x UNION ALL SELECT v, u, w FROM x) GROUP BY 1, 2""")
def rail_edges(spark, sf):
    ways = _ways(spark, sf)
    keep = extract.rail_keep(ways, _rail_stations(spark), _places(spark))
    return extract.rail_edges(ways, _places(spark), keep).select("u", "v", F.round("w", 3).alias("w"))


@query(f"""WITH {_RAIL}, c AS (SELECT id AS node, id AS station, name, 0 AS far FROM rs WHERE id IN (SELECT id FROM keep) UNION ALL
 SELECT arg_min(id, [m, id]), station, any_value(name), 1 FROM d WHERE m < 450 AND station NOT IN (SELECT id FROM keep) AND id IN (SELECT id FROM keep) GROUP BY station)
SELECT node, arg_min(station, [far, station]) AS station, arg_min(name, [far, station]) AS name FROM c GROUP BY node""")
def rail_snap(spark, sf):
    keep = extract.rail_keep(_ways(spark, sf), _rail_stations(spark), _places(spark))
    return extract.snap_stations(_rail_stations(spark), _places(spark).join(keep, "id", "left_semi"))


_NETWORKS = ["Delhi Metro", "Bhoj Metro", "MMMOCL", "", "Kochi Metro Rail", "RapidX", "Hill Light Rail", "Plain Lines"]


def _relations(spark: SparkSession, sf: str) -> DataFrame:
    """A route for each user: events are members, of kinds and roles by their numbers."""
    e = derive.table(spark, sf, "events")
    member = F.struct("ts", "event_id", F.when(F.col("event_id") % 5 == 0, "way").otherwise("node").alias("type"), (F.col("event_id") % 400).alias("ref"), F.when(F.col("event_id") % 7 == 0, "guard").when(F.col("event_id") % 3 == 0, "stop").otherwise("").alias("role"))
    of = e.groupBy(F.col("user_id").alias("route_id")).agg(F.sort_array(F.collect_list(member)).alias("m"))
    network = F.get(F.array(*map(F.lit, _NETWORKS)), (F.col("route_id") % 8).cast("int"))
    tags = F.map_from_arrays(F.array(*map(F.lit, ("network", "operator", "city", "route", "ref"))), F.array(
        network, F.when(F.col("route_id") % 16 == 3, "RapidX").otherwise(""), F.when(F.col("route_id") % 24 == 0, "Somewhere").otherwise(""),
        F.when(F.col("route_id") % 2 == 0, "subway").otherwise("tram"), F.concat(F.lit("R"), F.col("route_id").cast("string"))))
    return of.select("route_id", tags.alias("tags"), F.transform("m", lambda x: F.struct(x["type"].alias("type"), x["ref"].alias("ref"), x["role"].alias("role"))).alias("members"))


def _stop_nodes(spark: SparkSession) -> DataFrame:
    return _places(spark).selectExpr("id", "CASE WHEN id % 11 > 0 THEN concat('N', id % 50) END AS name", "lat", "lon")


_ROUTES = f"""{_WAYS}, mem AS (SELECT user_id AS route_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k, event_id % 400 AS id FROM events),
ev AS (SELECT user_id AS route_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k, event_id FROM events),
nm AS (SELECT m.*, 'N' || (m.id % 50) AS name FROM mem m JOIN ev USING (route_id, k) WHERE event_id % 5 <> 0 AND event_id % 7 <> 0 AND m.id % 11 > 0),
kp AS (SELECT * FROM (SELECT *, lag(name) OVER (PARTITION BY route_id ORDER BY k) AS b FROM nm) WHERE b IS NULL OR b <> name),
st AS (SELECT kp.route_id, k, kp.id, name, lat, lon, 'R' || kp.route_id AS line, {_NETWORKS}[route_id % 8 + 1] AS net, CASE WHEN route_id % 16 = 3 THEN 'RapidX' ELSE '' END AS op, CASE WHEN route_id % 2 = 0 THEN 9.5 ELSE 9.0 END AS speed
 FROM kp JOIN pl ON pl.id = kp.id QUALIFY count(*) OVER (PARTITION BY route_id) >= 2),
sys AS (SELECT *, CASE WHEN net = 'Bhoj Metro' THEN 'Bhopal Metro' WHEN net = 'MMMOCL' THEN 'Mumbai Monorail' WHEN net = 'RapidX' OR (net = '' AND op = 'RapidX') THEN 'Namo Bharat (RRTS)' WHEN net = '' THEN 'Unknown Network' ELSE net END AS system,
 CASE WHEN net = 'Bhoj Metro' THEN 'Bhopal' WHEN net = 'MMMOCL' THEN 'Mumbai' WHEN net = 'RapidX' OR op = 'RapidX' THEN 'Delhi NCR' WHEN route_id % 24 = 0 THEN 'Somewhere' WHEN net = 'Delhi Metro' THEN 'Delhi' WHEN net = 'Kochi Metro Rail' THEN 'Kochi'
 WHEN net = 'Hill Light Rail' THEN 'Hill' WHEN net = '' THEN 'Unknown Network' ELSE net END AS city FROM st)"""


@query(f"WITH {_ROUTES} SELECT route_id, CAST(k AS INTEGER) AS k, id, name, line, system, city, CAST(speed AS DOUBLE) AS speed FROM sys")
def route_stops(spark, sf):
    return extract.route_stops(_relations(spark, sf), _stop_nodes(spark)).select("route_id", "k", "id", "name", "line", "system", "city", "speed")


@query(f"WITH {_ROUTES} SELECT id, name, system, city FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY route_id, k) AS r FROM sys) WHERE r = 1")
def stop_stations(spark, sf):
    return extract.stop_stations(extract.route_stops(_relations(spark, sf), _stop_nodes(spark))).select("id", "name", "system", "city")


@query(f"""WITH {_ROUTES}, lg AS (SELECT *, lead(id) OVER w AS nid, lead(lat) OVER w AS nla, lead(lon) OVER w AS nlo FROM sys WINDOW w AS (PARTITION BY route_id ORDER BY k)),
se AS (SELECT *, round(greatest(45.0, 2 * 6371008.8 * asin(sqrt(least(1.0, power(sin(radians(nla - lat) / 2), 2) + cos(radians(lat)) * cos(radians(nla)) * power(sin(radians(nlo - lon) / 2), 2)))) / speed), 1) AS seconds FROM lg WHERE nid IS NOT NULL AND nid <> id)
SELECT id AS "from", nid AS "to", line, seconds FROM (SELECT *, row_number() OVER (PARTITION BY least(id, nid), greatest(id, nid), line ORDER BY route_id, k) AS r FROM se) WHERE r = 1""")
def stop_links(spark, sf):
    return extract.stop_links(extract.route_stops(_relations(spark, sf), _stop_nodes(spark)))


def _platforms(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as platforms: of 400 in a row four each share a place (within 200 metres), a name but for its spelling, and a city."""
    return derive.table(spark, sf, "customer").selectExpr(
        "c_custkey AS id", "concat(CASE c_custkey % 2 WHEN 0 THEN 'St. ' ELSE 'st  ' END, c_custkey div 400 * 50 + c_custkey % 50) AS name", "concat('Y', c_custkey % 4) AS system",
        "concat('C', c_custkey % 5) AS city", "13 + ((c_custkey * 37) % 100) / 250.0D + 0.0005D * (c_custkey % 400 div 100) AS lat", "77 + ((c_custkey * 61) % 100) / 250.0D AS lon",
    )


_PLATFORMS = """pf AS (SELECT c_custkey AS id, CASE c_custkey % 2 WHEN 0 THEN 'St. ' ELSE 'st  ' END || (c_custkey // 400 * 50 + c_custkey % 50) AS name, 'Y' || (c_custkey % 4) AS system, 'C' || (c_custkey % 5) AS city,
 13 + ((c_custkey * 37) % 100) / 250.0 + 0.0005 * (c_custkey % 400 // 100) AS lat, 77 + ((c_custkey * 61) % 100) / 250.0 AS lon FROM customer),
ca AS (SELECT *, min(id) OVER g AS canonical, avg(lat) OVER g AS clat, avg(lon) OVER g AS clon FROM pf WINDOW g AS (PARTITION BY id % 100, id // 400))"""


@query(f"WITH {_PLATFORMS} SELECT id, canonical, round(clat, 9) AS lat, round(clon, 9) AS lon FROM ca")
def merge_platforms(spark, sf):
    return etl.merge_platforms(_platforms(spark, sf)).select("id", "canonical", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"))


@query(f"""WITH {_PLATFORMS}, lk AS (SELECT id AS f, (id * 7 + 1) % (max(id) OVER () + 21) AS t, 'L' || (id % 3) AS line, (id % 9) * 10.0 AS seconds FROM pf),
mv AS (SELECT lk.*, coalesce(a.canonical, f) AS a, coalesce(b.canonical, t) AS b FROM lk LEFT JOIN ca a ON a.id = f LEFT JOIN ca b ON b.id = t)
SELECT a AS "from", b AS "to", line, seconds FROM (SELECT *, row_number() OVER (PARTITION BY least(a, b), greatest(a, b), line ORDER BY f, t) AS r FROM mv WHERE a <> b AND a IN (SELECT canonical FROM ca) AND b IN (SELECT canonical FROM ca)) WHERE r = 1""")
def rewrite_links(spark, sf):
    canonical = etl.merge_platforms(_platforms(spark, sf))
    ids = derive.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    most = ids.agg(F.max("id").alias("m"))  # one row
    links = ids.crossJoin(F.broadcast(most)).selectExpr("id AS `from`", "(id * 7 + 1) % (m + 21) AS to", "concat('L', id % 3) AS line", "(id % 9) * 10.0D AS seconds")
    return extract.rewrite_links(links, canonical, canonical.select(F.col("canonical").alias("id")))


@query(f"WITH {_PLATFORMS} SELECT id, row_number() OVER (ORDER BY city, system, name, id) AS number FROM pf")
def renumber(spark, sf):
    return extract.renumber(_platforms(spark, sf)).select("id", "number")


@query("SELECT l_orderkey AS id, row_number() OVER (ORDER BY l_orderkey) - 1 AS dense FROM (SELECT DISTINCT l_orderkey * 100003 AS l_orderkey FROM lineitem)")
def dense_ids(spark, sf):
    return etl.dense_ids(derive.table(spark, sf, "lineitem").selectExpr("l_orderkey * 100003 AS id"))


@query("SELECT l_suppkey AS id, list_sort(list(l_extendedprice))[count(*) // 2 + 1] AS median FROM lineitem GROUP BY 1")
def upper_median(spark, sf):
    return analysis.upper_median(derive.table(spark, sf, "lineitem"), ["l_suppkey"], "l_extendedprice").withColumnRenamed("l_suppkey", "id")


@query(ORACLES["bridges"] + " ORDER BY isolated DESC, u, v LIMIT 10")
def critical_bridges(spark, sf):
    return analysis.top(analysis.bridges(kept(derive.hierarchy(spark, sf))), "isolated", ["u", "v"])


#: From every seventh part a way of six roads over the lattice, where it has them.
_ROUTES = """route AS (SELECT q, unnest([q, q + 1, q + 26, q + 27, q + 28, q + 53, q + 52]) AS id, unnest(range(7)) AS k FROM (SELECT p_partkey AS q FROM part WHERE p_partkey % 7 = 0 AND p_partkey % 25 <= 21 AND p_partkey + 53 <= (SELECT max(p_partkey) FROM part)))"""


def _routes(spark: SparkSession, sf: str) -> DataFrame:
    part = derive.table(spark, sf, "part").select(F.col("p_partkey").alias("q"))
    most = part.agg(F.max("q").alias("m"))  # one row
    these = part.crossJoin(F.broadcast(most)).where("q % 7 = 0 AND q % 25 <= 21 AND q + 53 <= m")
    return these.select(F.col("q").alias("qid"), F.array(*[F.col("q") + d for d in (0, 1, 26, 27, 28, 53, 52)]).alias("path"))


@query(f"WITH {_ROUTES} SELECT q AS qid, list(id ORDER BY k)[3] AS u, list(id ORDER BY k)[4] AS v FROM route GROUP BY q")
def close_mid_route(spark, sf):
    return harness.mid_route(_routes(spark, sf))


@query(f"""WITH {o.LATTICE}, {_ROUTES}, s AS (SELECT q, id, lead(id) OVER (PARTITION BY q ORDER BY k) AS nx FROM route), b AS (SELECT s, t, min(w) AS w FROM e GROUP BY 1, 2),
c AS (SELECT q, sum(b.w) AS cost FROM s JOIN b ON b.s = s.id AND b.t = s.nx GROUP BY q) SELECT q AS qid, cost * f AS cutoff FROM c, (SELECT unnest([0.25, 0.6, 1.0])::DOUBLE AS f)""")
def auto_cutoffs(spark, sf):
    """Cutoffs from what the routes cost over the lattice."""
    return harness.auto_cutoffs(paths.path_costs(derive.part_lattice(spark, sf), _routes(spark, sf)))


# ---- sinks


@query(f"WITH {o.HIERARCHY}, n AS (SELECT s AS id FROM e UNION SELECT t FROM e), m AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM n) "
       "SELECT a.k AS u, b.k AS v, e.w FROM e JOIN m a ON a.id = e.s JOIN m b ON b.id = e.t")  # fmt: skip
def graph_json(spark, sf):
    line = F.from_json("line", "u long, v long, w double")
    return sinks.graph_lines(derive.hierarchy(spark, sf))[1].select(line.alias("j")).select("j.*")


@query(f"WITH {o.HIERARCHY}, n AS (SELECT s AS id FROM e UNION SELECT t FROM e) SELECT count(*) AS nodes, 16 * count(*) AS bytes FROM n")
def geometry_buffers(spark, sf):
    g = derive.hierarchy(spark, sf)
    placed = Graph(g.nodes.withColumns({"x": F.col("id") * 0.5, "y": F.col("id") * 0.25}), g.edges, "planar")
    return sinks.geometry_buffers(placed).agg(F.sum("n").alias("nodes"), F.sum(F.length("xy")).alias("bytes"))


@query(f"WITH RECURSIVE {o.SUPPLIER_PART}, r(id, hops) USING KEY (id) AS (SELECT 10000001::BIGINT, 0 UNION (SELECT e.t, min(r.hops + 1) FROM r JOIN e ON e.s = r.id "
       "LEFT JOIN recurring.r p ON p.id = e.t WHERE p.id IS NULL GROUP BY e.t)) SELECT 2::BIGINT AS version, count(*) AS expanded, 2 * count(*) AS events, 3::BIGINT AS length FROM r")  # fmt: skip
def trace_json(spark, sf):
    g = kept(derive.supplier_part(spark, sf))
    events = trace.bfs_trace(g, spark.createDataFrame([(0, 10_000_001)], "qid int, id long"))
    found = spark.createDataFrame([(0, "bfs", 2.0, [10_000_001, 1, 10_000_002], None)], "qid int, algorithm string, cost double, path array<long>, closed array<long>")
    j = F.from_json("document", "formatVersion long, metadata struct<nodesExpanded:long,pathLength:long>, events array<array<long>>")
    return sinks.trace_documents(events, found).select(j.alias("j")).select(
        F.col("j.formatVersion").alias("version"), F.col("j.metadata.nodesExpanded").alias("expanded"), F.size("j.events").cast("long").alias("events"), F.col("j.metadata.pathLength").alias("length")
    )


@query("SELECT n_regionkey AS origin, c AS cutoff, count(*) FILTER (WHERE n_nationkey <= c) AS \"count\", 3::BIGINT AS corners FROM nation, (SELECT unnest([10.0, 25.0])::DOUBLE AS c) GROUP BY 1, 2")
def isochrone_json(spark, sf):
    cut = spark.createDataFrame([(10.0,), (25.0,)], "cutoff double")
    bands = derive.table(spark, sf, "nation").selectExpr("n_regionkey AS origin", "n_nationkey AS id").join(F.broadcast(cut), F.col("id") <= F.col("cutoff"))  # two rows
    hulls = bands.select("origin", "cutoff").distinct().select("origin", "cutoff", F.explode(F.array(*map(F.lit, range(3)))).alias("k"))
    hulls = hulls.withColumns({"x": F.col("k") * 0.5, "y": F.lit(float("nan"))})
    j = F.from_json("document", "origin int, bands array<struct<cutoff:double,count:long,hull:array<array<double>>>>")
    each = sinks.isochrone_documents(bands, hulls).select("origin", F.explode(j["bands"]).alias("b"))
    return each.select("origin", "b.cutoff", "b.count", F.size(F.filter("b.hull", lambda p: p[1].isNull())).cast("long").alias("corners"))
