"""Hand-built graphs with known answers."""

import pytest
from pyspark.sql import functions as F

from waygraph.loop import connected_components
from waygraph.operators import analysis, directions, paths, spatial, timedep, transit
from waygraph.tables import Graph


def graph(spark, arcs, undirected=True, places=None, space=None):
    rows = [(int(u), int(v), float(w)) for u, v, w in arcs]
    if undirected:
        rows += [(v, u, w) for u, v, w in rows]
    ids = sorted({x for u, v, _ in rows for x in (u, v)})
    places = places or {}
    nodes = [(i, *places.get(i, (0.0, 0.0))) for i in ids]
    return Graph(
        spark.createDataFrame(nodes, "id long, x double, y double"),
        spark.createDataFrame(rows, "src long, dst long, w double"),
        space,
    )


def sources(spark, *ids):
    return spark.createDataFrame([(k, i) for k, i in enumerate(ids)], "qid int, id long")


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


TRIANGLES = [(0, 1, 1), (1, 2, 1), (2, 0, 1), (3, 4, 1), (4, 5, 1), (5, 3, 1), (2, 3, 1)]


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (3, 2), (9, 8), (7, 7), (None, 4), (2, 1)], "u long, v long")
    assert rows(connected_components(e), "id", "component") == [(1, 1), (2, 1), (3, 1), (8, 8), (9, 8)]
    assert connected_components(e.limit(0)).count() == 0


def test_component_of_a_long_chain(spark):
    e = spark.range(40).select(((F.col("id") * 17) % 41).alias("u"), (((F.col("id") + 1) * 17) % 41).alias("v"))
    assert {r["component"] for r in connected_components(e).collect()} == {0}


def test_bridges_and_articulation(spark):
    g = graph(spark, TRIANGLES)
    assert rows(analysis.bridges(g), "u", "v", "isolated") == [(2, 3, 3)]
    assert rows(analysis.articulation_points(g), "id") == [(2,), (3,)]


def test_cycle_has_no_bridge(spark):
    assert analysis.bridges(graph(spark, [(0, 1, 1), (1, 2, 1), (2, 3, 1), (3, 4, 1), (4, 0, 1)])).count() == 0


def test_strong_components(spark):
    g = graph(spark, [(0, 1, 1), (1, 2, 1), (2, 0, 1), (2, 3, 1), (3, 4, 1), (4, 3, 1), (4, 5, 1)], undirected=False)
    assert rows(analysis.strong_components(g), "id", "component") == [(0, 0), (1, 0), (2, 0), (3, 3), (4, 3), (5, 5)]


def test_spanning_tree(spark):
    t = analysis.spanning_tree(graph(spark, [(0, 1, 1), (1, 2, 1), (2, 3, 1), (3, 0, 5)]))
    assert rows(t, "u", "v", "w") == [(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0)]


def test_flow_and_cut(spark):
    diamond = graph(spark, [(0, 1, 3), (0, 2, 2), (1, 3, 2), (2, 3, 3)], undirected=False)
    assert analysis.max_flow(diamond, 0, 3)[0] == 4
    chain = graph(spark, [(0, 1, 10), (1, 2, 1), (2, 3, 10)], undirected=False)
    assert analysis.max_flow(chain, 0, 3)[0] == 1
    assert rows(analysis.min_cut(chain, 0, 3), "src", "dst") == [(1, 2)]
    assert analysis.max_flow(chain, 2, 2)[0] == 0


def test_betweenness_of_a_path(spark):
    b = dict(rows(analysis.betweenness(graph(spark, [(0, 1, 1), (1, 2, 1), (2, 3, 1), (3, 4, 1)])), "id", "score"))
    assert b == {0: 0.0, 1: 6.0, 2: 8.0, 3: 6.0, 4: 0.0}


def test_betweenness_query_of_the_whole_graph(spark):
    """The registered query against path counts by brute force, over every arc of the hierarchy."""
    from waygraph.plans import derive, queries

    sf = "/root/testdata/sf0.001"
    arcs = {}
    for u, v, w in derive.hierarchy(spark, sf).edges.select("src", "dst", "w").collect():
        arcs[u, v] = min(w, arcs.get((u, v), w))
    ids = sorted({x for a in arcs for x in a})
    out = {i: [] for i in ids}
    for (u, v), w in arcs.items():
        out[u].append((v, w))
    dist, count = {}, {}
    for s in ids:
        d, left = {s: 0.0}, {s}
        while left:  # relax until nothing changes
            left = {v for u in left for v, w in out[u] if d[u] + w < d.get(v, float("inf")) - 1e-12 and not d.update({v: d[u] + w})}
        n = {s: 1}
        for v in sorted(d, key=d.get)[1:]:
            n[v] = sum(n[u] for u in d if u in n and (u, v) in arcs and abs(d[u] + arcs[u, v] - d[v]) < 1e-9)
        dist[s], count[s] = d, n
    want = {
        v: sum(count[s][v] * count[v][t] / count[s][t] for s in ids for t in dist[s] if s != v != t != s and v in dist[s] and t in dist[v] and abs(dist[s][v] + dist[v][t] - dist[s][t]) < 1e-9)
        for v in ids
    }
    got = dict(rows(queries.QUERIES["betweenness"](spark, sf), "id", "score"))
    assert got.keys() == want.keys() and all(abs(got[v] - want[v]) < 1e-5 for v in ids)


def test_search_algorithms_agree(spark):
    arcs = [(u, v, 1 + (u * 7 + v * 3) % 5) for u in range(14) for v in ((u * 5 + 1) % 15, (u * 3 + 2) % 15) if u != v]
    g = graph(spark, arcs)
    want = rows(paths.costs(g, sources(spark, 0)), "id", "cost")
    assert rows(paths.dial(g, sources(spark, 0)), "id", "cost") == want
    assert rows(paths.bellman_ford(g, sources(spark, 0))[0], "id", "cost") == want
    assert rows(paths.johnson(g, sources(spark, 0)), "id", "cost") == want
    assert rows(paths.all_pairs(g).where("src = 0"), "dst", "cost") == want
    pairs = spark.createDataFrame([(i, 0, i) for i, _ in want], "qid int, src long, dst long")
    assert rows(paths.pair_costs(g, pairs), "qid", "cost") == want
    assert rows(paths.bidirectional_costs(g, pairs), "qid", "cost") == want
    assert rows(paths.least_paths(g, pairs), "qid", "cost") == want
    assert rows(paths.path_costs(g, paths.least_paths(g, pairs)), "qid", "cost") == want


def test_closure_detour(spark):
    g = graph(spark, [(0, 1, 1), (1, 2, 1), (0, 3, 5), (3, 2, 5)])
    pair = spark.createDataFrame([(0, 0, 2)], "qid int, src long, dst long")
    assert paths.pair_costs(g, pair).first()["cost"] == 2
    closed = g.close(spark.createDataFrame([(1, 0)], "u long, v long"))
    assert paths.pair_costs(closed, pair).first()["cost"] == 10


def test_dial_declines(spark):
    assert paths.dial(graph(spark, [(0, 1, 0.5)]), sources(spark, 0)) is None


def test_negative_cycles_decline(spark):
    g = graph(spark, [(0, 1, 1), (1, 2, -3), (2, 0, 1)], undirected=False)
    assert not paths.bellman_ford(g, sources(spark, 0))[1]
    assert paths.johnson(g, sources(spark, 0)) is None
    assert paths.all_pairs(g) is None


def test_k_shortest(spark):
    g = graph(spark, [(0, 1, 1), (1, 3, 1), (0, 2, 2), (2, 3, 2), (1, 2, 1), (0, 3, 9)])
    pair = spark.createDataFrame([(0, 0, 3)], "qid int, src long, dst long")
    found = [(r["rank"], r["cost"], r["path"]) for r in paths.k_shortest(g, pair, 4).orderBy("rank").collect()]
    assert found == [(1, 2.0, [0, 1, 3]), (2, 4.0, [0, 1, 2, 3]), (3, 4.0, [0, 2, 1, 3]), (4, 4.0, [0, 2, 3])]


def test_path_cost_of_what_is_no_path(spark):
    g = graph(spark, [(0, 1, 5), (0, 1, 2)])
    p = spark.createDataFrame([(0, [0, 1]), (1, [1, 7]), (2, []), (3, [0])], "qid int, path array<long>")
    assert rows(paths.path_costs(g, p), "qid", "cost")[0] == (0, 2.0)
    assert {r["qid"]: r["cost"] for r in paths.path_costs(g, p).collect()} == {0: 2.0, 1: None, 2: None, 3: 0.0}


def test_admissibility(spark):
    places = {0: (0.0, 0.0), 1: (3.0, 4.0)}
    ok = graph(spark, [(0, 1, 10)], places=places, space="planar").admissibility().first()
    assert (ok["min_ratio"], ok["shortfall"], ok["admissible"]) == (2.0, 0.0, True)
    assert graph(spark, [(0, 1, 2.5)], places=places, space="planar").admissibility().first()["shortfall"] == 2.5


def test_hull(spark):
    p = [(0, i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (4, 0), (4, 4), (0, 4), (2, 2), (2, 0)])]
    h = spatial.convex_hull(spark.createDataFrame(p, "g int, id long, x double, y double"), "g", parts=3)
    assert rows(h, "id") == [(0,), (1,), (2,), (3,)]


def test_grid_isochrone(spark):
    arcs = [(y * 15 + x, y * 15 + x + s, 1) for y in range(15) for x in range(15) for s, ok in ((1, x < 14), (15, y < 14)) if ok]
    reached = paths.costs(graph(spark, arcs), sources(spark, 0), max_cost=5.0)
    bands = dict(rows(spatial.isochrone(reached, [2, 5]).groupBy("cutoff").count(), "cutoff", "count"))
    assert bands == {2.0: 6, 5.0: 21}


@pytest.mark.parametrize("k", [1, 3])
def test_nearest_is_exact(spark, k):
    pts = [(i, ((i * 7919) % 101) / 7.0, ((i * 104729) % 97) / 50.0) for i in range(60)]
    qs = [(i, ((i * 31) % 50) / 3.0 - 2, ((i * 17) % 40) / 9.0 - 1) for i in range(12)] + [(99, 500.0, -300.0)]
    got = spatial.k_nearest(spark.createDataFrame(qs, "qid int, qx double, qy double"), spark.createDataFrame(pts, "id long, x double, y double"), k)
    want = sorted((q, i) for q, qx, qy in qs for _, i in sorted(((x - qx) ** 2 + (y - qy) ** 2, i) for i, x, y in pts)[:k])
    assert rows(got, "qid", "id") == want


def test_directions(spark):
    nodes = spark.createDataFrame([(i, float(i), 0.0) for i in range(5)] + [(10, 0.0, 1.0), (11, 1.0, 1.0), (12, -1.0, 1.0)], "id long, x double, y double")
    p = spark.createDataFrame([(0, [0, 1, 2, 3, 4]), (1, [0, 10, 11]), (2, [0, 10, 12]), (3, [0])], "qid int, path array<long>")
    steps = directions.build_directions(p, nodes).orderBy("qid", "step").collect()
    assert [(s["qid"], s["maneuver"], s["distance"]) for s in steps] == [
        (0, "depart", 4.0), (0, "arrive", 0.0),
        (1, "depart", 1.0), (1, "right", 1.0), (1, "arrive", 0.0),
        (2, "depart", 1.0), (2, "left", 1.0), (2, "arrive", 0.0),
    ]


def test_no_later_start_arrives_earlier(spark):
    times = spark.range(0, 288).select((F.col("id") * 300.0).alias("t"))
    for tier in (0, 4):
        got = [r[0] for r in times.orderBy("t").select(timedep.arrival(F.lit(3000.0), F.lit(tier), F.col("t"))).collect()]
        assert got == sorted(got)
    free = times.select(timedep.travel_time(F.lit(111.0), F.lit(0), F.col("t")).alias("s")).distinct().collect()
    assert [r["s"] for r in free] == [10.0]


def test_transit(spark):
    st = spark.createDataFrame([(1, "A", "Metro", "Mumbai", 19.0, 72.8), (2, "B", "metro", "Mumbai", 19.01, 72.8), (3, "C", "Rail", "Navi Mumbai", 19.02, 72.8)], "id long, name string, system string, city string, lat double, lon double")
    lk = spark.createDataFrame([(1, 2, "x", 120.0), (2, 3, "x", 120.0), (3, 9, "x", 1.0)], "`from` long, to long, line string, seconds double")
    good, bad = transit.check_links(st, lk)
    assert good.count() == 2 and rows(bad, "to") == [(9,)]
    assert transit.filter_network(st, good, "mumbai")[0].count() == 2
    assert transit.filter_network(st, good, "ETR")[0].count() == 2
    rail = transit.rail_only(st, good)
    pair = spark.createDataFrame([(0, transit.STATION_BASE + 1, transit.STATION_BASE + 3)], "qid int, src long, dst long")
    assert rail.edges.count() == 4 and paths.pair_costs(rail, pair).first()["cost"] == 240.0


def test_transit_links_the_nearest_in_metres(spark):
    """Of stations without nodes in the radius, against all distances; at 60 degrees east is nearer than north."""
    import math
    import random

    r = random.Random(4)
    places = [(10.0, 60.010 + k / 1000) for k in range(8)] + [(10.018, 60.0)] + [(r.uniform(9, 12), r.uniform(58, 61)) for _ in range(40)]
    stations = [(0, 10.0, 60.0), (1, 30.0, 65.0), (2, 10.0, 20.0)] + [(3 + k, r.uniform(9, 12), r.uniform(58, 61)) for k in range(20)]
    nodes = spark.createDataFrame([(k, *p) for k, p in enumerate(places)], "id long, x double, y double")
    road = Graph(nodes, spark.createDataFrame([], "src long, dst long, w double"), "geographic")
    st = spark.createDataFrame([(i, f"s{i}", x, y) for i, x, y in stations], "id long, name string, lon double, lat double")
    lk = spark.createDataFrame([], "`from` long, `to` long, seconds double")
    got = {(s, d) for s, d in rows(transit.combine(road, st, lk).edges.where(f"dst >= {transit.STATION_BASE}"), "src", "dst")}

    def metres(a, b):
        return math.hypot(math.radians(a[0] - b[0]) * math.cos(math.radians((a[1] + b[1]) / 2)), math.radians(a[1] - b[1])) * 6371008.8

    want = set()
    for i, *at in stations:
        d = sorted((metres(at, p), k) for k, p in enumerate(places))
        near = [x for x in d if x[0] <= transit.RADIUS][: transit.TRANSFERS] or d[:1]
        want |= {(k, i + transit.STATION_BASE) for _, k in near}
    assert (8, transit.STATION_BASE) in want and got == want


@pytest.mark.parametrize("radius", [900.0, 250_000.0, 4_000_000.0])
def test_within_around_the_globe(spark, radius):
    """Against all pairs, also across the date line and at the poles."""
    import math
    import random

    r = random.Random(4)
    span = radius / 111_000
    places = []
    for lat, lon in [(0, 179.9999), (60, -180), (89.9999, 10), (-90, 0), (45, 7), (-66, 180)]:
        for _ in range(14):
            y = max(-90.0, min(90.0, lat + r.uniform(-span, span)))
            x = lon + r.uniform(-span, span) / max(0.02, math.cos(math.radians(y)))
            places.append((len(places), (x + 180) % 360 - 180, y))
    places.append((len(places), 180.0, 0.0))

    def metres(a, b):
        p, q = math.radians(a[2]), math.radians(b[2])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return 2 * 6_371_008.8 * math.asin(math.sqrt(min(1.0, h)))

    nodes = spark.createDataFrame(places, "id long, x double, y double")
    got = {(a["qid"], a["id"]) for a in spatial.within(nodes.toDF("qid", "qx", "qy"), nodes, radius, "geographic").collect()}
    near = {(a[0], b[0]): metres(a, b) for a in places for b in places}
    assert {k for k, m in near.items() if m <= radius - 1e-3} <= got <= {k for k, m in near.items() if m <= radius + 1e-3}
    assert len(got) > len(places)
