"""The SQL surface against searches."""

import heapq
import math
import random

import pytest

from waygraph.surface import publish, publish_places
from waygraph.tables import Graph


def least(arcs, a):
    out, heap = {}, [(0.0, a)]
    while heap:
        d, u = heapq.heappop(heap)
        if u not in out:
            out[u] = d
            for s, t, w in arcs:
                if s == u:
                    heapq.heappush(heap, (d + w, t))
    return out


@pytest.fixture(scope="module")
def town(spark):
    rng = random.Random(3)
    places = [(n, float(rng.randrange(20)), float(rng.randrange(20))) for n in range(18)]
    arcs = [(rng.randrange(18), rng.randrange(18), float(rng.randrange(1, 9))) for _ in range(30)]
    g = Graph(spark.createDataFrame(places, "id long, x double, y double"), spark.createDataFrame(arcs, "src long, dst long, w double"), "planar")
    publish(g, "town")
    return places, arcs


def test_routes_and_isochrones(spark, town):
    _, arcs = town
    for a in (0, 5):
        want = least(arcs, a)
        got = spark.sql(f"SELECT id, cost FROM town_isochrone({a}, 9.0D)").collect()
        assert {r["id"]: r["cost"] for r in got} == {n: d for n, d in want.items() if d <= 9}
    asked = [(q, q, (q * 7 + 2) % 18) for q in range(6)] + [(9, 4, 777)]
    spark.createDataFrame(asked, "qid int, a long, b long").createOrReplaceTempView("asked")
    joined = (
        "SELECT q.qid, min(f.cost + t.cost) AS cost FROM asked q LEFT JOIN town_from f ON f.id = q.a "
        "LEFT JOIN town_to t ON t.hub = f.hub AND t.id = q.b GROUP BY q.qid"
    )
    single = {q: spark.sql(f"SELECT cost FROM town_route({a}, {b})").first()["cost"] for q, a, b in asked}
    got = {r["qid"]: r["cost"] for r in spark.sql(joined).collect()}
    assert got == single
    assert got == {q: least(arcs, a).get(b) for q, a, b in asked}


def test_places(spark, town):
    places, _ = town
    near = spark.sql("SELECT id, dist FROM town_nearest(3.0D, 4.0D, 20.0D)").collect()
    best = min((math.dist((x, y), (3.0, 4.0)), n) for n, x, y in places)
    assert [(r["dist"], r["id"]) for r in near] == [best]
    for px, py in [(3.0, 4.0), (15.0, 9.0), (900.0, 900.0)]:
        got = {r["id"] for r in spark.sql(f"SELECT id FROM town_around({px}D, {py}D, 6.0D)").collect()}
        assert got == {n for n, x, y in places if math.dist((x, y), (px, py)) <= 6}


def test_around_the_globe(spark):
    spots = [(0, 179.99, 10.0), (1, -179.99, 10.0), (2, 0.0, 89.99), (3, 180.0, 89.99), (4, 10.0, 60.0), (5, 10.02, 60.0)]
    g = Graph(spark.createDataFrame(spots, "id long, x double, y double"), spark.createDataFrame([], "src long, dst long, w double"), "geographic")
    publish_places(g, "globe")
    ids = lambda x, y, r: {row["id"] for row in spark.sql(f"SELECT id FROM globe_around({x}D, {y}D, {r}D)").collect()}
    assert ids(179.99, 10.0, 3000) == {0, 1}
    assert ids(0.0, 89.99, 3000) == {2, 3}
    assert ids(10.0, 60.0, 1000) == {4}
    assert ids(10.0, 60.0, 1200) == {4, 5}


def test_names_are_checked(spark):
    with pytest.raises(ValueError):
        publish(Graph(None, None), "a; DROP TABLE b")
