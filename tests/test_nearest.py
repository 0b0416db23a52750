"""Nearest neighbours by k-d cells against all distances, with ties, outliers, hot places and few points."""

import math
import random
import time

import pytest

from waygraph.operators.nearest import k_nearest, kd_cells

POINT, QUERY = "id long, x double, y double", "qid long, qx double, qy double"


def brute(queries, points, k, skip):
    out = set()
    for q, qx, qy in queries:
        if qx is None:
            continue
        near = sorted((math.sqrt((x - qx) ** 2 + (y - qy) ** 2), i) for i, x, y in points if x is not None and not (skip and i == q))
        out |= {(q, i, round(d, 9)) for d, i in near[:k]}
    return out


@pytest.mark.parametrize("k,skip", [(1, False), (4, True)])
def test_against_all_distances(spark, k, skip):
    rng = random.Random(k)
    points = [(i, rng.gauss(0, 1), rng.gauss(0, 0.01)) for i in range(300)]
    points += [(300 + i, 5.0 + i % 6, float(i // 6)) for i in range(36)]  # a lattice: ties
    points += [(400 + i, 2.0, 2.0) for i in range(200)] + [(700, 1e6, -1e6), (701, None, 1.0)]
    queries = [(i, x, y) for i, x, y in points[::3]] + [(900, 7.5, 2.5), (901, 1e7, 0.0), (902, None, None)]
    got = k_nearest(spark.createDataFrame(queries, QUERY), spark.createDataFrame(points, POINT), k, skip, leaf=8)
    assert {(r["qid"], r["id"], round(r["dist"], 9)) for r in got.collect()} == brute(queries, points, k, skip)


def test_few_or_no_points(spark):
    q = spark.createDataFrame([(1, 0.0, 0.0), (2, 3.0, 4.0)], QUERY)
    assert not k_nearest(q, spark.createDataFrame([], POINT)).collect()
    two = spark.createDataFrame([(1, 0.0, 0.0), (5, 0.0, 0.0)], POINT)
    assert sorted(tuple(r) for r in k_nearest(q, two, 3).collect()) == [(1, 1, 0.0), (1, 5, 0.0), (2, 1, 5.0), (2, 5, 5.0)]
    assert sorted(tuple(r) for r in k_nearest(q, two, 3, skip_self=True).collect()) == [(1, 5, 0.0), (2, 1, 5.0), (2, 5, 5.0)]


def test_an_outlier_gets_a_cell_of_its_own(spark):
    rng = random.Random(1)
    took = []
    for n in (2_000, 16_000):
        rows = [(i, rng.random(), rng.random()) for i in range(n)] + [(n, 1e6, 1e6)]
        p = spark.createDataFrame(rows, POINT).repartition(3)
        _, boxes, _ = kd_cells(p)
        assert boxes.where("is_leaf").agg({"n": "max"}).first()[0] <= 128
        began = time.time()
        assert k_nearest(p.toDF("qid", "qx", "qy"), p, 1, skip_self=True).count() == n + 1
        took.append(time.time() - began)
    assert took[1] < 6 * took[0] + 5  # eight times the points; all pairs would be 64 times the work


def test_queries_at_one_place_are_looked_for_once(spark, monkeypatch):
    from waygraph.operators import nearest

    rng, tables = random.Random(5), {}
    places = [(rng.random(), rng.random()) for _ in range(40)]
    points = [(i, *places[i % 40]) for i in range(2_000)]

    def recorded(df, name="step"):
        tables[name] = materialise(df, name)
        return tables[name]

    materialise = nearest.materialise
    monkeypatch.setattr(nearest, "materialise", recorded)
    got = k_nearest(spark.createDataFrame(points, QUERY), spark.createDataFrame(points, POINT), 4, True, leaf=8)
    assert {(r["qid"], r["id"], round(r["dist"], 9)) for r in got.collect()} == brute(points, points, 4, True)
    assert tables["reached"].count() <= 40 * 16  # a row for each place and cell, not for each query
