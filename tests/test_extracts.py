"""Transit files as text, holes between tiles, edge buffers, tiers of equal weights."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from waygraph.operators import extract, timedep
from waygraph.sources import csv, sinks
from waygraph.tables import Graph


def lines(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "line long, text string")


def test_transit_text(spark):
    stations = lines(spark, "id,name,system,city,lat,lon", '1,"A, ""old"" town",M,C,1.5,2.5', "2,B,M,C,1,2", " ")
    found, links = csv.read_transit_lines(stations, lines(spark, "from,to,line,seconds", "1,2,Red,60"))
    assert [tuple(r) for r in found.orderBy("id").collect()] == [(1, 'A, "old" town', "M", "C", 1.5, 2.5), (2, "B", "M", "C", 1.0, 2.0)]
    assert [tuple(r) for r in links.collect()] == [(1, 2, "Red", 60.0)]
    with pytest.raises(csv.InputError):
        csv.read_transit_lines(stations, lines(spark, "from,to,line,seconds", "1,7,Red,60"))


def test_empty_tiles(spark):
    elements = spark.createDataFrame([("node", 1, 1, "a"), ("node", 1, 2, "b"), ("way", 1, 2, "c")], "type string, id long, tile int, tag string")
    asked = spark.createDataFrame([(1,), (2,), (3,)], "tile int")
    assert [r["tile"] for r in extract.empty_tiles(asked, elements).collect()] == [3]
    with pytest.raises(ValueError, match="the first is 3"):
        extract.merge_tiles(elements, asked)
    assert extract.merge_tiles(elements, asked.where("tile < 3")).count() == 2


def test_edge_buffers(spark):
    nodes = spark.createDataFrame([(30, 0.0, 0.0), (10, 1.0, 1.0), (20, 2.0, 2.0)], "id long, x double, y double")
    edges = spark.createDataFrame([(30, 10, 1.0), (10, 20, 1.0), (20, 30, 1.0)], "src long, dst long, w double")
    runs = sinks.edge_buffers(Graph(nodes, edges)).orderBy("first").collect()
    assert sum(r["n"] for r in runs) == 3
    assert np.concatenate([np.frombuffer(bytes(r["uv"]), "<i4") for r in runs]).reshape(-1, 2).tolist() == [[0, 1], [1, 2], [2, 0]]


def test_tiers_of_equal_weights_go_by_id(spark):
    n = 4_000
    edges = spark.range(n).select(F.col("id").alias("eid"), F.lit(1.0).alias("w")).repartition(4)
    got = {r["eid"]: r["tier"] for r in timedep.congestion_tiers(edges).collect()}
    moved = lambda e: ((e % 2147483647) * 1103515245 + timedep.SEED) // 65536 % 3 - 1
    assert got == {e: max(0, min(4, e * 5 // n + moved(e))) for e in range(n)}
