"""Readers, sinks, indices, the registry and live closures on small graphs."""

import json
import struct

import pytest
from pyspark.sql import functions as F

import waygraph
from waygraph.functions.order import running_total
from waygraph.operators import harness, index, paths, transit
from waygraph.sources import csv, sinks
from waygraph.streaming.closures import follow_closures


def small(spark, space=False):
    return csv.from_rows(spark, [(k, float(k % 3), float(k // 3)) for k in range(7)], [(0, 1, 5), (1, 0, 5), (1, 2, 5), (2, 1, 5), (0, 2, 12), (2, 0, 12), (2, 3, 1), (3, 2, 1), (3, 4, 2), (4, 5, 2), (2, 5, 9), (5, 2, 9)], space)


def test_public_names(spark):
    assert all(getattr(waygraph, n) is not None for n in waygraph.__all__)
    with pytest.raises(AttributeError):
        waygraph.no_such_name


def test_running_total(spark):
    df = spark.createDataFrame([(k * 37 % 101, k) for k in range(101)], "o int, v long").repartition(5)
    got = running_total(df, "o", F.col("v")).orderBy("o").collect()
    total = 0
    for r in got:
        assert r["before"] == total
        total += r["v"]
    assert len(got) == 101
    assert running_total(df.limit(0), "o", F.col("v")).count() == 0


def test_files_of_several_parts(spark, tmp_path):
    """Headers of every file are skipped, numbers run on, and the first of equal nodes stands."""
    (tmp_path / "nodes.csv").mkdir()
    (tmp_path / "nodes.csv" / "a.csv").write_text("id,x,y\n1,0,0\n2,1,0\n")
    (tmp_path / "nodes.csv" / "b.csv").write_text("id,x,y\n2,9,9\nx,1,1\n3,2,0\n")
    (tmp_path / "edges.csv").write_text("u,v,w\n1,2,3.5\n2,3\n3,777,1\n1,2,-5\n1,2,oops\n")
    graph, warnings = csv.read_graph_dir(spark, str(tmp_path))
    assert sorted(tuple(r) for r in graph.nodes.collect()) == [(1, 0.0, 0.0), (2, 1.0, 0.0), (3, 2.0, 0.0)]
    assert [tuple(r) for r in sinks.edge_list(graph).collect()] == [(1, 2, 3.5), (2, 3, 1.0)]
    assert {(r["file"], r["line"], r["reason"]) for r in warnings.collect()} == {("nodes", 6, "bad id"), ("edges", 4, "unknown node 777"), ("edges", 5, "negative weight"), ("edges", 6, "bad w")}
    with pytest.raises(csv.InputError, match="nodes:6"):
        csv.read_graph_dir(spark, str(tmp_path), lenient=False)


def test_transit_files(spark, tmp_path):
    (tmp_path / "stations.csv").write_text('id,name,system,city,lat,lon\n1,"A, ""x""",M,C,13.0,77.0\n2,B,M,C,13.1,77.0\n3,b,N,D,13.2,77.0\n')
    (tmp_path / "links.csv").write_text("from,to,line,seconds\n1,2,L,120\n2,3,L,0\n")
    stations, links = csv.read_transit(spark, str(tmp_path))
    assert stations.where("id = 1").first()["name"] == 'A, "x"'
    assert transit.resolve_station(stations, "B").first()["id"] == 2 and transit.resolve_station(stations, "3").first()["id"] == 3
    rail = transit.rail_only(stations, links)
    assert sorted(r["w"] for r in rail.edges.collect()) == [60.0, 60.0, 120.0, 120.0]
    walk = spark.createDataFrame([(0, [5, transit.STATION_BASE + 1])], "qid int, path array<long>")
    assert [tuple(r) for r in transit.journey(walk, stations).orderBy("k").collect()] == [(0, 0, "road", None), (0, 1, "rail", 'A, "x"')]
    (tmp_path / "links.csv").write_text("from,to,line,seconds\n1,9,L,120\n")
    with pytest.raises(csv.InputError):
        csv.read_transit(spark, str(tmp_path))[1].count()


def test_written_network(spark, tmp_path):
    g = small(spark)
    sinks.write_network(g, str(tmp_path / "net"), "tiny", country="none")
    again = spark.read.option("header", True).csv(str(tmp_path / "net" / "edges"))
    assert again.count() == 12 and again.columns == ["src", "dst", "w"]
    manifest = spark.read.json(str(tmp_path / "net" / "manifest")).first()
    assert (manifest["name"], manifest["nodes"], manifest["edges"]) == ("tiny", 7, 12)
    buffers = sinks.geometry_buffers(g).orderBy("first").collect()
    assert [x for b in buffers for x in struct.iter_unpack("<dd", bytes(b["xy"]))] == [(float(k % 3), float(k // 3)) for k in range(7)]
    assert [tuple(r)[1:] for r in sinks.coordinates(g).collect()][:2] == [(0.0, 0.0), (1.0, 0.0)]


def test_json_numbers(spark):
    df = spark.createDataFrame([(1 / 3,), (float("nan"),), (float("inf"),), (None,), (-1.5e300,), (0.0,)], "x double")
    got = [json.loads(r[0])["x"] for r in df.select(F.to_json(F.struct(sinks.json_number(F.col("x")).alias("x")), sinks.NULLS)).collect()]
    assert got == [0.3333333333, None, None, None, -1.5e300, 0.0]


def test_indices_and_registry(spark):
    """Every registered algorithm gives the same costs where it claims the best."""
    g = small(spark)
    pairs = spark.createDataFrame([(0, 0, 5), (1, 5, 0), (2, 4, 0), (3, 1, 1), (4, 6, 0)], "qid int, src long, dst long")
    want = [(0, 15.0), (1, 19.0), (2, 21.0), (3, 0.0), (4, None)]
    for built in (index.Contraction.build(g), index.Contraction.build(g, max_rounds=1), index.Hierarchy.build(g).customise(), index.Landmarks.build(g, 2)):
        assert sorted(tuple(r) for r in built.pair_costs(pairs).collect()) == want
    got = harness.race(g, pairs, [k for k in harness.REGISTRY if k not in ("alt", "ch", "cch") and not harness.REGISTRY[k].needs_places]).collect()
    assert {r["verdict"] for r in got if r["algorithm"] != "bfs"} == {"optimal", "no path"}
    assert {r["qid"]: r["cost"] for r in got if r["algorithm"] == "bfs"} == {0: 21.0, 1: 21.0, 2: 23.0, 3: 0.0, 4: None}
    closed = spark.createDataFrame([(0, 1)], "u long, v long")
    assert harness.route(g, pairs.where("qid = 0"), "ch", closed).first()["cost"] == 17.0
    assert {r["mismatches"] for r in harness.verify(g, 4, keys=["dijkstra", "bidijkstra", "dial"]).collect()} == {0}
    b = index.Landmarks.build(g, 2).lower_bounds(spark.createDataFrame([(0, 5), (1, 1)], "v long, t long")).collect()
    assert all(0 <= r["bound"] <= 15.0 for r in b)


def test_fewest_hops(spark):
    g = small(spark)
    pairs = spark.createDataFrame([(0, 0, 2), (1, 0, 5), (2, 6, 1)], "qid int, src long, dst long")
    assert sorted(tuple(r) for r in paths.fewest_hops(g, pairs).collect()) == [(0, 12.0), (1, 21.0), (2, None)]


def test_live_closures(spark, tmp_path):
    """Closures survive a restart from the checkpoint."""
    g = small(spark)
    pairs = spark.createDataFrame([(0, 0, 2)], "qid int, src long, dst long")
    feed, seen = tmp_path / "feed", {}
    feed.mkdir()
    put = lambda df, n: seen.update({n: df.first()["cost"]})
    stream = lambda: spark.readStream.schema("u long, v long, closed boolean, at long").json(str(feed))
    for k, line in enumerate(['{"u":1,"v":0,"closed":true,"at":1}', '{"u":5,"v":2,"closed":true,"at":2}', '{"u":0,"v":1,"closed":false,"at":3}']):
        (feed / f"{k}.json").write_text(line)
        follow_closures(stream(), g, pairs, put, str(tmp_path / "check")).awaitTermination()
    assert seen == {0: 12.0, 1: 12.0, 2: 10.0}
