"""Steps that many queries share: what they read once, and how much of it one task holds."""

import pytest
from pyspark.sql import functions as F

from waygraph.operators import etl, paths, timedep, trace, transit
from waygraph.plans import derive
from waygraph.tables import Graph

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("w", ["CAST(id * id % 7 AS double)", "2.0D", "CAST(id * 7919 % 1003 AS double)", "CASE id % 3 WHEN 0 THEN NULL WHEN 1 THEN double('NaN') ELSE id % 4 END"])
@pytest.mark.parametrize("many", [0, 1, 3, 4, 203])
def test_tiers_without_an_order_of_all_edges(spark, w, many):
    edges = spark.range(many).selectExpr("id * 7 AS eid", f"{w} AS w")
    found = timedep.congestion_tiers(edges)
    assert "Window" not in plan(found)
    rows = edges.collect()
    key = lambda r: (r["w"] is not None, r["w"] != r["w"], r["w"] if r["w"] is not None and r["w"] == r["w"] else 0, r["eid"])
    want = {}
    for k, r in enumerate(sorted(rows, key=key)):
        jitter = ((r["eid"] % 2147483647) * 1103515245 + timedep.SEED) // 65536 % 3 - 1
        want[r["eid"]] = max(0, min(4, k * 5 // many + jitter))
    assert {r["eid"]: r["tier"] for r in found.collect()} == want


def test_hops_do_not_group_the_edges(spark, monkeypatch):
    edges = spark.createDataFrame([(1, 2, 1.0), (1, 2, 1.0), (2, 3, 1.0), (1, 3, 5.0), (1, 3, 4.0)], "src long, dst long, w double")
    graph, seen, loop = Graph(edges.selectExpr("src AS id").distinct(), edges), [], paths._loop
    monkeypatch.setattr(paths, "_loop", lambda e, *a, **b: (seen.append(plan(e)), loop(e, *a, **b))[1])
    events = trace.bfs_trace(graph, spark.createDataFrame([(0, 1)], "qid int, id long"))
    got = {tuple(r) for r in events.select("step", "op", "node", "parent").collect()}
    assert got == {(0, 0, 1, None), (1, 1, 1, None), (1, 0, 2, 1), (2, 1, 2, 1), (1, 0, 3, 1), (2, 1, 3, 1)}
    assert "Aggregate" not in seen[0] and "Aggregate" not in plan(events)


def test_pairs_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(derive, "DEALT", 100)
    graph = derive.supplier_part(spark, SF)
    rows = derive.table(spark, SF, "lineitem")
    assert graph.edges.rdd.getNumPartitions() > rows.count() // 100
    want = {(r[0] + 10_000_000, r[1]): r[2] for r in rows.groupBy("l_suppkey", "l_partkey").agg(F.min("l_quantity")).collect()}
    got = {(r["src"], r["dst"]): r["w"] for r in graph.edges.collect()}
    assert got == want | {(b, a): w for (a, b), w in want.items()}
    assert {r["id"] for r in graph.nodes.collect()} == {x for p in want for x in p}


def test_trade_is_joined_once(spark):
    graph = derive.nation_trade(spark, SF)
    assert "Join" not in plan(graph.edges) and "Join" not in plan(graph.nodes)


def test_lattice_is_dealt_before_its_arcs_are_grouped(spark):
    arcs = derive.part_lattice(spark, SF).edges
    text = arcs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text and "BroadcastHashJoin" not in text and "Union" not in text


def test_path_costs_never_broadcast_the_graph(spark):
    asked = spark.createDataFrame([(0, [0, 1, 26]), (1, [5]), (2, [3, 90])], "qid int, path array<long>")
    found = paths.path_costs(derive.part_lattice(spark, SF), asked)
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [src" in text and "Broadcast" not in text.split("SortMergeJoin [src")[1]
    size = {r[0]: float(r[1]) for r in derive.table(spark, SF, "part").select("p_partkey", "p_size").collect()}
    assert {r["qid"]: r["cost"] for r in found.collect()} == {0: size[0] + size[1], 1: 0.0, 2: None}


@pytest.mark.parametrize("bucket", [2, 10_000])
def test_platforms_are_clustered_by_buckets_of_groups(spark, monkeypatch, bucket):
    monkeypatch.setattr(etl, "BUCKET", bucket)
    # along a meridian, some 111 metres a step; of a group's platforms the first that is left heads a cluster
    rows = [(k, name, city, 13 + 0.001 * step, 77.0) for k, (name, city, step) in enumerate([
        ("A", "x", 0), ("a.", "x", 3), ("A", "x", 5), ("A", "x", 8), ("A", "y", 0), (None, "x", 0), (None, "x", 1), (None, None, 0), (None, None, 2), ("A", None, 0), ("B", "x", 0), ("A", "x", 4)])]
    found = etl.merge_platforms(spark.createDataFrame([*rows, (12, "A", "x", None, 77.0)], "id long, name string, city string, lat double, lon double"))
    assert {r["id"]: r["canonical"] for r in found.collect()} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 5, 6: 5, 7: 7, 8: 7, 9: 9, 10: 10, 11: 2, 12: 12}


def test_stations_at_one_place_are_looked_up_once(spark, monkeypatch):
    many, write = [], transit.materialise
    monkeypatch.setattr(transit, "materialise", lambda df, name="step": (lambda t: (name == "near" and many.append(t.count()), t)[1])(write(df, name)))
    nodes = spark.createDataFrame([(k, 77.0 + 0.0001 * k, 13.0) for k in range(6)] + [(9, 78.0, 13.0)], "id long, x double, y double")
    road = Graph(nodes, spark.createDataFrame([], "src long, dst long, w double"), "geographic")
    rows = [(k, "s", "y", "c", 13.0, 77.0) for k in range(50)] + [(50, "s", "y", "c", 13.0, 78.2), (51, "s", "y", "c", 13.0, 78.2), (52, "s", "y", "c", None, 77.0)]
    links = spark.createDataFrame([], "from long, to long, line string, seconds double")
    both = transit.combine(road, spark.createDataFrame(rows, "id long, name string, system string, city string, lat double, lon double"), links)
    got = {(r["dst"] - transit.STATION_BASE, r["src"]) for r in both.edges.where(F.col("dst") >= transit.STATION_BASE).collect()}
    back = {(r["src"] - transit.STATION_BASE, r["dst"]) for r in both.edges.where(F.col("src") >= transit.STATION_BASE).collect()}
    assert got == back == {(k, n) for k in range(50) for n in range(4)} | {(50, 9), (51, 9)}
    assert many == [6]


def test_places_are_looked_up_before_the_rounds(spark, monkeypatch):
    """However small the file of nodes is, it is not broadcast whole, and rounds don't read it."""
    from waygraph.loop import materialise

    g = derive.part_lattice(spark, SF)
    g = Graph(materialise(g.nodes, "allnodes"), materialise(g.edges, "edges"), g.space)
    pairs = spark.createDataFrame([(0, 0, 60), (1, 3, 3), (2, 5, -1), (3, -1, 5)], "qid int, src long, dst long")
    rounds, loop, dealt = [], paths._loop, []
    monkeypatch.setattr(paths, "_loop", lambda e, *a, **b: (dealt.append(e._jdf.queryExecution().executedPlan().toString()), loop(e, *a, **b))[1])
    monkeypatch.setattr(paths, "materialise", lambda df, name="step": (name == "labels" and rounds.append(df.inputFiles()), materialise(df, name))[1])
    got = {r["qid"]: r["cost"] for r in paths.pair_costs(g, pairs, goal_directed=True).collect()}
    assert len(rounds) > 2 and not [f for files in rounds[1:] for f in files if "allnodes" in f]
    assert "Broadcast" not in dealt[0]
    assert got[1] == 0.0 and got[2] is None and got[3] is None
    assert got == {r["qid"]: r["cost"] for r in paths.pair_costs(g, pairs).collect()}


def test_goal_directed_labels_hold_where_weights_or_places_are_missing(spark):
    nodes = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 0.0), (2, None, None), (3, 3.0, 0.0)], "id long, x double, y double")
    edges = spark.createDataFrame([(0, 1, None), (0, 1, 2.0), (0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0), (1, 7, 1.0), (7, 3, 5.0), (3, 9, None)], "src long, dst long, w double")
    pairs = spark.createDataFrame([(0, 0, 3), (1, 0, 7), (2, 0, 9)], "qid int, src long, dst long")
    found = paths.pair_costs(Graph(nodes, edges, "planar"), pairs, goal_directed=True, max_rounds=50)
    assert {r["qid"]: r["cost"] for r in found.collect()} == {0: 3.0, 1: 2.0, 2: None}
