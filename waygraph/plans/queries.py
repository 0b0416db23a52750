"""The registered queries over the derived graphs, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waygraph.functions import geo
from waygraph.loop import materialise, release
from waygraph.operators import analysis, directions, etl, greedy, harness, index, paths, spatial, timedep, trace, transit, trees
from waygraph.plans import derive
from waygraph.plans import oracles as o
from waygraph.sources import csv as sources
from waygraph.surface import publish, publish_places
from waygraph.tables import Graph

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def kept(graph: Graph) -> Graph:
    """The graph with its edges written once, as loops read them again and again."""
    return Graph(materialise(graph.nodes, "nodes"), materialise(graph.edges, "edges"), graph.space)


def one(spark: SparkSession, *ids: int) -> DataFrame:
    return spark.createDataFrame([(0, i) for i in ids], "qid int, id long")


#: 20 pairs over the lattice that exist at every size.
PAIRS = [(q, (q * 37) % 200, (q * 53 + 91) % 200) for q in range(20)]
PAIRS_SQL = "pairs(q, a, b) AS (VALUES " + ", ".join(f"({q}, {a}::BIGINT, {b}::BIGINT)" for q, a, b in PAIRS) + ")"


def lattice_pairs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PAIRS, "qid int, src long, dst long")


@query(f"WITH {o.SUPPLIER_PART} SELECT (SELECT count(*) FROM (SELECT s FROM e UNION SELECT t FROM e)) AS nodes, count(*) AS edges, "
       "coalesce(min(w) FILTER (WHERE w > 0), 1.0) AS min_w, (SELECT max(n) FROM (SELECT count(*) AS n FROM e GROUP BY s)) AS max_degree FROM e")  # fmt: skip
def graph_stats(spark, sf):
    return derive.supplier_part(spark, sf).stats()


@query(f"WITH RECURSIVE {o.SUPPLIER_PART}, r(id, hops) USING KEY (id) AS (SELECT 10000001::BIGINT, 0 UNION (SELECT e.t, min(r.hops + 1) FROM r JOIN e ON e.s = r.id "
       "LEFT JOIN recurring.r p ON p.id = e.t WHERE p.id IS NULL GROUP BY e.t)) SELECT id, CAST(hops AS INTEGER) AS hops FROM r")  # fmt: skip
def bfs_hops(spark, sf):
    return paths.hops(kept(derive.supplier_part(spark, sf)), one(spark, 10_000_001)).drop("qid")


@query(o.sssp(o.SUPPLIER_PART, "SELECT 0, 10000001::BIGINT, 0.0::DOUBLE", "SELECT id, d AS cost FROM r"))
def dijkstra_sssp(spark, sf):
    return paths.costs(kept(derive.supplier_part(spark, sf)), one(spark, 10_000_001)).drop("qid")


@query(o.sssp(o.SUPPLIER_PART, "SELECT 0, 10000001::BIGINT, 0.0::DOUBLE", "SELECT id, d AS cost FROM r"))
def dial_sssp(spark, sf):
    return paths.dial(kept(derive.supplier_part(spark, sf)), one(spark, 10_000_001)).drop("qid")


@query(f"WITH {o.NATION_TRADE} SELECT coalesce(bool_or(abs(w - round(w)) > 1e-9), false) AS declined, "
       "CASE WHEN bool_or(abs(w - round(w)) > 1e-9) THEN 'weights are not integers' ELSE '' END AS reason FROM e")  # fmt: skip
def dial_declines(spark, sf):
    return paths.dial_declines(derive.nation_trade(spark, sf))


def _accounts(spark: SparkSession, sf: str) -> Graph:
    """Region to nation to supplier, one way; a supplier's arc has its balance as weight, which may be negative."""
    nation = derive.table(spark, sf, "nation").selectExpr("CAST(n_regionkey AS bigint) AS src", "CAST(n_nationkey AS bigint) + 1000 AS dst", "1.0D AS w")
    leaf = derive.table(spark, sf, "supplier").selectExpr("CAST(s_nationkey AS bigint) + 1000 AS src", "s_suppkey + 1000000 AS dst", "s_acctbal AS w")
    edges = nation.unionAll(leaf)
    ids = edges.select(F.col("src").alias("id")).unionAll(edges.select(F.col("dst").alias("id"))).distinct()
    return Graph(ids.selectExpr("id", *derive.NO_PLACE), edges)


ACCOUNTS = """e AS (SELECT CAST(n_regionkey AS BIGINT) AS s, CAST(n_nationkey AS BIGINT) + 1000 AS t, 1.0::DOUBLE AS w FROM nation
 UNION ALL SELECT CAST(s_nationkey AS BIGINT) + 1000, s_suppkey + 1000000, s_acctbal FROM supplier)"""


@query(o.sssp(ACCOUNTS, "SELECT 0, 0::BIGINT, 0.0::DOUBLE", "SELECT id, round(d, 6) AS cost FROM r"))
def bellman_ford(spark, sf):
    return paths.bellman_ford(kept(_accounts(spark, sf)), one(spark, 0))[0].select("id", F.round("cost", 6).alias("cost"))


@query("""WITH way AS (SELECT n_regionkey AS r, 1.0 - count(*) AS around FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_regionkey, n_nationkey)
SELECT coalesce(bool_or(around < 0) FILTER (WHERE r = 0), false) AS declined_bellman_ford, bool_or(around < 0) AS declined_johnson FROM way""")
def negative_cycle(spark, sf):
    """Region to nation for 1, and back for less the more suppliers a nation has: all ways around are of two arcs."""
    n, s = derive.table(spark, sf, "nation"), derive.table(spark, sf, "supplier")
    back = n.join(s, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey", "n_nationkey").agg((-F.count("*")).cast("double").alias("w"))
    r, k = F.col("n_regionkey").cast("long"), F.col("n_nationkey").cast("long") + 1000
    edges = back.select(r.alias("src"), k.alias("dst"), F.lit(1.0).alias("w")).unionAll(back.select(k.alias("src"), r.alias("dst"), "w"))
    graph = kept(Graph(edges.select(F.col("src").alias("id")).distinct().selectExpr("id", *derive.NO_PLACE), edges))
    settled = paths.bellman_ford(graph, one(spark, 0))[1]
    declined = paths.johnson(graph, one(spark, 0)) is None
    return spark.createDataFrame([(not settled, declined)], "declined_bellman_ford boolean, declined_johnson boolean")


_PAIR_SQL = o.sssp(f"{o.LATTICE}, {PAIRS_SQL}", "SELECT q, a, 0.0::DOUBLE FROM pairs",
                   "SELECT pairs.q AS qid, r.d AS cost FROM pairs LEFT JOIN r ON r.k = pairs.q AND r.id = pairs.b")


@query(_PAIR_SQL)
def dijkstra_pairs(spark, sf):
    return paths.pair_costs(kept(derive.part_lattice(spark, sf)), lattice_pairs(spark))


@query(_PAIR_SQL)
def ch_pairs(spark, sf):
    return index.Contraction.build(kept(derive.part_lattice(spark, sf)), max_rounds=8, hops=3).pair_costs(lattice_pairs(spark))


def _costs_of(graph: Graph, rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The costs of paths that came as rows (qid, k, id), checked hop by hop."""
    found = paths.path_costs(graph, trees.as_arrays(rows.withColumnRenamed("qid", "path")))
    return pairs.select("qid").join(found, "qid", "left")


@query(_PAIR_SQL)
def ch_paths(spark, sf):
    """Paths with all shortcuts unpacked, priced arc by arc."""
    g, pairs = kept(derive.part_lattice(spark, sf)), lattice_pairs(spark)
    return _costs_of(g, index.Contraction.build(g, max_rounds=8, hops=3).pair_paths(pairs), pairs)


@query(_PAIR_SQL)
def dijkstra_paths(spark, sf):
    """Paths by parents in the labels and pointer doubling, priced arc by arc."""
    g, pairs = kept(derive.part_lattice(spark, sf)), lattice_pairs(spark)
    return _costs_of(g, trees.pair_paths(g, pairs), pairs)


@query(f"""WITH RECURSIVE {o.LATTICE}, {PAIRS_SQL}, h(k, id, n) USING KEY (k, id) AS (SELECT q, a, 0 FROM pairs UNION (SELECT h.k, e.t, min(h.n + 1) FROM h JOIN e ON e.s = h.id LEFT JOIN recurring.h p ON p.k = h.k AND p.id = e.t WHERE p.id IS NULL GROUP BY 1, 2)),
w(k, id, n, d) AS (SELECT q, a, 0, 0.0::DOUBLE FROM pairs UNION ALL (SELECT w.k, e.t, w.n + 1, min(w.d + e.w) FROM w JOIN e ON e.s = w.id JOIN h ON h.k = w.k AND h.id = e.t AND h.n = w.n + 1 GROUP BY 1, 2, 3))
SELECT q AS qid, d AS cost FROM pairs LEFT JOIN w ON w.k = q AND w.id = b""")
def bfs_pairs(spark, sf):
    return paths.fewest_hops(kept(derive.part_lattice(spark, sf)), lattice_pairs(spark))


@query(_PAIR_SQL)
def astar_pairs(spark, sf):
    return paths.pair_costs(kept(derive.part_lattice(spark, sf)), lattice_pairs(spark), goal_directed=True)


#: Best-first search with the waiting and the seen nodes of a pair as lists in its row.
_GREEDY_SQL = f"""WITH RECURSIVE {o.ONEWAY}, {PAIRS_SQL}, adj AS (SELECT s, list({{'t': t, 'w': w}}) AS outs FROM (SELECT s, t, min(w) AS w FROM e GROUP BY 1, 2) GROUP BY 1),
r(q, goal, waits, seen, cost, hops) AS (SELECT q, b, [{{'h': 0.0::DOUBLE, 'id': a, 'g': 0.0::DOUBLE, 'k': 0}}], [a], NULL::DOUBLE, NULL::INTEGER FROM pairs UNION ALL
 SELECT q, goal, list_concat(list_filter(waits, lambda o: o.id <> head.id), list_transform(fresh, lambda n: {{'h': sqrt(CAST((n.t % 25 - goal % 25) * (n.t % 25 - goal % 25) + (n.t // 25 - goal // 25) * (n.t // 25 - goal // 25) AS DOUBLE)), 'id': n.t, 'g': head.g + n.w, 'k': head.k + 1}})),
  list_concat(seen, list_transform(fresh, lambda n: n.t)), CASE WHEN head.id = goal THEN head.g END, CASE WHEN head.id = goal THEN head.k END
 FROM (SELECT h.*, list_filter(coalesce(outs, []), lambda n: NOT list_contains(seen, n.t)) AS fresh FROM (SELECT *, list_sort(waits)[1] AS head FROM r WHERE len(waits) > 0 AND cost IS NULL) h LEFT JOIN adj ON adj.s = head.id))
SELECT q AS qid, max(cost) AS cost, max(hops) AS hops FROM r GROUP BY q"""


@query(_GREEDY_SQL)
def greedy_pairs(spark, sf):
    """Paths as rows, priced arc by arc."""
    g, pairs = kept(derive.oneway_lattice(spark, sf)), lattice_pairs(spark)
    rows = materialise(greedy.greedy_paths(g, pairs), "walks")
    long = rows.groupBy("qid").agg(F.max("k").cast("int").alias("hops"))
    return _costs_of(g, rows, pairs).join(long, "qid", "left")


SUPPLIER_PAIRS = [(q, 10_000_000 + q, 10_000_009 - q) for q in range(5)]
_SUPPLIER_PAIRS_SQL = "pairs(q, a, b) AS (VALUES " + ", ".join(f"({q}, {a}::BIGINT, {b}::BIGINT)" for q, a, b in SUPPLIER_PAIRS) + ")"


@query(o.sssp(f"{o.SUPPLIER_PART}, {_SUPPLIER_PAIRS_SQL}", "SELECT q, a, 0.0::DOUBLE FROM pairs",
              "SELECT pairs.q AS qid, r.d AS cost FROM pairs LEFT JOIN r ON r.k = pairs.q AND r.id = pairs.b"))
def bidijkstra_pairs(spark, sf):
    return paths.bidirectional_costs(kept(derive.supplier_part(spark, sf)), spark.createDataFrame(SUPPLIER_PAIRS, "qid int, src long, dst long"))


_APSP = o.sssp(o.NATION_TRADE, "SELECT id, id, 0.0::DOUBLE FROM (SELECT s AS id FROM e UNION SELECT t FROM e)", "SELECT k AS src, id AS dst, round(d, 4) AS cost FROM r")


@query(_APSP)
def floyd_warshall(spark, sf):
    return paths.all_pairs(kept(derive.nation_trade(spark, sf))).select("src", "dst", F.round("cost", 4).alias("cost"))


@query(_APSP.replace("round(d, 4)", "round(d + 1000.0 * k - 1000.0 * id, 4)"))
def johnson_pairs(spark, sf):
    """Weights moved by node potentials, so that many are negative."""
    g = derive.nation_trade(spark, sf)
    moved = kept(Graph(g.nodes, g.edges.withColumn("w", F.col("w") + 1000.0 * F.col("src") - 1000.0 * F.col("dst"))))
    found = paths.johnson(moved, moved.nodes.select(F.col("id").alias("qid"), "id"))
    return found.select(F.col("qid").alias("src"), F.col("id").alias("dst"), F.round("cost", 4).alias("cost"))


YEN = [(0, 0, 5), (1, 3, 17), (2, 24, 1), (3, 10, 11), (4, 7, 20)]
_YEN_SQL = "pairs(q, a, b) AS (VALUES " + ", ".join(f"({q}, {a}::BIGINT, {b}::BIGINT)" for q, a, b in YEN) + ")"


@query(f"""WITH RECURSIVE {o.NATION_TRADE}, {_YEN_SQL}, p(q, b, id, d, path) AS (SELECT q, b, a, 0.0::DOUBLE, [a] FROM pairs
 UNION ALL SELECT p.q, p.b, e.t, p.d + e.w, list_append(p.path, e.t) FROM p JOIN e ON e.s = p.id
 WHERE p.id <> p.b AND NOT list_contains(p.path, e.t) AND len(p.path) <= 4)
SELECT q AS qid, CAST(r AS INTEGER) AS rank, round(d, 4) AS cost FROM (SELECT q, d, row_number() OVER (PARTITION BY q ORDER BY d, path) AS r FROM p WHERE id = b) WHERE r <= 3""")
def yen_k3(spark, sf):
    found = paths.k_shortest(kept(derive.nation_trade(spark, sf)), spark.createDataFrame(YEN, "qid int, src long, dst long"), 3)
    return found.select("qid", "rank", F.round("cost", 4).alias("cost"))


@query(o.sssp(o.LATTICE.replace("UNION ALL SELECT t, s, w FROM arcs)", "UNION ALL SELECT t, s, w FROM arcs)", 1).replace("e AS (SELECT s, t, w FROM arcs UNION ALL SELECT t, s, w FROM arcs)",
              "e AS (SELECT * FROM (SELECT s, t, w FROM arcs UNION ALL SELECT t, s, w FROM arcs) WHERE least(s, t) % 7 <> 3)"),
              "SELECT 0, 0::BIGINT, 0.0::DOUBLE", "SELECT id, d AS cost FROM r WHERE d <= 150"))
def closures_detour(spark, sf):
    g = derive.part_lattice(spark, sf)
    closed = g.edges.where("least(src, dst) % 7 = 3 AND src < dst").select(F.col("src").alias("u"), F.col("dst").alias("v"))
    return paths.costs(kept(g.close(closed)), one(spark, 0), max_cost=150.0).drop("qid")


@query("WITH RECURSIVE " + o.HIERARCHY.replace("UNION ALL SELECT t, s, w FROM h0)", "UNION ALL SELECT t, s, w FROM h0)") + """,
n AS (SELECT s AS id FROM e UNION SELECT t FROM e), f AS (SELECT * FROM e WHERE (s + t) % 5 <> 0),
r(id, c) AS (SELECT id, id FROM n UNION SELECT f.t, r.c FROM r JOIN f ON f.s = r.id) SELECT id, min(c) AS component FROM r GROUP BY id""")
def bfs_components(spark, sf):
    g = derive.hierarchy(spark, sf)
    return analysis.components(kept(Graph(g.nodes, g.edges.where("(src + dst) % 5 <> 0"))))


@query(f"""WITH RECURSIVE {o.ROWS}, r(a, b) AS (SELECT s, t FROM e WHERE abs(s - t) = 1 UNION SELECT r.a, e.t FROM r JOIN e ON e.s = r.b WHERE e.t < r.a + 100 AND e.t > r.a - 100),
n AS (SELECT p_partkey AS id FROM part) SELECT n.id, least(n.id, coalesce(min(x.b), n.id)) AS component FROM n
 LEFT JOIN (SELECT f.a, f.b FROM r f JOIN r g ON g.a = f.b AND g.b = f.a) x ON x.a = n.id GROUP BY n.id""")
def scc(spark, sf):
    return analysis.strong_components(kept(derive.rows_lattice(spark, sf)))


_BRIDGE = f"""{o.HIERARCHY}, u AS (SELECT DISTINCT least(s, t) AS s, greatest(s, t) AS t FROM e), b AS (SELECT s, t FROM u UNION ALL SELECT t, s FROM u)"""


@query(f"""WITH RECURSIVE {_BRIDGE}, r(es, et, id) AS (SELECT s, t, t FROM u UNION SELECT r.es, r.et, b.t FROM r JOIN b ON b.s = r.id WHERE NOT (b.s = r.es AND b.t = r.et) AND NOT (b.s = r.et AND b.t = r.es)),
c(id, k) AS (SELECT s, s FROM b UNION SELECT b.t, c.k FROM c JOIN b ON b.s = c.id), comp AS (SELECT id, min(k) AS k, count(*) AS n FROM c GROUP BY id),
cut AS (SELECT es, et, count(*) AS n, bool_or(r.id = comp.k) AS has_root, any_value(comp.n) AS total FROM r JOIN comp ON comp.id = es GROUP BY es, et HAVING NOT bool_or(r.id = es))
SELECT CASE WHEN has_root THEN et ELSE es END AS u, CASE WHEN has_root THEN es ELSE et END AS v, CASE WHEN has_root THEN total - n ELSE n END AS isolated FROM cut""")
def bridges(spark, sf):
    return analysis.bridges(kept(derive.hierarchy(spark, sf)))


@query(f"""WITH RECURSIVE {_BRIDGE}, n AS (SELECT DISTINCT s AS id FROM b), first AS (SELECT n.id AS x, min(b.t) AS a, count(*) AS d FROM n JOIN b ON b.s = n.id GROUP BY n.id),
r(x, id) AS (SELECT x, a FROM first UNION SELECT r.x, b.t FROM r JOIN b ON b.s = r.id WHERE b.t <> r.x)
SELECT x AS id FROM first WHERE EXISTS (SELECT 1 FROM b WHERE b.s = first.x AND NOT EXISTS (SELECT 1 FROM r WHERE r.x = first.x AND r.id = b.t))""")
def articulation(spark, sf):
    return analysis.articulation_points(kept(derive.hierarchy(spark, sf)))


@query(f"""WITH RECURSIVE {o.HIERARCHY}, u AS (SELECT least(s, t) AS a, greatest(s, t) AS b, min(w) AS w FROM e GROUP BY 1, 2),
r(a, b, w, id) AS (SELECT a, b, w, a FROM u UNION SELECT r.a, r.b, r.w, CASE WHEN x.a = r.id THEN x.b ELSE x.a END FROM r JOIN u x ON (x.a = r.id OR x.b = r.id)
 AND (x.w < r.w OR (x.w = r.w AND (x.a < r.a OR (x.a = r.a AND x.b < r.b)))))
SELECT a AS u, b AS v, w FROM u WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.a = u.a AND r.b = u.b AND r.id = u.b)""")
def mst(spark, sf):
    return analysis.spanning_tree(kept(derive.hierarchy(spark, sf)))


@query(f"""WITH RECURSIVE {o.HIERARCHY}, b AS (SELECT s, t, min(w) AS w FROM e GROUP BY 1, 2), n AS (SELECT s AS id FROM e UNION SELECT t FROM e),
d(k, id, d) USING KEY (k, id) AS (SELECT id, id, 0.0::DOUBLE FROM n UNION (SELECT d.k, b.t, min(d.d + b.w) FROM d JOIN b ON b.s = d.id LEFT JOIN recurring.d p ON p.k = d.k AND p.id = b.t
 GROUP BY d.k, b.t, p.d HAVING min(d.d + b.w) < coalesce(p.d, 'infinity'::DOUBLE))),
g AS (SELECT x.k, b.s, b.t FROM d x JOIN b ON b.s = x.id JOIN d y ON y.k = x.k AND y.id = b.t WHERE x.d + b.w = y.d),
walk(k, id, c) AS (SELECT id, id, 1.0::DOUBLE FROM n UNION ALL (SELECT w.k, g.t, sum(w.c) FROM walk w JOIN g ON g.k = w.k AND g.s = w.id GROUP BY 1, 2)),
c AS (SELECT walk.k, walk.id, sum(c) AS c, any_value(d.d) AS d FROM walk JOIN d ON d.k = walk.k AND d.id = walk.id GROUP BY 1, 2),
x AS (SELECT a.id AS v, sum(a.c * b.c / st.c) AS score FROM c a JOIN c b ON b.k = a.id JOIN c st ON st.k = a.k AND st.id = b.id WHERE a.k <> a.id AND b.id <> a.id AND st.id <> st.k AND a.d + b.d = st.d GROUP BY 1)
SELECT n.id, round(coalesce(score, 0), 6) AS score FROM n LEFT JOIN x ON x.v = n.id""")
def betweenness(spark, sf):
    g = derive.hierarchy(spark, sf)
    arcs = g.edges.groupBy("src", "dst").agg(F.min("w").alias("w"))
    return analysis.betweenness(kept(Graph(g.nodes, arcs))).select("id", F.round("score", 6).alias("score"))


@query()
def max_flow(spark, sf):
    g = kept(derive.nation_trade(spark, sf))
    value, residual = analysis.max_flow(g, 0, 13)
    return residual.select("src", "dst", F.round("c", 2).alias("residual"), F.lit(round(value, 2)).alias("value"))


#: Augmenting paths over a list of all residual capacities: a row is a level of a breadth-first search, or the change along a path found.
_CUT_SQL = f"""WITH RECURSIVE {o.NATION_TRADE},
cap AS (SELECT list(coalesce(w, 0.0) ORDER BY i, j) AS c FROM (SELECT i.range AS i, j.range AS j FROM range(25) i, range(25) j) g LEFT JOIN e ON e.s = g.i AND e.t = g.j),
r(n, c, par, front) AS (SELECT 0, c, list_transform(range(25), lambda i: CASE WHEN i = 0 THEN 0 ELSE -1 END), [0::BIGINT] FROM cap UNION ALL
 SELECT n + 1, CASE WHEN hit THEN list_transform(range(625), lambda k: c[k + 1] - CASE WHEN list_contains(way, k) THEN least_c ELSE 0 END + CASE WHEN list_contains(way, k % 25 * 25 + k // 25) THEN least_c ELSE 0 END) ELSE c END,
  CASE WHEN hit THEN list_transform(range(25), lambda i: CASE WHEN i = 0 THEN 0 ELSE -1 END) ELSE par END, CASE WHEN hit THEN [0::BIGINT] ELSE front END
 FROM (SELECT *, list_min(list_transform(way, lambda k: c[k + 1])) AS least_c
 FROM (SELECT *, list_filter(range(625), lambda k: hit AND k % 25 <> 0 AND par[k % 25 + 1] = k // 25 AND list_contains(up, k % 25)) AS way
 FROM (SELECT *, par[14] >= 0 AS hit, CASE WHEN par[14] >= 0 THEN list_reduce(list_concat([[13::BIGINT]], list_transform(range(24), lambda i: [i])), lambda a, x: list_append(a, par[a[-1] + 1])) ELSE [] END AS up
 FROM (SELECT n, c, list_transform(range(25), lambda j: CASE WHEN par[j + 1] >= 0 THEN par[j + 1] ELSE coalesce(list_filter(front, lambda i: c[i * 25 + j + 1] > 1e-9)[1], -1) END) AS par,
   list_filter(range(25), lambda j: par[j + 1] < 0 AND len(list_filter(front, lambda i: c[i * 25 + j + 1] > 1e-9)) > 0) AS front FROM r WHERE len(front) > 0))))),
side AS (SELECT arg_max(par, n) AS par FROM r), cut AS (SELECT e.s AS src, e.t AS dst, e.w FROM e, side WHERE par[e.s + 1] >= 0 AND par[e.t + 1] < 0)
"""


@query(_CUT_SQL + "SELECT src, dst, round(w, 2) AS w FROM cut")
def min_cut(spark, sf):
    return analysis.min_cut(kept(derive.nation_trade(spark, sf)), 0, 13).select("src", "dst", F.round("w", 2).alias("w"))


@query(_CUT_SQL + "SELECT coalesce(round(sum(w), 2), 0.0) AS value, 0::BIGINT AS over_capacity, 0::BIGINT AS unbalanced, coalesce(round(sum(w), 2), 0.0) AS arrives FROM cut")
def flow_certificate(spark, sf):
    """That the flow is one and is greatest: no arc above its capacity, no node keeps anything, and as much arrives as the least cut lets through."""
    g = kept(derive.nation_trade(spark, sf))
    value, residual = analysis.max_flow(g, 0, 13)
    own = g.edges.groupBy("src", "dst").agg(F.sum("w").alias("w"))
    sent = residual.join(own, ["src", "dst"], "left").select("src", "dst", "c", (F.coalesce("w", F.lit(0.0)) - F.col("c")).alias("f")).where("src <> dst")
    # the two arcs of a pair hold the same flow with opposite signs, so out-sums are net
    net = sent.groupBy("src").agg(F.sum("f").alias("net"))
    checks = net.agg(
        F.count(F.when(~F.col("src").isin(0, 13) & (F.abs("net") > 1e-4), 1)).alias("unbalanced"),
        F.coalesce(F.round(F.sum(F.when(F.col("src") == 13, -F.col("net"))), 2), F.lit(0.0)).alias("arrives"),
    )
    over = sent.agg(F.count(F.when(F.col("c") < -1e-6, 1)).alias("over_capacity"))
    return over.crossJoin(checks).select(F.lit(round(value, 2)).alias("value"), "over_capacity", "unbalanced", "arrives")  # one row each


# ---- geometry


@query(f"WITH {o.POINTS}, q AS (SELECT id AS qid, x + 0.01 AS qx, y - 0.02 AS qy FROM pts) SELECT qid, id, round(dist, 9) AS dist FROM (SELECT qid, id, "
       "sqrt((x - qx) * (x - qx) + (y - qy) * (y - qy)) AS dist, row_number() OVER (PARTITION BY qid ORDER BY sqrt((x - qx) * (x - qx) + (y - qy) * (y - qy)), id) AS r FROM pts, q) WHERE r = 1")  # fmt: skip
def nearest(spark, sf):
    p = derive.plane_points(spark, sf)
    q = p.selectExpr("id AS qid", "x + 0.01D AS qx", "y - 0.02D AS qy")
    return spatial.k_nearest(q, p, 1).select("qid", "id", F.round("dist", 9).alias("dist"))


@query(f"WITH {o.POINTS} SELECT a.id AS qid, b.id, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 9) AS dist FROM pts a JOIN pts b "
       "ON sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 0.05 WHERE a.id % 5 = 0")  # fmt: skip
def within_radius(spark, sf):
    p = derive.plane_points(spark, sf)
    q = p.where("id % 5 = 0").selectExpr("id AS qid", "x AS qx", "y AS qy")
    return spatial.within(q, p, 0.05).select("qid", "id", F.round("dist", 9).alias("dist"))


def _hav(a: str, b: str) -> str:
    h = f"(power(sin(radians({b}.y - {a}.y) / 2), 2) + cos(radians({a}.y)) * cos(radians({b}.y)) * power(sin(radians({b}.x - {a}.x) / 2), 2))"
    return f"(2 * 6371008.8 * asin(sqrt(least(1.0, {h}))))"


@query(f"WITH {o.POINTS}, g AS (SELECT id, 77 + x AS x, 13 + y AS y FROM pts) SELECT a.id AS qid, b.id, round({_hav('a', 'b')}, 4) AS dist FROM g a JOIN g b ON {_hav('a', 'b')} <= 6000 WHERE a.id % 5 = 0")
def within_geographic(spark, sf):
    p = derive.plane_points(spark, sf).selectExpr("id", "77 + x AS x", "13 + y AS y")
    q = p.where("id % 5 = 0").selectExpr("id AS qid", "x AS qx", "y AS qy")
    return spatial.within(q, p, 6000.0, "geographic").select("qid", "id", F.round("dist", 4).alias("dist"))


@query(o.sssp(o.PLANE, "SELECT 0, 0::BIGINT, 0.0::DOUBLE", "SELECT c AS cutoff, count(*) AS n, round(count(*) / (SELECT count(*) FROM pts), 6) AS share FROM r, "
              "(VALUES (0.1::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE)) v(c) WHERE d <= c GROUP BY c"))  # fmt: skip
def isochrone_bands(spark, sf):
    g = kept(derive.embedding_plane(spark, sf))
    reached = paths.costs(g, one(spark, 0), max_cost=0.5)
    many = g.nodes.agg(F.count("*").alias("all"))
    return spatial.isochrone(reached.drop("qid"), [0.1, 0.25, 0.5]).groupBy("cutoff").agg(F.count("*").alias("n")).crossJoin(many).select(
        "cutoff", "n", F.round(F.col("n") / F.col("all"), 6).alias("share")
    )


@query(o.sssp(o.PLANE, "SELECT 0, 0::BIGINT, 0.0::DOUBLE", """, band AS (SELECT c AS cutoff, id, x, y FROM r JOIN pts USING (id), (VALUES (0.25::DOUBLE), (0.5::DOUBLE)) v(c) WHERE d <= c),
edge AS (SELECT a.cutoff, a.id AS a, b.id AS b FROM band a JOIN band b ON a.cutoff = b.cutoff AND a.id <> b.id
 WHERE NOT EXISTS (SELECT 1 FROM band p WHERE p.cutoff = a.cutoff AND (b.x - a.x) * (p.y - a.y) - (b.y - a.y) * (p.x - a.x) < 0))
SELECT cutoff, a AS id FROM edge GROUP BY cutoff, a""").replace("\n, band AS", ", band AS", 1))
def isochrone_hull(spark, sf):
    g = kept(derive.embedding_plane(spark, sf))
    reached = spatial.isochrone(paths.costs(g, one(spark, 0), max_cost=0.5).drop("qid"), [0.25, 0.5])
    return spatial.convex_hull(reached.join(g.nodes, "id").select("cutoff", "id", "x", "y"), "cutoff").select("cutoff", "id")


@query(f"WITH {o.LATTICE} SELECT min(w) AS min_ratio, max(greatest(0.0, 1.0 - w)) AS shortfall, max(greatest(0.0, 1.0 - w)) <= 0.01 AS admissible FROM e")
def admissibility(spark, sf):
    return derive.part_lattice(spark, sf).admissibility()


@query("""WITH n AS (SELECT n_nationkey AS id, -60 + 4.5 * n_nationkey AS lat, -170 + 13.7 * n_nationkey AS lon FROM nation),
p AS (SELECT a.id AS a, b.id AS b, a.lat AS y1, a.lon AS x1, b.lat AS y2, b.lon AS x2 FROM n a JOIN n b ON a.id < b.id),
q AS (SELECT *, degrees(atan2(sin(radians(x2 - x1)) * cos(radians(y2)), cos(radians(y1)) * sin(radians(y2)) - sin(radians(y1)) * cos(radians(y2)) * cos(radians(x2 - x1)))) AS t FROM p)
SELECT a, b, round(2 * 6371008.8 * asin(sqrt(least(1.0, power(sin(radians(y2 - y1) / 2), 2) + cos(radians(y1)) * cos(radians(y2)) * power(sin(radians(x2 - x1) / 2), 2)))), 3) AS metres,
 round(6371008.8 * sqrt(power(radians(x2 - x1) * cos(radians((y1 + y2) / 2)), 2) + power(radians(y2 - y1), 2)), 3) AS flat,
 round(CASE WHEN t < 0 THEN t + 360 ELSE t END, 6) AS bearing, round(CASE WHEN t < 0 THEN t + 360 ELSE t END - 90 - 360 * ceil((CASE WHEN t < 0 THEN t + 360 ELSE t END - 90 - 180) / 360), 6) AS turn,
 round((x1 + 180) / 360, 9) AS mx, round(0.5 - ln((1 + sin(radians(y1))) / (1 - sin(radians(y1)))) / (4 * pi()), 9) AS my FROM q""")
def geo_functions(spark, sf):
    n = derive.table(spark, sf, "nation").selectExpr("n_nationkey AS id", "-60 + 4.5D * n_nationkey AS lat", "-170 + 13.7D * n_nationkey AS lon")
    a, b = n.toDF("a", "y1", "x1"), n.toDF("b", "y2", "x2")
    p = a.join(F.broadcast(b), F.col("a") < F.col("b"))  # a row for each nation
    y1, x1, y2, x2 = map(F.col, ("y1", "x1", "y2", "x2"))
    bear = geo.bearing(y1, x1, y2, x2)
    mx, my = geo.mercator(y1, x1)
    return p.select(
        "a", "b", F.round(geo.haversine(y1, x1, y2, x2), 3).alias("metres"), F.round(geo.equirectangular(y1, x1, y2, x2), 3).alias("flat"),
        F.round(bear, 6).alias("bearing"), F.round(geo.turn_angle(F.lit(90.0), bear), 6).alias("turn"), F.round(mx, 9).alias("mx"), F.round(my, 9).alias("my"),
    )


# ---- paths as values

_STAIRS = """stairs AS (SELECT q, unnest([q, q + 1, q + 26, q + 27, q + 28, q + 53, q + 52]) AS id, unnest(range(7)) AS k FROM (SELECT unnest([0, 30, 60, 105, 120]) AS q))"""


def _stairs(spark: SparkSession) -> DataFrame:
    rows = [(q, [q, q + 1, q + 26, q + 27, q + 28, q + 53, q + 52]) for q in (0, 30, 60, 105, 120)]
    return spark.createDataFrame(rows, "qid int, path array<long>")


@query(f"""WITH {_STAIRS}, pos AS (SELECT q, k, id, (id % 25)::DOUBLE AS x, (id // 25)::DOUBLE AS y FROM stairs),
l AS (SELECT *, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy FROM pos WINDOW w AS (PARTITION BY q ORDER BY k)),
b AS (SELECT *, CASE WHEN degrees(atan2(dx, dy)) < 0 THEN degrees(atan2(dx, dy)) + 360 ELSE degrees(atan2(dx, dy)) END AS be FROM l),
t AS (SELECT *, be - lag(be) OVER (PARTITION BY q ORDER BY k) AS d FROM b), v AS (SELECT *, d - 360 * ceil((d - 180) / 360) AS turn FROM t),
m AS (SELECT *, CASE WHEN k = 0 THEN 'depart' WHEN dx IS NULL THEN 'arrive' WHEN abs(turn) >= 150 THEN 'u-turn' WHEN abs(turn) <= 20 THEN 'straight'
 WHEN abs(turn) <= 45 THEN 'slight ' || CASE WHEN turn > 0 THEN 'right' ELSE 'left' END WHEN abs(turn) <= 120 THEN CASE WHEN turn > 0 THEN 'right' ELSE 'left' END
 ELSE 'sharp ' || CASE WHEN turn > 0 THEN 'right' ELSE 'left' END END AS man FROM v),
g AS (SELECT *, sum(CASE WHEN man <> 'straight' THEN 1 ELSE 0 END) OVER (PARTITION BY q ORDER BY k) AS step FROM m)
SELECT q AS qid, CAST(step AS BIGINT) AS step, arg_min(man, k) AS maneuver, arg_min(id, k)::BIGINT AS "at", round(coalesce(sum(sqrt(dx * dx + dy * dy)), 0), 6) AS distance FROM g GROUP BY q, step""")
def turn_by_turn(spark, sf):
    out = directions.build_directions(_stairs(spark), derive.lattice_nodes(spark, sf))
    return out.select("qid", "step", "maneuver", "at", F.round("distance", 6).alias("distance"))


@query(f"""WITH {o.LATTICE}, {_STAIRS}, s AS (SELECT q, k, id, lead(id) OVER (PARTITION BY q ORDER BY k) AS nx FROM stairs UNION ALL SELECT 999, 0, 3, 90 UNION ALL SELECT 999, 1, 90, NULL UNION ALL SELECT 998, 0, 5, NULL),
p AS (SELECT q, k, nx, (SELECT min(w) FROM e WHERE e.s = s.id AND e.t = s.nx) AS w FROM s)
SELECT q AS qid, CASE WHEN count(*) = 1 THEN 0.0 WHEN count(w) = count(*) - 1 THEN sum(w) END AS cost FROM p GROUP BY q""")
def path_cost(spark, sf):
    more = spark.createDataFrame([(999, [3, 90]), (998, [5])], "qid int, path array<long>")
    return paths.path_costs(derive.part_lattice(spark, sf), _stairs(spark).unionByName(more))


# ---- time of day

_TIER = """ranked AS (SELECT *, greatest(0, least(4, floor((row_number() OVER (ORDER BY w, eid) - 1) * 5.0 / count(*) OVER ()) + (((eid % 2147483647) * 1103515245 + 271828) // 65536) % 3 - 1)) AS tier FROM el)"""
_CURVE = "[1.00, 1.00, 1.00, 1.00, 1.02, 1.10, 1.35, 1.80, 2.35, 2.55, 2.05, 1.70, 1.55, 1.55, 1.50, 1.60, 1.85, 2.30, 2.60, 2.40, 1.90, 1.50, 1.25, 1.08]::DOUBLE[]"


def _secs(w: str, tier: str, t: str) -> str:
    h = f"((({t}) - 86400.0 * floor(({t}) / 86400.0)) / 3600.0)"
    a, b = f"({_CURVE})[CAST(floor({h}) AS INTEGER) + 1]", f"({_CURVE})[(CAST(floor({h}) AS INTEGER) + 1) % 24 + 1]"
    return f"({w} / 11.1 * (1 + {tier} / 4.0 * ({a} + ({b} - {a}) * ({h} - floor({h})) - 1)))"


def _timed_lattice(spark: SparkSession, sf: str) -> DataFrame:
    return derive.lattice_arcs(spark, sf).select((F.col("src") * 2 + (F.col("dst") - F.col("src") == 25).cast("long")).alias("eid"), "src", "dst", (F.col("w") * 100).alias("w"))


_TIMED = f"{o.LATTICE_ARCS}, el AS (SELECT s * 2 + CASE WHEN t - s = 25 THEN 1 ELSE 0 END AS eid, s, t, w * 100 AS w FROM arcs), {_TIER}"


@query(f"WITH {_TIMED} SELECT eid, h AS hour, round({_secs('w', 'tier', 'h * 1800.0')}, 6) AS secs FROM ranked, (SELECT unnest([0, 13, 17, 36, 47]) AS h)")
def td_travel_time(spark, sf):
    edges = timedep.congestion_tiers(_timed_lattice(spark, sf))
    hours = spark.createDataFrame([(h,) for h in (0, 13, 17, 36, 47)], "hour int")
    return edges.crossJoin(F.broadcast(hours)).select("eid", "hour", F.round(timedep.travel_time(F.col("w"), F.col("tier"), F.col("hour") * 1800.0), 6).alias("secs"))


@query(f"WITH {_TIMED}, m AS (SELECT eid, [1 + tier / 4.0 * (c - 1) FOR c IN {_CURVE}] AS m FROM ranked) SELECT eid, round(list_max(m) / list_min(m), 9) AS range FROM m")
def td_congestion_range(spark, sf):
    edges = timedep.congestion_tiers(_timed_lattice(spark, sf))
    return edges.select("eid", F.round(timedep.congestion_range(F.col("tier")), 9).alias("range"))


_SP_TIMED = f"""{o.SUPPLIER_PART}, el AS (SELECT s * 1000003 + t AS eid, s, t, w * 40 AS w FROM e), {_TIER}"""


def _timed_supplier_part(spark: SparkSession, sf: str) -> Graph:
    found = derive.supplier_pairs(spark, sf)
    pairs = materialise(found, "pairs")  # once for both ways
    release(found, shuffles=True)
    both = pairs.unionAll(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))  # filters reach the table
    edges = both.select((F.col("src") * 1000003 + F.col("dst")).alias("eid"), "src", "dst", (F.col("w") * 40).alias("w"))
    return Graph(derive.ends_of(pairs), timedep.congestion_tiers(edges))


_ARRIVE = f"greatest(r.d + {_secs('x.w', 'x.tier', 'r.d')}, r.d - 60.0 + {_secs('x.w', 'x.tier', 'r.d - 60.0')})"


@query(f"""WITH RECURSIVE {_SP_TIMED}, r(k, id, d) USING KEY (k, id) AS (SELECT d, 10000001::BIGINT, d FROM (SELECT unnest([0.0, 28800.0, 64800.0])::DOUBLE AS d)
 UNION (SELECT r.k, x.t, min({_ARRIVE}) FROM r JOIN ranked x ON x.s = r.id LEFT JOIN recurring.r p ON p.k = r.k AND p.id = x.t GROUP BY r.k, x.t, p.d HAVING min({_ARRIVE}) < coalesce(p.d, 'infinity'::DOUBLE)))
SELECT k AS dep, id, round(d, 4) AS arrival FROM r""")
def td_earliest(spark, sf):
    timed = _timed_supplier_part(spark, sf)
    starts = spark.createDataFrame([(d, 10_000_001) for d in (0.0, 28800.0, 64800.0)], "dep double, id long")
    return timedep.earliest_arrivals(timed, starts).select("dep", "id", F.round("arrival", 4).alias("arrival"))


@query(f"""WITH RECURSIVE {_SP_TIMED}, r(k, id, d) USING KEY (k, id) AS (SELECT d, 10000001::BIGINT, d FROM (SELECT 3600.0::DOUBLE * range AS d FROM range(24))
 UNION (SELECT r.k, x.t, min({_ARRIVE}) FROM r JOIN ranked x ON x.s = r.id LEFT JOIN recurring.r p ON p.k = r.k AND p.id = x.t GROUP BY r.k, x.t, p.d HAVING min({_ARRIVE}) < coalesce(p.d, 'infinity'::DOUBLE))),
f AS (SELECT 3600.0 * range AS dep, round(d - k, 4) AS duration, d - k AS x FROM range(24) LEFT JOIN r ON r.k = 3600.0 * range AND r.id = 10000005)
SELECT CAST(dep AS DOUBLE) AS dep, duration, dep = (SELECT arg_min(dep, [x, dep]) FROM f) AS best, dep = (SELECT arg_max(dep, [x, -dep]) FROM f) AS worst FROM f""")
def td_scan(spark, sf):
    timed = _timed_supplier_part(spark, sf)
    return timedep.scan_departures(timed, 10_000_001, 10_000_005).withColumn("duration", F.round("duration", 4))


@query(f"""WITH RECURSIVE {_SP_TIMED}, r(k, id, l) USING KEY (k, id) AS (SELECT d, 10000001::BIGINT, [d, 0.0::DOUBLE] FROM (SELECT unnest([0.0, 64800.0])::DOUBLE AS d)
 UNION (SELECT r.k, x.t, min([{_ARRIVE.replace("r.d", "r.l[1]")}, r.l[2] + x.w]) FROM r JOIN ranked x ON x.s = r.id LEFT JOIN recurring.r p ON p.k = r.k AND p.id = x.t
 GROUP BY r.k, x.t, p.l HAVING min([{_ARRIVE.replace("r.d", "r.l[1]")}, r.l[2] + x.w]) < coalesce(p.l, ['infinity'::DOUBLE, 0.0])))
SELECT k AS dep, id, round(l[1] - k, 4) AS duration, round(l[2], 4) AS metres, round(l[2] / 11.1, 4) AS free_flow FROM r""")
def td_journeys(spark, sf):
    timed = _timed_supplier_part(spark, sf)
    starts = spark.createDataFrame([(d, 10_000_001) for d in (0.0, 64800.0)], "dep double, id long")
    return timedep.journeys(timed, starts).select("dep", "id", *[F.round(c, 4).alias(c) for c in ("duration", "metres", "free_flow")])


# ---- transit: suppliers as stations over the vectors' plane


def _stations(spark: SparkSession, sf: str) -> DataFrame:
    s, n, r = (derive.table(spark, sf, t) for t in ("supplier", "nation", "region"))
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).selectExpr(
        "s_suppkey AS id", "s_name AS name", "n_name AS system", "r_name AS city", "13 + ((s_suppkey * 37) % 100) / 250.0D - 0.2D AS lat", "77 + ((s_suppkey * 61) % 100) / 250.0D - 0.2D AS lon"
    )


def _transit_links(spark: SparkSession, sf: str) -> DataFrame:
    pairs = derive.table(spark, sf, "supplier").selectExpr("s_suppkey AS `from`", "lead(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS to", "concat('L', s_nationkey) AS line", "CAST(s_suppkey % 4 AS double) * 60 AS seconds")
    return pairs.where("to IS NOT NULL")


_STATIONS = """st AS (SELECT s_suppkey AS id, s_name AS name, n_name AS system, r_name AS city, 13 + ((s_suppkey * 37) % 100) / 250.0 - 0.2 AS lat, 77 + ((s_suppkey * 61) % 100) / 250.0 - 0.2 AS lon
 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
lk AS (SELECT * FROM (SELECT s_suppkey AS a, lead(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS b, (s_suppkey % 4) * 60.0 AS seconds FROM supplier) WHERE b IS NOT NULL)"""


@query(f"WITH {_STATIONS}, x AS (SELECT id FROM st WHERE lower(system) LIKE '%an%' OR lower(city) LIKE '%an%') SELECT (SELECT count(*) FROM x) AS stations, (SELECT count(*) FROM lk WHERE a IN (SELECT id FROM x) AND b IN (SELECT id FROM x)) AS links")
def transit_filter(spark, sf):
    s, lk = transit.filter_network(_stations(spark, sf), _transit_links(spark, sf), "AN")
    return s.agg(F.count("*").alias("stations")).crossJoin(lk.agg(F.count("*").alias("links")))


@query(f"WITH {_STATIONS} SELECT system, count(*) AS stations, (SELECT count(*) FROM lk JOIN st x ON x.id = lk.a WHERE x.system = st.system) AS links FROM st GROUP BY system")
def transit_listing(spark, sf):
    return transit.systems(_stations(spark, sf), _transit_links(spark, sf))


@query(f"WITH {_STATIONS} SELECT a + 1000000000 AS src, b + 1000000000 AS dst, CASE WHEN seconds > 0 THEN seconds ELSE 60.0 END::DOUBLE AS w FROM lk UNION ALL SELECT b + 1000000000, a + 1000000000, CASE WHEN seconds > 0 THEN seconds ELSE 60.0 END::DOUBLE FROM lk")
def rail_only(spark, sf):
    return transit.rail_only(_stations(spark, sf), _transit_links(spark, sf)).edges


def _eq(a: str, b: str) -> str:
    return f"(6371008.8 * sqrt(power(radians({b}.x - {a}.lon) * cos(radians(({a}.lat + {b}.y) / 2)), 2) + power(radians({b}.y - {a}.lat), 2)))"


_H2 = "(2 * 6371008.8 * asin(sqrt(least(1.0, power(sin(radians(g.y - st.lat) / 2), 2) + cos(radians(st.lat)) * cos(radians(g.y)) * power(sin(radians(g.x - st.lon) / 2), 2)))))"


@query(f"""WITH {_STATIONS}, {o.POINTS}, g AS (SELECT id, 77 + x AS x, 13 + y AS y FROM pts),
near AS (SELECT st.id + 1000000000 AS q, g.id, {_eq('st', 'g')} AS m, {_H2} <= 3000 AS ok FROM st, g), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY m, id) AS r FROM near WHERE ok),
alone AS (SELECT q, arg_min(id, [m, id]) AS id, min(m) AS m FROM near WHERE q NOT IN (SELECT q FROM r) GROUP BY q)
SELECT q, id, round(m / 1.35 + 180, 4) AS board FROM r WHERE r <= 4 UNION ALL SELECT q, id, round(m / 1.35 + 180, 4) FROM alone""")
def transit_combine(spark, sf):
    """The walks to all stations, from the nearest road nodes within 3 km or else from the nearest of all."""
    road = Graph(derive.plane_points(spark, sf).selectExpr("id", "77 + x AS x", "13 + y AS y"), spark.createDataFrame([], "src long, dst long, w double"), "geographic")
    both = transit.combine(road, _stations(spark, sf), _transit_links(spark, sf), radius=3000.0)
    return both.edges.where("src < 1000000000 AND dst >= 1000000000").select(F.col("dst").alias("q"), F.col("src").alias("id"), F.round("w", 4).alias("board"))


# ---- indices, extracts, traces and races


_NATION_PAIRS = [(q, (q * 7) % 25, (q * 11 + 3) % 25) for q in range(12)]
_NATION_PAIRS_SQL = "pairs(q, a, b) AS (VALUES " + ", ".join(f"({q}, {a}::BIGINT, {b}::BIGINT)" for q, a, b in _NATION_PAIRS) + ")"
_NATION_COSTS = o.sssp(f"{o.NATION_TRADE}, {_NATION_PAIRS_SQL}", "SELECT q, a, 0.0::DOUBLE FROM pairs",
                       "SELECT pairs.q AS qid, round(r.d, 4) AS cost FROM pairs LEFT JOIN r ON r.k = pairs.q AND r.id = pairs.b")


def nation_pairs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_NATION_PAIRS, "qid int, src long, dst long")


@query(_NATION_COSTS)
def alt_pairs(spark, sf):
    found = index.Landmarks.build(kept(derive.nation_trade(spark, sf)), k=3).pair_costs(nation_pairs(spark))
    return found.select("qid", F.round("cost", 4).alias("cost"))


@query(o.sssp(f"{o.NATION_TRADE}, {_NATION_PAIRS_SQL}", "SELECT id, id, 0.0::DOUBLE FROM (SELECT s AS id FROM e UNION SELECT t FROM e)",
              """SELECT DISTINCT pairs.a AS v, pairs.b AS t, round(greatest(0.0, va.d - ta.d, tb.d - vb.d), 4) AS bound FROM pairs, (SELECT min(s) AS mark FROM e)
 JOIN r va ON va.k = a AND va.id = mark JOIN r ta ON ta.k = b AND ta.id = mark JOIN r vb ON vb.k = mark AND vb.id = a JOIN r tb ON tb.k = mark AND tb.id = b"""))
def alt_bounds(spark, sf):
    """What one landmark, the smallest node, says of each pair at least."""
    marks = index.Landmarks.build(kept(derive.nation_trade(spark, sf)), k=1)
    found = marks.lower_bounds(nation_pairs(spark).select(F.col("src").alias("v"), F.col("dst").alias("t")))
    return found.select("v", "t", F.round("bound", 4).alias("bound"))


@query(_NATION_COSTS)
def cch_pairs(spark, sf):
    found = index.Hierarchy.build(kept(derive.nation_trade(spark, sf))).customise().pair_costs(nation_pairs(spark))
    return found.select("qid", F.round("cost", 4).alias("cost"))


@query(_NATION_COSTS)
def cch_paths(spark, sf):
    """Paths with all shortcuts unpacked, priced arc by arc."""
    g, pairs = kept(derive.nation_trade(spark, sf)), nation_pairs(spark)
    rows = index.Hierarchy.build(g).customise().pair_paths(pairs)
    return _costs_of(g, rows, pairs).select("qid", F.round("cost", 4).alias("cost"))


@query(o.sssp(o.HIERARCHY.replace("SELECT s, t, w FROM h0 UNION ALL SELECT t, s, w FROM h0", "SELECT s, t, w * (1 + (s + t) % 4) AS w FROM h0 UNION ALL SELECT t, s, w * (1 + (s + t) % 4) FROM h0"),
              "SELECT id % 7, id, 0.0::DOUBLE FROM (SELECT CAST(range AS BIGINT) + 1000001 AS id FROM range(5))",
              "SELECT k + 0 AS source, id, d AS cost FROM r WHERE id < 1000"))
def cch_reweighted(spark, sf):
    """The hierarchy of one metric, customised with another."""
    g = kept(derive.hierarchy(spark, sf))
    other = g.edges.select("src", "dst", (F.col("w") * (1 + (F.col("src") + F.col("dst")) % 4)).alias("w"))
    pairs = spark.createDataFrame([((1000001 + k) % 7 * 10 + r, 1000001 + k, r) for k in range(5) for r in range(5)], "qid long, src long, dst long")
    found = index.Hierarchy.build(g).customise(other).pair_costs(pairs).where("cost IS NOT NULL")
    return found.select(F.expr("qid div 10").alias("source"), (F.col("qid") % 10).alias("id"), "cost")


@query(f"WITH RECURSIVE {o.SUPPLIER_PART}, r(id, hops) USING KEY (id) AS (SELECT 10000001::BIGINT, 0 UNION (SELECT e.t, min(r.hops + 1) FROM r JOIN e ON e.s = r.id "
       "LEFT JOIN recurring.r p ON p.id = e.t WHERE p.id IS NULL GROUP BY e.t)) SELECT id, hops < 2 AS explored, hops = 2 AS in_frontier FROM r WHERE hops <= 2")  # fmt: skip
def trace_replay(spark, sf):
    events = trace.bfs_trace(kept(derive.supplier_part(spark, sf)), one(spark, 10_000_001))
    return trace.replay(events, 2).select("id", "explored", "in_frontier")


@query(o.sssp(o.LATTICE, "SELECT 0, 12::BIGINT, 0.0::DOUBLE", """, b AS (SELECT s, t, min(w) AS w FROM e GROUP BY 1, 2),
m AS (SELECT a.d AS step, b.t AS node, a.id AS parent, a.d + b.w AS offer FROM r a JOIN b ON b.s = a.id UNION ALL SELECT -1, 12, NULL, 0.0),
x AS (SELECT *, min(offer) OVER (PARTITION BY node ORDER BY step, parent ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM m)
SELECT CAST(greatest(step, 0) AS DOUBLE) AS step, CASE WHEN before IS NULL THEN 0 ELSE 2 END AS op, node, parent FROM x WHERE before IS NULL OR offer < before
UNION ALL SELECT d, 1, id, NULL FROM r""").replace("\n, b AS", ", b AS"))
def cost_trace(spark, sf):
    return trace.cost_trace(kept(derive.part_lattice(spark, sf)), one(spark, 12)).drop("qid")


_WAYS = """step AS (SELECT user_id AS way_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, event_id % 400 AS id FROM events),
pl AS (SELECT CAST(range AS BIGINT) AS id, 13 + ((range * 37) % 100) / 250.0 AS lat, 77 + ((range * 61) % 100) / 250.0 AS lon FROM range(400))"""


@query(f"""WITH {_WAYS}, u AS (SELECT id, count(*) AS n FROM step GROUP BY id), s AS (SELECT step.*, lat, lon, max(pos) OVER (PARTITION BY way_id) AS last, n FROM step JOIN u USING (id) JOIN pl USING (id)),
g AS (SELECT *, CASE WHEN pos = 0 OR pos = last OR n > 1 THEN 1 ELSE 0 END AS cut, lag(lat) OVER w AS la, lag(lon) OVER w AS lo FROM s WINDOW w AS (PARTITION BY way_id ORDER BY pos)),
p AS (SELECT *, coalesce(sum(cut) OVER (PARTITION BY way_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part,
 coalesce(2 * 6371008.8 * asin(sqrt(least(1.0, power(sin(radians(lat - la) / 2), 2) + cos(radians(la)) * cos(radians(lat)) * power(sin(radians(lon - lo) / 2), 2)))), 0) AS leg FROM g),
l AS (SELECT way_id, part, sum(leg) AS w, arg_max(id, pos) AS v FROM p GROUP BY 1, 2), q AS (SELECT way_id, lag(v) OVER (PARTITION BY way_id ORDER BY part) AS u, v, w FROM l),
k AS (SELECT * FROM q WHERE u IS NOT NULL AND u <> v AND w > 0)
SELECT u, v, round(min(w), 3) AS w FROM (SELECT u, v, w FROM k WHERE way_id % 4 <> 2 UNION ALL SELECT v, u, w FROM k WHERE way_id % 4 NOT IN (1, 3)) GROUP BY 1, 2""")
def etl_collapse(spark, sf):
    """Ways are the users' event sequences: by fours two-way, forward, backward and roundabout."""
    e = derive.table(spark, sf, "events")
    ways = e.groupBy(F.col("user_id").alias("way_id")).agg(F.sort_array(F.collect_list(F.struct("ts", "event_id"))).alias("m")).select(
        "way_id", F.transform("m", lambda x: x["event_id"] % 400).alias("nodes"),
        F.expr("CASE way_id % 4 WHEN 1 THEN 'yes' WHEN 2 THEN '-1' ELSE 'no' END").alias("oneway"), F.expr("CASE way_id % 4 WHEN 3 THEN 'roundabout' END").alias("junction"),
    )
    places = spark.range(400).selectExpr("id", "13 + ((id * 37) % 100) / 250.0D AS lat", "77 + ((id * 61) % 100) / 250.0D AS lon")
    return etl.road_edges(ways, places).select("u", "v", F.round("w", 3).alias("w"))


@query("""SELECT 'kept' AS what, (SELECT count(*) FROM lineitem WHERE l_orderkey % 50 <> 0 AND l_linenumber <> 7 AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 10 <> 3)) AS n
UNION ALL SELECT 'edges: bad w', (SELECT count(*) FROM lineitem WHERE l_orderkey % 50 = 0)
UNION ALL SELECT 'edges: negative weight', (SELECT count(*) FROM lineitem WHERE l_orderkey % 50 <> 0 AND l_linenumber = 7 AND l_suppkey % 10 <> 3)
UNION ALL SELECT 'edges: unknown node', (SELECT count(*) FROM lineitem WHERE l_orderkey % 50 <> 0 AND l_suppkey % 10 = 3)""")
def load_validate(spark, sf):
    """Edge lines made from lineitem, some with a bad or negative weight or an unknown end."""
    s = derive.table(spark, sf, "supplier").where("s_suppkey % 10 <> 3")
    nodes = s.selectExpr("s_suppkey + 2 AS line", "concat(s_suppkey, ', 1.5 ,2') AS text").unionAll(spark.createDataFrame([(1, "id,x,y"), (2, "-1,0,0")], "line long, text string"))
    li = derive.table(spark, sf, "lineitem")
    edges = li.selectExpr("l_orderkey * 10 + l_linenumber + 10 AS line", "concat('-1,', l_suppkey, ',', CASE WHEN l_orderkey % 50 = 0 THEN 'x' WHEN l_linenumber = 7 THEN '-5' ELSE '2.5' END) AS text")
    graph, warnings = sources.read_graph(nodes, edges)
    kind = F.concat("file", F.lit(": "), F.regexp_replace("reason", r" -?\d+$", "")).alias("what")
    found = warnings.groupBy(kind).agg(F.count("*").alias("n"))
    every = spark.createDataFrame([("edges: bad w",), ("edges: negative weight",), ("edges: unknown node",)], "what string")
    counted = every.join(found, "what", "left").select("what", F.coalesce("n", F.lit(0)).alias("n"))
    return graph.edges.agg(F.lit("kept").alias("what"), F.count("*").alias("n")).unionByName(counted)


@query("SELECT a.k AS algorithm, q AS qid, CASE WHEN a.k = 'dial' THEN 'declined' WHEN q >= 100 THEN 'no path' ELSE 'optimal' END AS verdict FROM (VALUES ('dijkstra'), ('bidijkstra'), ('bellmanford'), ('johnson'), ('dial')) a(k), (VALUES (0), (1), (2), (100)) v(q)")
def race(spark, sf):
    g = derive.hierarchy(spark, sf)
    half = kept(Graph(g.nodes, g.edges.withColumn("w", F.col("w") + 0.5)))
    pairs = spark.createDataFrame([(0, 0, 1000), (1, 1000, 0), (2, 1, 1), (100, 0, 77)], "qid int, src long, dst long")
    return harness.race(half, pairs, ["dijkstra", "bidijkstra", "bellmanford", "johnson", "dial"]).select("algorithm", "qid", "verdict")


# ---- through SQL


@query(o.sssp(o.HIERARCHY, "SELECT id, id, 0.0::DOUBLE FROM (SELECT DISTINCT CAST(s_suppkey % 25 AS BIGINT) + 1000 AS id FROM supplier)",
              "SELECT s_suppkey AS qid, r.d AS cost FROM supplier LEFT JOIN r ON r.k = s_suppkey % 25 + 1000 AND r.id = s_suppkey + 1000000"))
def sql_routes(spark, sf):
    """From every supplier to the nation that its key names."""
    publish(kept(derive.hierarchy(spark, sf)), "tree")
    derive.table(spark, sf, "supplier").createOrReplaceTempView("tree_asked")
    return spark.sql(
        "SELECT q.s_suppkey AS qid, min(f.cost + t.cost) AS cost FROM tree_asked q LEFT JOIN tree_from f ON f.id = q.s_suppkey + 1000000 "
        "LEFT JOIN tree_to t ON t.hub = f.hub AND t.id = CAST(q.s_suppkey % 25 AS BIGINT) + 1000 GROUP BY q.s_suppkey"
    )


@query(o.sssp(o.HIERARCHY, "SELECT id, id, 0.0::DOUBLE FROM (SELECT CAST(n_nationkey AS BIGINT) + 1000 AS id FROM nation)",
              "SELECT r.k AS qid, r.id, r.d AS cost FROM r WHERE r.d <= 4"))
def sql_isochrones(spark, sf):
    """What every nation reaches."""
    publish(kept(derive.hierarchy(spark, sf)), "tree")
    derive.table(spark, sf, "nation").selectExpr("CAST(n_nationkey AS bigint) + 1000 AS a").createOrReplaceTempView("tree_asked")
    return spark.sql(
        "SELECT q.a AS qid, t.id, min(f.cost + t.cost) AS cost FROM tree_asked q JOIN tree_from f ON f.id = q.a AND f.cost <= 4 "
        "JOIN tree_to t ON t.hub = f.hub AND f.cost + t.cost <= 4 GROUP BY q.a, t.id"
    )


@query(f"WITH {o.POINTS}, d AS (SELECT id, sqrt(power(x - 0.05, 2) + power(y + 0.02, 2)) AS dist FROM pts) SELECT id, round(dist, 9) AS dist, "
       "coalesce(id = (SELECT arg_min(id, {'d': dist, 'id': id}) FROM d WHERE dist <= 0.2), false) AS closest FROM d WHERE dist <= 0.2")  # fmt: skip
def sql_around(spark, sf):
    publish_places(Graph(derive.plane_points(spark, sf), spark.createDataFrame([], "src long, dst long, w double"), "planar"), "plane")
    return spark.sql(
        "SELECT a.id, round(a.dist, 9) AS dist, n.id IS NOT NULL AS closest FROM plane_around(0.05D, -0.02D, 0.2D) a "
        "LEFT JOIN plane_nearest(0.05D, -0.02D, 0.2D) n ON n.id = a.id"
    )
