"""DuckDB SQL of the derived graphs, to be put before a query's own SQL."""

SUPPLIER_PART = """e0 AS (SELECT l_suppkey + 10000000 AS s, l_partkey AS t, min(l_quantity) AS w FROM lineitem GROUP BY 1, 2),
e AS (SELECT s, t, w FROM e0 UNION ALL SELECT t, s, w FROM e0)"""

NATION_TRADE = """e AS (SELECT CAST(s_nationkey AS BIGINT) AS s, CAST(c_nationkey AS BIGINT) AS t, min(l_extendedprice) AS w
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
 WHERE s_nationkey <> c_nationkey GROUP BY 1, 2)"""

LATTICE_ARCS = """arcs AS (SELECT a.p_partkey AS s, b.p_partkey AS t, CAST(a.p_size AS DOUBLE) AS w FROM part a JOIN part b
 ON b.p_partkey = a.p_partkey + 25 OR (b.p_partkey = a.p_partkey + 1 AND a.p_partkey % 25 < 24))"""
LATTICE = LATTICE_ARCS + """, e AS (SELECT s, t, w FROM arcs UNION ALL SELECT t, s, w FROM arcs)"""
ONEWAY = LATTICE_ARCS + """, e AS (SELECT * FROM (SELECT s, t, w FROM arcs UNION ALL SELECT t, s, w FROM arcs) WHERE (s * s + 3 * t) % 7 <> 0)"""
ROWS = LATTICE_ARCS + """, e AS (SELECT * FROM (SELECT s, t, w FROM arcs UNION ALL SELECT t, s, w FROM arcs) WHERE abs(s - t) = 1 OR t = s + 25)"""

HIERARCHY = """h0 AS (SELECT CAST(n_regionkey AS BIGINT) AS s, CAST(n_nationkey AS BIGINT) + 1000 AS t, 1.0::DOUBLE AS w FROM nation
 UNION ALL SELECT CAST(s_nationkey AS BIGINT) + 1000, s_suppkey + 1000000, 2.0::DOUBLE FROM supplier
 UNION ALL SELECT a + 1000000, b + 1000000, CAST(1 + a % 5 AS DOUBLE) FROM
  (SELECT s_suppkey AS a, lead(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS b FROM supplier) WHERE b IS NOT NULL AND a % 3 <> 0),
e AS (SELECT s, t, w FROM h0 UNION ALL SELECT t, s, w FROM h0)"""

POINTS = """pts AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)"""
PLANE = POINTS + """, nn AS (SELECT a.id AS s, b.id AS t, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS w,
  row_number() OVER (PARTITION BY a.id ORDER BY sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), b.id) AS r FROM pts a JOIN pts b ON a.id <> b.id),
p0 AS (SELECT least(s, t) AS s, greatest(s, t) AS t, min(w) AS w FROM nn WHERE r <= 4 GROUP BY 1, 2),
e AS (SELECT s, t, w FROM p0 UNION ALL SELECT t, s, w FROM p0)"""


def sssp(graph: str, seeds: str, select: str, weight: str = "e.w") -> str:
    """Least labels by recursion with one row a key; seeds: SELECT k, id, d."""
    return f"""WITH RECURSIVE {graph}, seeds(k, id, d) AS ({seeds}), r(k, id, d) USING KEY (k, id) AS (
 SELECT k, id, d FROM seeds UNION (SELECT r.k, e.t, min(r.d + {weight}) FROM r JOIN e ON e.s = r.id
  LEFT JOIN recurring.r p ON p.k = r.k AND p.id = e.t GROUP BY r.k, e.t, p.d HAVING min(r.d + {weight}) < coalesce(p.d, 'infinity'::DOUBLE)))
{select}"""
