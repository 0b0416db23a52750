"""Graphs made from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waygraph.loop import materialise
from waygraph.operators.spatial import k_nearest
from waygraph.tables import Graph

#: Rows of lineitem that a task groups at once: their pairs are nearly all different, so a task's table grows with them.
DEALT = 1_000_000
NO_PLACE = "CAST(NULL AS double) AS x", "CAST(NULL AS double) AS y"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def both_ways(edges: DataFrame) -> DataFrame:
    arc = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"), "w")
    return edges.select(F.inline(F.array(arc("src", "dst"), arc("dst", "src"))))  # what made the edges is run once


def ends_of(edges: DataFrame) -> DataFrame:
    ids = edges.select(F.col("src").alias("id")).unionAll(edges.select(F.col("dst").alias("id"))).distinct()
    return ids.selectExpr("id", *NO_PLACE)


def _sold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") + 10_000_000).alias("src"), F.col("l_partkey").alias("dst"), F.col("l_quantity").alias("w"))


def supplier_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers (+10,000,000) and parts with the least quantity sold, from the supplier only."""
    sold = _sold(spark, sf_dir)
    dealt = sold.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), sold.count() // DEALT + 1), "src", "dst")
    return dealt.groupBy("src", "dst").agg(F.min("w").alias("w"))


def supplier_part(spark: SparkSession, sf_dir: str) -> Graph:
    """The pairs of suppliers and parts, both ways."""
    return Graph(ends_of(_sold(spark, sf_dir)), both_ways(supplier_pairs(spark, sf_dir)))  # a pair's ends are those of its rows


def nation_trade(spark: SparkSession, sf_dir: str) -> Graph:
    """From a supplier's nation to a customer's, by the least extended price."""
    t = lambda n: table(spark, sf_dir, n)
    sold = (
        t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .where("s_nationkey <> c_nationkey")
    )
    edges = sold.groupBy(F.col("s_nationkey").cast("long").alias("src"), F.col("c_nationkey").cast("long").alias("dst")).agg(
        F.min("l_extendedprice").alias("w")
    )
    edges = materialise(edges, "trade")  # a row for each pair of nations, from three joins
    return Graph(ends_of(edges), edges)


def lattice_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arcs from k to k + 1 in a row of 25 parts, and from k to k + 25; w is the size of the part k."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("src"), F.col("p_size").cast("double").alias("w"))
    steps = p.withColumn("dst", F.explode(F.when(F.col("src") % 25 < 24, F.array(F.col("src") + 1, F.col("src") + 25)).otherwise(F.array(F.col("src") + 25))))
    # dealt by dst, as a small file of many parts is read by one task
    return steps.join(p.select(F.col("src").alias("dst")).hint("merge"), "dst", "left_semi").select("src", "dst", "w")


def lattice_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "CAST(p_partkey % 25 AS double) AS x", "CAST(p_partkey div 25 AS double) AS y")


def part_lattice(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph(lattice_nodes(spark, sf_dir), both_ways(lattice_arcs(spark, sf_dir)), "planar")


def oneway_lattice(spark: SparkSession, sf_dir: str) -> Graph:
    edges = both_ways(lattice_arcs(spark, sf_dir)).where("(src * src + 3 * dst) % 7 <> 0")
    return Graph(lattice_nodes(spark, sf_dir), edges, "planar")


def rows_lattice(spark: SparkSession, sf_dir: str) -> Graph:
    """Rows both ways, columns only downwards: each row is a strong component."""
    edges = both_ways(lattice_arcs(spark, sf_dir)).where("abs(src - dst) = 1 OR dst = src + 25")
    return Graph(lattice_nodes(spark, sf_dir), edges, "planar")


def hierarchy(spark: SparkSession, sf_dir: str) -> Graph:
    """Region, nation (+1,000) and supplier (+1,000,000) tree, with chains of a nation's consecutive suppliers."""
    nation = table(spark, sf_dir, "nation").selectExpr("CAST(n_regionkey AS bigint) AS src", "CAST(n_nationkey AS bigint) + 1000 AS dst", "1.0D AS w")
    s = table(spark, sf_dir, "supplier")
    leaf = s.selectExpr("CAST(s_nationkey AS bigint) + 1000 AS src", "s_suppkey + 1000000 AS dst", "2.0D AS w")
    chain = s.selectExpr(
        "s_suppkey + 1000000 AS src",
        "lead(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) + 1000000 AS dst",
        "CAST(1 + s_suppkey % 5 AS double) AS w",
    ).where("dst IS NOT NULL AND (src - 1000000) % 3 <> 0")
    edges = both_ways(nation.unionAll(leaf).unionAll(chain))
    return Graph(ends_of(edges), edges)


def plane_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id AS id", "CAST(embedding[0] AS double) AS x", "CAST(embedding[1] AS double) AS y")


def embedding_plane(spark: SparkSession, sf_dir: str, k: int = 4) -> Graph:
    """The first two coordinates of the vectors, each joined both ways with its k nearest."""
    nodes = plane_points(spark, sf_dir)
    near = k_nearest(nodes.select(F.col("id").alias("qid"), F.col("x").alias("qx"), F.col("y").alias("qy")), nodes, k, skip_self=True)
    pairs = near.groupBy(F.least("qid", "id").alias("src"), F.greatest("qid", "id").alias("dst")).agg(F.min("dist").alias("w"))
    return Graph(nodes, both_ways(pairs), "planar")
