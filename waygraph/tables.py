"""A graph is a pair of DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waygraph.functions.geo import straight_line


@dataclass(frozen=True)
class Graph:
    """nodes(id, x, y) and directed edges(src, dst, w), parallels allowed; space is `planar`, `geographic` or None.

    In geographic space x is the longitude and y the latitude, weights are metres.
    """

    nodes: DataFrame
    edges: DataFrame
    space: str | None = None

    def reverse(self) -> Graph:
        return replace(self, edges=self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))

    def undirected(self) -> DataFrame:
        """Simple undirected pairs (u < v) with the least weight; self-loops are dropped."""
        return (
            self.edges.where("src <> dst")
            .groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"))
            .agg(F.min("w").alias("w"))
        )

    def close(self, closures: DataFrame) -> Graph:
        """Without all parallel arcs, in both directions, of the roads in closures(u, v)."""
        both = closures.select("u", "v").unionAll(closures.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
        open_ = self.edges.join(both, (F.col("src") == F.col("u")) & (F.col("dst") == F.col("v")), "left_anti")
        return replace(self, edges=open_)

    def stats(self) -> DataFrame:
        """Counts, the least positive weight (1.0 if there is none) and the largest out-degree."""
        degree = self.edges.groupBy("src").agg(F.count("*").alias("d")).agg(F.coalesce(F.max("d"), F.lit(0)).alias("max_degree"))
        weights = self.edges.agg(
            F.count("*").alias("edges"), F.coalesce(F.min(F.when(F.col("w") > 0, F.col("w"))), F.lit(1.0)).alias("min_w")
        )
        return self.nodes.agg(F.count("*").alias("nodes")).crossJoin(weights).crossJoin(degree)  # one row each

    def fingerprint(self) -> DataFrame:
        """One row that changes when the graph does; indices are keyed by it, never by an object's address."""
        return self.edges.agg(F.count("*").alias("edges"), F.bit_xor(F.xxhash64("src", "dst", "w")).alias("fingerprint"))

    def straight(self) -> DataFrame:
        """Edges with the straight-line distance of their ends."""
        a = self.nodes.select(F.col("id").alias("src"), F.col("x").alias("ax"), F.col("y").alias("ay"))
        b = self.nodes.select(F.col("id").alias("dst"), F.col("x").alias("bx"), F.col("y").alias("by"))
        d = straight_line(self.space or "planar", F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
        return self.edges.join(a, "src").join(b, "dst").select("src", "dst", "w", d.alias("straight"))

    def admissibility(self, tolerance: float = 0.01) -> DataFrame:
        """Least ratio of weight to straight line (1.0 without such edges), worst shortfall, and whether A* may trust the line."""
        s = self.straight()
        ratio = F.min(F.when(F.col("straight") > 1e-12, F.col("w") / F.col("straight")))
        short = F.coalesce(F.max(F.greatest(F.lit(0.0), F.col("straight") - F.col("w"))), F.lit(0.0))
        return s.agg(F.coalesce(ratio, F.lit(1.0)).alias("min_ratio"), short.alias("shortfall")).withColumn(
            "admissible", F.col("shortfall") <= tolerance
        )
