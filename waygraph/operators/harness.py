"""The registry of search algorithms, and tables that hold them against one another."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waygraph.functions.order import running_total
from waygraph.loop import materialise
from waygraph.operators import index, paths
from waygraph.operators.analysis import strong_components
from waygraph.operators.greedy import greedy
from waygraph.tables import Graph

Run = Callable[[Graph, DataFrame], DataFrame | None]


@dataclass(frozen=True)
class Algorithm:
    """run: (graph, pairs(qid, src, dst)) to (qid, cost), or None where it declines."""

    key: str
    run: Run
    optimal: bool = True
    negative: bool = False
    needs_places: bool = False


REGISTRY: dict[str, Algorithm] = {}


def register(key: str, run: Run, optimal: bool = True, negative: bool = False, needs_places: bool = False) -> None:
    REGISTRY[key] = Algorithm(key, run, optimal, negative, needs_places)


def _from_sources(search):
    def run(graph: Graph, pairs: DataFrame) -> DataFrame | None:
        found = search(graph, pairs.select("qid", F.col("src").alias("id")))
        return None if found is None else pairs.join(found.withColumnRenamed("id", "dst"), ["qid", "dst"], "left").select("qid", "cost")

    return run


def _from_table(search):
    def run(graph: Graph, pairs: DataFrame) -> DataFrame | None:
        found = search(graph)
        return None if found is None else pairs.join(found, ["src", "dst"], "left").select("qid", "cost")

    return run


register("dijkstra", paths.pair_costs)
register("astar", lambda g, p: paths.pair_costs(g, p, goal_directed=True), needs_places=True)
register("bidijkstra", paths.bidirectional_costs)
register("dial", _from_sources(paths.dial))
register("bellmanford", _from_sources(lambda g, s: (lambda r: r[0] if r[1] else None)(paths.bellman_ford(g, s))), negative=True)
register("johnson", _from_sources(paths.johnson), negative=True)
register("floydwarshall", _from_table(paths.all_pairs), negative=True)
register("bfs", paths.fewest_hops, optimal=False)
register("greedy", lambda g, p: greedy(g, p).select("qid", "cost"), optimal=False, needs_places=True)
register("alt", lambda g, p: index.Landmarks.build(g, 4).pair_costs(p))
register("ch", lambda g, p: index.Contraction.build(g).pair_costs(p))
register("cch", lambda g, p: index.Hierarchy.build(g).customise().pair_costs(p))


def algorithms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a.key, a.optimal, a.negative, a.needs_places) for a in REGISTRY.values()], "key string, optimal boolean, negative boolean, needs_places boolean")


def route(graph: Graph, pairs: DataFrame, key: str = "dijkstra", closures: DataFrame | None = None) -> DataFrame | None:
    """(qid, cost) of pairs(qid, src, dst) by a registered algorithm on the roads that closures(u, v) leave open; None where it declines."""
    open_ = graph if closures is None else graph.close(closures)
    return None if REGISTRY[key].needs_places and graph.space is None else REGISTRY[key].run(open_, pairs)


def race(graph: Graph, pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(algorithm, qid, cost, verdict): optimal (within 1e-6 of the best that claims to be), suboptimal, no path, or declined."""
    out = None
    for key in keys or list(REGISTRY):
        a = REGISTRY[key]
        found = None if a.needs_places and graph.space is None else a.run(graph, pairs)
        rows = pairs.select("qid", F.lit(None).cast("double").alias("cost"), F.lit(True).alias("declined")) if found is None else found.withColumn("declined", F.lit(False))
        rows = rows.withColumns({"algorithm": F.lit(key), "claims": F.lit(a.optimal)})
        out = rows if out is None else out.unionByName(rows)
    out = materialise(out, "race")
    best = out.where("claims").groupBy("qid").agg(F.min("cost").alias("best"))
    verdict = F.when(F.col("declined"), "declined").when(F.col("cost").isNull(), "no path").when(F.col("cost") <= F.col("best") + 1e-6, "optimal").otherwise("suboptimal")
    return out.join(best, "qid", "left").select("algorithm", "qid", "cost", verdict.alias("verdict"))


def default_endpoints(graph: Graph) -> DataFrame:
    """(src, dst): the nodes at 15 % and 85 % of the largest strong component, by ids; of equal ones that with the smallest id."""
    of = materialise(strong_components(graph), "scc")
    largest = of.groupBy("component").agg(F.count("*").alias("n")).agg(F.min(F.struct(-F.col("n"), "component")).alias("l")).select("l.component")
    inside = running_total(of.join(largest, "component", "left_semi").select("id"), "id", F.lit(1), "k")
    many = inside.agg(F.count("*").alias("n"))
    at = lambda share: F.max(F.when(F.col("k") == F.floor(F.col("n") * share), F.col("id")))
    return inside.crossJoin(F.broadcast(many)).agg(at(0.15).alias("src"), at(0.85).alias("dst"))  # one row


def auto_cutoffs(routes: DataFrame) -> DataFrame:
    """(qid, cutoff): a quarter, six tenths and the whole of each route's cost."""
    return routes.where("cost IS NOT NULL").select("qid", F.explode(F.array(*[F.col("cost") * share for share in (0.25, 0.6, 1.0)])).alias("cutoff"))


def mid_route(paths_: DataFrame) -> DataFrame:
    """(qid, u, v): the middle road of each path(qid, path), to be closed."""
    mid = F.expr("size(path) div 2").cast("int")
    return paths_.where("size(path) >= 2").select("qid", F.get("path", mid - 1).alias("u"), F.get("path", mid).alias("v"))


def verify(graph: Graph, samples: int = 50, seed: int = 12345, keys: list[str] | None = None) -> DataFrame:
    """(algorithm, pairs, mismatches) over pairs of nodes drawn by a hash; costs must agree to 1e-6, relatively."""
    drawn = lambda part: graph.nodes.select("id").orderBy(F.xxhash64("id", F.lit(seed), F.lit(part))).limit(samples)
    pairs = list(zip(*([r["id"] for r in drawn(part).collect()] for part in "ab")))  # `samples` ids
    spark = graph.nodes.sparkSession
    asked = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "qid int, src long, dst long")
    raced = race(graph, asked, keys)
    low = raced.groupBy("qid").agg(F.min("cost").alias("low"))
    off = F.abs(F.col("cost") - F.col("low")) > 1e-6 * F.greatest(F.lit(1.0), F.col("low"))
    wrong = (F.col("verdict") != "declined") & (F.col("cost").isNull() != F.col("low").isNull())
    return raced.join(low, "qid").groupBy("algorithm").agg(F.count("*").alias("pairs"), F.sum((F.coalesce(off, F.lit(False)) | wrong).cast("long")).alias("mismatches"))
