"""Sinks: JSON documents of traces, isochrones and graphs, ordered tables, geometry buffers and CSV files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waygraph.functions.order import running_total
from waygraph.loop import materialise
from waygraph.operators.etl import dense_ids
from waygraph.tables import Graph

NULLS = {"ignoreNullFields": "false"}


def json_number(x: Column) -> Column:
    """A double of ten significant digits; null where it is not finite."""
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.when(finite, F.format_string("%.9e", x).cast("double"))


def trace_documents(events: DataFrame, found: DataFrame) -> DataFrame:
    """(qid, document): one JSON text for each query, with the events (op, node, parent) in the order of step, node and op.

    found(qid, algorithm, cost, path, closed array of edges). A document holds
    one search; traces that no reader holds as one text stay tables.
    """
    triple = F.transform(F.array_sort("e"), lambda x: F.array(x["op"].cast("long"), x["node"], F.coalesce(x["parent"], F.lit(-1).cast("long"))))
    of = events.groupBy("qid").agg(F.collect_list(F.struct("step", "node", "op", "parent")).alias("e"))
    met = found.join(of, "qid", "left")
    expanded = F.size(F.filter("e", lambda x: x["op"] == 1))
    document = F.struct(
        F.lit(2).alias("formatVersion"),
        F.struct(
            "algorithm", F.coalesce(expanded, F.lit(0)).alias("nodesExpanded"), json_number(F.col("cost")).alias("pathCost"),
            F.coalesce(F.size("path"), F.lit(0)).alias("pathLength"), F.col("path").isNotNull().alias("success"),
        ).alias("metadata"),
        F.coalesce("path", F.expr("CAST(array() AS array<bigint>)")).alias("path"),
        F.coalesce("closed", F.expr("CAST(array() AS array<bigint>)")).alias("closedEdges"),
        F.create_map(F.lit("0"), F.lit("discover"), F.lit("1"), F.lit("expand"), F.lit("2"), F.lit("relax")).alias("eventLegend"),
        F.coalesce(triple, F.expr("CAST(array() AS array<array<bigint>>)")).alias("events"),
    )
    return met.select("qid", F.to_json(document, NULLS).alias("document"))


def isochrone_documents(bands: DataFrame, hulls: DataFrame) -> DataFrame:
    """(origin, document) of bands(origin, cutoff, id) and the corners hulls(origin, cutoff, k, x, y) in order."""
    sizes = bands.groupBy("origin", "cutoff").agg(F.count("*").alias("count"))
    corners = hulls.groupBy("origin", "cutoff").agg(F.array_sort(F.collect_list(F.struct("k", "x", "y"))).alias("c"))
    both = sizes.join(corners, ["origin", "cutoff"], "left")
    hull = F.transform("c", lambda p: F.array(json_number(p["x"]), json_number(p["y"])))
    one = F.struct(json_number(F.col("cutoff")).alias("cutoff"), "count", F.coalesce(hull, F.expr("CAST(array() AS array<array<double>>)")).alias("hull"))
    of = both.groupBy("origin").agg(F.array_sort(F.collect_list(one)).alias("bands"))  # a row for each cutoff
    return of.select("origin", F.to_json(F.struct("origin", "bands"), NULLS).alias("document"))


def graph_lines(graph: Graph) -> tuple[DataFrame, DataFrame]:
    """JSON lines (line) of the nodes, with dense and own ids, and of the edges between dense ids."""
    dense = dense_ids(graph.nodes)
    nodes = graph.nodes.join(dense, "id").select(F.to_json(F.struct(F.col("dense").alias("id"), F.col("id").alias("ext"), json_number(F.col("x")).alias("x"), json_number(F.col("y")).alias("y")), NULLS).alias("line"))
    own = lambda c: dense.select(F.col("id").alias(c), F.col("dense").alias(f"d{c}"))
    ends = graph.edges.join(own("src"), "src").join(own("dst"), "dst")
    return nodes, ends.select(F.to_json(F.struct(F.col("dsrc").alias("u"), F.col("ddst").alias("v"), json_number(F.col("w")).alias("w")), NULLS).alias("line"))


def coordinates(graph: Graph) -> DataFrame:
    """(x, y) in the order of ids, sorted by ranges."""
    return graph.nodes.select("id", "x", "y").orderBy("id")


def edge_list(graph: Graph) -> DataFrame:
    """(src, dst, w) in the order of edge ids where there are any, else of the ends."""
    keys = ["eid"] if "eid" in graph.edges.columns else ["src", "dst", "w"]
    return graph.edges.orderBy(*keys).select("src", "dst", "w")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            xy = b.select(["x", "y"]).to_pandas().to_numpy("<f8")
            yield pa.record_batch([b.column(0).slice(0, 1), pa.array([b.num_rows], pa.int64()), pa.array([xy.tobytes()], pa.binary())], ["first", "n", "xy"])


def geometry_buffers(graph: Graph) -> DataFrame:
    """(first, n, xy): runs of the nodes by id, n of them from the id `first` on, as pairs of little-endian doubles."""
    return graph.nodes.select("id", "x", "y").repartitionByRange("id").sortWithinPartitions("id").mapInArrow(_pack, "first long, n long, xy binary")


def _pack_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            uv = b.select(["u", "v"]).to_pandas().to_numpy("<i4")
            yield pa.record_batch([b.column(0).slice(0, 1), pa.array([b.num_rows], pa.int64()), pa.array([uv.tobytes()], pa.binary())], ["first", "n", "uv"])


def edge_buffers(graph: Graph) -> DataFrame:
    """(first, n, uv): runs of the edges by (src, dst), n of them from the source `first` on, as pairs of little-endian 32-bit places of their ends in `geometry_buffers`' order."""
    placed = materialise(running_total(graph.nodes.select("id"), "id", F.lit(1).cast("long"), "at").select("id", "at"), "places")
    at = lambda end, name: placed.select(F.col("id").alias(end), F.col("at").cast("int").alias(name))  # noqa: E731  (more than 2^31 nodes is an error)
    pairs = graph.edges.select("src", "dst").join(at("src", "u"), "src").join(at("dst", "v"), "dst").select("src", "u", "v")
    return pairs.repartitionByRange("u", "v").sortWithinPartitions("u", "v").mapInArrow(_pack_pairs, "first long, n long, uv binary")


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV files with headers, quotes doubled inside quotes."""
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_network(graph: Graph, path: str, name: str, **facts) -> None:
    """`nodes` and `edges` as CSV below the path, metres to two decimals, and a `manifest` of one JSON line with the counts."""
    write_csv(graph.nodes.select("id", "x", "y"), f"{path}/nodes")
    write_csv(graph.edges.select("src", "dst", F.round("w", 2).alias("w")), f"{path}/edges")
    counts = graph.nodes.agg(F.count("*").alias("nodes")).crossJoin(graph.edges.agg(F.count("*").alias("edges")))  # one row each
    counts.select(F.lit(name).alias("name"), *[F.lit(v).alias(k) for k, v in facts.items()], "nodes", "edges").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
