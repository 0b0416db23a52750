"""Readers with validation: node, edge and station files, and text already in memory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waygraph.functions.order import running_total
from waygraph.loop import materialise
from waygraph.tables import Graph


class InputError(ValueError):
    """The first rejected line of an input that is read strictly."""


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(line, text, head) of text files: numbers run on in the files' order by path; head marks a file's first line."""
    raw = spark.read.text(path).select(
        F.col("value").alias("text"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"),
    )
    # Spark deals a file's blocks in any order, but keeps the order within one
    blocks = raw.groupBy("file", "start").agg(F.count("*").alias("n"))
    earlier = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    before = blocks.select("file", "start", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("file", "start").orderBy("at"))
    rows = raw.withColumn("place", place).join(before, ["file", "start"])
    return rows.select((F.col("place") + F.col("before")).cast("long").alias("line"), "text", ((F.col("start") == 0) & (F.col("place") == 1)).alias("head"))


def lines_in(spark: SparkSession, text: str) -> DataFrame:
    """(line, text) of text that is given as a value."""
    return spark.createDataFrame([(k + 1, x) for k, x in enumerate(text.split("\n"))], "line long, text string")


def _fields(lines: DataFrame, names: list[str], kinds: list[str], least: int) -> DataFrame:
    """Trimmed fields cast without exceptions; `reason` says what is wrong with a row. A first row (of each file) without a number is a header."""
    rows = lines.withColumn("text", F.trim("text")).where("text <> ''")
    parts = F.split("text", ",")
    rows = rows.withColumn("p", parts)
    if "head" not in lines.columns:
        rows = rows.crossJoin(F.broadcast(rows.agg(F.min("line").alias("least")))).withColumn("head", F.col("line") == F.col("least"))  # one row
    rows = rows.where(~(F.col("head") & F.expr("try_cast(trim(get(p, 0)) AS bigint) IS NULL")))
    cells = {n: F.expr(f"try_cast(trim(get(p, {k})) AS {kind})") for k, (n, kind) in enumerate(zip(names, kinds))}
    bad = F.when(F.size("p") < least, F.lit("too few fields"))
    for k, n in enumerate(names):
        given = F.coalesce(F.expr(f"trim(get(p, {k})) <> ''"), F.lit(False))
        bad = F.coalesce(bad, F.when((given if k >= least else F.lit(True)) & cells[n].isNull(), F.lit(f"bad {n}")))
    return rows.select("line", *[c.alias(n) for n, c in cells.items()], bad.alias("reason"))


def read_graph(nodes: DataFrame, edges: DataFrame, space: str = "planar", lenient: bool = True, allow_negative: bool = False) -> tuple[Graph, DataFrame]:
    """A graph from lines (line, text) of `id,x,y` and `u,v[,w]`, with the warnings (file, line, reason).

    The first of several nodes with an id stands; a missing weight is 1; edges
    need known ends and a finite weight, not below 0 unless allowed. Edges are
    numbered (eid) by their source's first line, then in file order. Strict
    reading raises InputError with the first bad line; so does a file without nodes.
    """
    n = materialise(_fields(nodes, ["id", "x", "y"], ["bigint", "double", "double"], 3), "nodes")
    good = n.where("reason IS NULL").groupBy("id").agg(F.min("line").alias("first"), F.min_by("x", "line").alias("x"), F.min_by("y", "line").alias("y"))
    e = _fields(edges, ["src", "dst", "w"], ["bigint", "bigint", "double"], 2).withColumn("w", F.coalesce("w", F.lit(1.0)))
    known = good.select("id", F.lit(True).alias("known"))
    e = e.join(known.toDF("src", "ks"), "src", "left").join(known.toDF("dst", "kd"), "dst", "left")
    missing = F.when(F.col("ks").isNull(), F.col("src")).otherwise(F.col("dst"))
    reason = (
        F.when(F.col("reason").isNotNull(), F.col("reason"))
        .when(F.col("ks").isNull() | F.col("kd").isNull(), F.concat(F.lit("unknown node "), missing.cast("string")))
        .when(F.isnan("w") | (F.abs("w") == float("inf")), F.lit("weight is not finite"))
    )
    if not allow_negative:
        reason = reason.when(F.col("w") < 0, F.lit("negative weight"))
    e = materialise(e.select("line", "src", "dst", "w", reason.alias("reason")), "edges")
    warnings = n.where("reason IS NOT NULL").select(F.lit("nodes").alias("file"), "line", "reason").unionAll(
        e.where("reason IS NOT NULL").select(F.lit("edges").alias("file"), "line", "reason")
    )
    if not lenient and (bad := warnings.orderBy(F.desc("file"), "line").first()):
        raise InputError(f"{bad['file']}:{bad['line']}: {bad['reason']}")
    if good.isEmpty():
        raise InputError("nodes: there is no node")
    kept = e.where("reason IS NULL").join(good.select(F.col("id").alias("src"), "first"), "src")
    eid = F.row_number().over(Window.partitionBy("src").orderBy("line"))
    of_source = kept.groupBy("src").agg(F.count("*").alias("n"), F.min("first").alias("first"))
    before = running_total(of_source, "first", F.col("n")).select("src", "before")
    out = kept.join(before, "src").withColumn("eid", (eid - 1 + F.col("before")).cast("long"))
    return Graph(good.select("id", "x", "y"), out.select("eid", "src", "dst", "w"), space), warnings


def read_graph_dir(spark: SparkSession, path: str, **options) -> tuple[Graph, DataFrame]:
    """`nodes.csv` and `edges.csv` in a folder."""
    return read_graph(lines_of(spark, f"{path}/nodes.csv"), lines_of(spark, f"{path}/edges.csv"), **options)


def from_rows(spark: SparkSession, nodes: list, edges: list, geographic: bool = False) -> Graph:
    """A graph from sequences of (id, x, y) and (u, v[, w]), read strictly."""
    n = spark.createDataFrame([(k + 1, ",".join(map(str, x))) for k, x in enumerate(nodes)], "line long, text string")
    e = spark.createDataFrame([(k + 1, ",".join(map(str, x))) for k, x in enumerate(edges)], "line long, text string")
    return read_graph(n, e, "geographic" if geographic else "planar", lenient=False)[0]


#: The columns of transit files.
STATION_FIELDS = "id long, name string, system string, city string, lat double, lon double"
LINK_FIELDS = "`from` long, to long, line string, seconds double"


def _known_links(stations: DataFrame, links: DataFrame) -> DataFrame:
    from waygraph.operators.transit import check_links

    good, bad = check_links(stations, links)
    if first := bad.first():
        raise InputError(f"links: unknown station in {first['from']} to {first['to']}")
    return good.select("from", "to", "line", "seconds")


def read_transit(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """`stations.csv` and `links.csv` with quoted fields, read strictly: a link to an unknown station raises InputError."""
    read = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("mode", "FAILFAST")
    stations = read.schema(STATION_FIELDS).csv(f"{path}/stations.csv")
    return stations, _known_links(stations, read.schema(LINK_FIELDS).csv(f"{path}/links.csv"))


def read_transit_lines(stations: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Like `read_transit`, from lines(line, text) of the two files, line 1 being the header; a field must not hold a line feed."""
    how = {"quote": '"', "escape": '"', "mode": "FAILFAST"}
    parsed = lambda lines, fields: lines.where("line > 1 AND trim(text) <> ''").select(F.from_csv("text", fields, how).alias("r")).select("r.*")
    known = parsed(stations, STATION_FIELDS)
    return known, _known_links(known, parsed(links, LINK_FIELDS))


def grid(spark: SparkSession, width: int, height: int) -> Graph:
    """A generated grid: ids r * width + c, four neighbours, integer weights 1 to 5."""
    nodes = spark.range(width * height).selectExpr("id", f"CAST(id % {width} AS double) AS x", f"CAST({height} - 1 - id div {width} AS double) AS y")
    right = nodes.where(f"id % {width} < {width - 1}").select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    down = nodes.where(f"id div {width} < {height - 1}").select(F.col("id").alias("src"), (F.col("id") + width).alias("dst"))
    one_way = right.unionAll(down).withColumn("w", (F.pmod(F.xxhash64("src", "dst"), F.lit(5)) + 1).cast("double"))
    return Graph(nodes, one_way.unionAll(one_way.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")), "planar")


def random_connected(spark: SparkSession, n: int, extra: int, seed: int = 1) -> Graph:
    """A generated graph: a random tree with extra edges, weights the straight line times 1.05 to 1.35."""
    unit = lambda *c: F.pmod(F.xxhash64(*c, F.lit(seed)), F.lit(1_000_003)) / 1_000_003.0
    nodes = spark.range(n).select("id", (unit("id", F.lit("x")) * 100).alias("x"), (unit("id", F.lit("y")) * 100).alias("y"))
    tree = spark.range(1, n).select(F.col("id").alias("src"), F.floor(unit("id", F.lit("up")) * F.col("id")).cast("long").alias("dst"))
    more = spark.range(extra).select(F.floor(unit("id", F.lit("a")) * n).cast("long").alias("src"), F.floor(unit("id", F.lit("b")) * n).cast("long").alias("dst")).where("src <> dst")
    pairs = Graph(nodes, tree.unionAll(more).withColumn("w", F.lit(1.0)), "planar").straight()
    one_way = pairs.select("src", "dst", (F.col("straight") * (1.05 + 0.3 * unit("src", "dst"))).alias("w"))
    return Graph(nodes, one_way.unionAll(one_way.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")), "planar")


def write_graph(graph: Graph, path: str) -> None:
    """`nodes` and `edges` below the path as JSON lines, in as many files as there are tasks."""
    graph.nodes.write.mode("overwrite").json(f"{path}/nodes")
    graph.edges.write.mode("overwrite").json(f"{path}/edges")


def catalog(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(name, nodes, edges) of the Parquet graphs at the paths; what can't be read has nulls."""
    rows = []
    for name, path in paths.items():
        try:
            rows.append((name, spark.read.parquet(f"{path}/nodes").count(), spark.read.parquet(f"{path}/edges").count()))
        except Exception:  # a missing or broken network is listed, not fatal
            rows.append((name, None, None))
    return spark.createDataFrame(rows, "name string, nodes long, edges long")
