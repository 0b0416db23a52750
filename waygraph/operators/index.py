"""Reusable speed-up indices: landmarks, and contraction hierarchies that can be re-weighted without a rebuild."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waygraph.loop import materialise, release, shared_dir
from waygraph.operators.analysis import strong_components
from waygraph.operators.paths import _loop, both_sides, cheapest, costs
from waygraph.operators.trees import meeting_paths
from waygraph.tables import Graph


@dataclass(frozen=True)
class Landmarks:
    """table(landmark, id, d_from, d_to): least costs from and to each landmark; null where there is no path."""

    graph: Graph
    table: DataFrame

    @classmethod
    def build(cls, graph: Graph, k: int = 12, seed: int = 0) -> Landmarks:
        """k landmarks in the largest strong component, each the node farthest from those before (ties: the smallest id)."""
        spark = graph.nodes.sparkSession
        scc = materialise(strong_components(graph), "scc")
        sizes = scc.groupBy("component").agg(F.count("*").alias("n"))
        largest = sizes.orderBy(F.desc("n"), "component").first()
        inside = scc.where(F.col("component") == largest["component"]).select("id")
        skip = seed % largest["n"]
        marks = [inside.orderBy("id").limit(skip + 1).agg(F.max("id")).first()[0]]
        table = None
        while True:
            at = spark.createDataFrame([(0, marks[-1])], "qid int, id long")
            there = costs(graph, at).select("id", F.col("cost").alias("d_from"))
            back = costs(graph.reverse(), at).select("id", F.col("cost").alias("d_to"))
            one = materialise(there.join(back, "id", "full").withColumn("landmark", F.lit(marks[-1]).cast("long")), "landmark")
            table = one if table is None else table.unionByName(one)
            if len(marks) == min(k, largest["n"]):
                return cls(graph, table.select("landmark", "id", "d_from", "d_to"))
            far = table.join(inside, "id").groupBy("id").agg(F.min("d_from").alias("d"))
            marks.append(far.agg(F.max_by("id", F.struct("d", -F.col("id")))).first()[0])

    def lower_bounds(self, pairs: DataFrame) -> DataFrame:
        """(v, t, bound): no path from v to t is cheaper."""
        a = self.table.select("landmark", F.col("id").alias("v"), F.col("d_from").alias("fv"), F.col("d_to").alias("tv"))
        b = self.table.select("landmark", F.col("id").alias("t"), F.col("d_from").alias("ft"), F.col("d_to").alias("tt"))
        met = pairs.select("v", "t").distinct().join(a, "v", "left").join(b, ["landmark", "t"], "left")
        best = F.greatest(F.lit(0.0), F.max(F.col("tv") - F.col("tt")), F.max(F.col("ft") - F.col("fv")))
        return met.groupBy("v", "t").agg(best.alias("bound"))

    def pair_costs(self, pairs: DataFrame, max_rounds: int = 10_000) -> DataFrame:
        """(qid, cost) of pairs(qid, src, dst); labels that the bound rules out go no further."""
        goal = pairs.select("qid", F.col("dst").alias("goal"))

        def bound(front: DataFrame, state: DataFrame) -> DataFrame:
            best = goal.join(state.select("qid", F.col("id").alias("goal"), F.col("d").alias("best")), ["qid", "goal"], "left")
            front = front.join(best, "qid")
            low = self.lower_bounds(front.select(F.col("id").alias("v"), F.col("goal").alias("t")))
            front = front.join(low.select(F.col("v").alias("id"), F.col("t").alias("goal"), "bound"), ["id", "goal"], "left")
            return front.where(F.col("best").isNull() | (F.col("d") + F.col("bound") * (1 - 1e-9) < F.col("best"))).select("qid", "id", "d")

        start = pairs.select("qid", F.col("src").alias("id"), F.lit(0.0).alias("d"))
        labels, _ = _loop(cheapest(self.graph), start, F.col("d") + F.col("w"), max_rounds, bound)
        found = goal.select("qid", F.col("goal").alias("id")).join(labels, ["qid", "id"])
        return pairs.select("qid").join(found.select("qid", F.col("d").alias("cost")), "qid", "left")


def _meeting_costs(ahead: DataFrame, back: DataFrame, pairs: DataFrame, max_rounds: int) -> DataFrame:
    """(qid, cost): both ends climb over arcs(src, dst, w), back's turned round, and the cheapest meeting counts."""
    a, b = both_sides(ahead, back, pairs, F.lit(0.0), F.col("d") + F.col("w"), F.col("d"), max_rounds)
    met = a.withColumnRenamed("d", "a").join(b.withColumnRenamed("d", "b"), ["qid", "id"])
    best = met.groupBy("qid").agg(F.min(F.col("a") + F.col("b")).alias("cost"))
    return pairs.select("qid").join(best, "qid", "left")


@dataclass(frozen=True)
class Contraction:
    """A contraction hierarchy with witness search: ahead(src, dst, w, n, mid) climbs from sources, back (turned round) from targets.

    mid is the node that a shortcut leaves out, n the arcs that it stands for.
    Nodes that are left when building stops are the core: its arcs are in both,
    so that answers stay exact.
    """

    ahead: DataFrame
    back: DataFrame
    core: int

    @classmethod
    def build(cls, graph: Graph, max_rounds: int = 60, growth: float = 1.5, hops: int = 5) -> Contraction:
        """Each round contracts the nodes with the least (priority, hash, id) among their neighbours.

        The priority is the shortcuts that a node may need less the arcs that go,
        plus its contracted neighbours. A pair of neighbours gets a shortcut
        unless a way of up to `hops` arcs that avoids all nodes of the round is as
        short; a witness that is not seen only adds a shortcut. Building stops
        after `max_rounds`, or when a round would make arcs `growth` times as many.
        """
        spark = graph.nodes.sparkSession
        arcs = cheapest(graph).where("src <> dst").select("src", "dst", "w", F.lit(1).cast("long").alias("n"), F.lit(None).cast("long").alias("mid"))
        arcs = materialise(arcs, "contract")
        many = arcs.count()
        near = spark.createDataFrame([], "id long, near long")
        ahead, back = [], []
        for _ in range(max_rounds):
            if not many:
                break
            both = arcs.select(F.col("src").alias("id"), F.col("dst").alias("other"), F.lit(1).alias("out")).unionAll(arcs.select(F.col("dst").alias("id"), F.col("src").alias("other"), F.lit(0).alias("out")))
            ends = both.groupBy("id").agg(F.sum("out").alias("out"), F.sum(1 - F.col("out")).alias("in"))
            priority = F.col("in") * F.col("out") - F.col("in") - F.col("out") + F.coalesce("near", F.lit(0))
            rank = ends.join(near, "id", "left").select("id", F.struct(priority.alias("p"), F.xxhash64("id").alias("h"), "id").alias("rank"))
            least = both.join(rank.select(F.col("id").alias("other"), F.col("rank").alias("theirs")), "other").groupBy("id").agg(F.min("theirs").alias("theirs"))
            picked = materialise(rank.join(least, "id").where(F.col("rank") < F.col("theirs")).select("id"), "picked")
            marked = arcs.join(picked.select(F.col("id").alias("src"), F.lit(True).alias("from")), "src", "left").join(picked.select(F.col("id").alias("dst"), F.lit(True).alias("to")), "dst", "left")
            marked = materialise(marked.select("src", "dst", "w", "n", "mid", "from", "to"), "marked")
            parts = ["src", "dst", "w", "n", "mid"]
            out, into = marked.where("from").select(*parts), marked.where("to").select(*parts)
            rest = marked.where("from IS NULL AND to IS NULL").select(*parts)
            via = into.select(F.col("src").alias("u"), F.col("dst").alias("mid"), F.col("w").alias("w1"), F.col("n").alias("n1")).join(out.select(F.col("src").alias("mid"), F.col("dst").alias("v"), F.col("w").alias("w2"), F.col("n").alias("n2")), "mid")
            via = via.where("u <> v").groupBy("u", "v").agg(F.min(F.struct((F.col("w1") + F.col("w2")).alias("c"), (F.col("n1") + F.col("n2")).alias("n"), "mid")).alias("m"))
            via = materialise(via.select("u", "v", "m.c", "m.n", "m.mid"), "via")
            seen, cached = _witnesses(via, rest, hops)
            short = via.join(seen, ["u", "v"], "left_anti").select(F.col("u").alias("src"), F.col("v").alias("dst"), F.struct(F.col("c").alias("w"), "n", "mid").alias("m"))
            every = rest.select("src", "dst", F.struct("w", "n", "mid").alias("m")).unionByName(short)
            left = materialise(every.groupBy("src", "dst").agg(F.min("m").alias("m")).select("src", "dst", "m.w", "m.n", "m.mid"), "contract")
            for table in cached:
                table.unpersist()
            release(via)
            after = left.count()
            if after > growth * many:
                release(left)
                break
            ahead.append(out)
            back.append(into)
            touched = both.join(picked, "id").groupBy(F.col("other").alias("id")).agg(F.count_distinct("id").alias("near"))
            near = materialise(near.unionByName(touched).groupBy("id").agg(F.sum("near").alias("near")).join(picked, "id", "left_anti"), "near")
            release(arcs)
            arcs, many = left, after
        whole = lambda parts: reduce(DataFrame.unionByName, parts, arcs)
        core = arcs.select("src").unionAll(arcs.select("dst")).distinct().count()
        return cls(whole(ahead), _turned(whole(back)), core)

    def pair_costs(self, pairs: DataFrame, max_rounds: int = 100_000) -> DataFrame:
        """(qid, cost) of pairs(qid, src, dst)."""
        return _meeting_costs(self.ahead, self.back, pairs, max_rounds)

    def pair_paths(self, pairs: DataFrame) -> DataFrame:
        """(qid, k, id): the nodes of a cheapest path of each pair(qid, src, dst), shortcuts unpacked; none without a path."""
        arcs = materialise(self.ahead.unionByName(_turned(self.back)).dropDuplicates(["src", "dst"]), "arcs")
        return meeting_paths(self.ahead, self.back, arcs, pairs)


def _turned(arcs: DataFrame) -> DataFrame:
    return arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in arcs.columns if c not in ("src", "dst")])


def _witnesses(via: DataFrame, rest: DataFrame, hops: int) -> tuple[DataFrame, list[DataFrame]]:
    """The pairs (u, v) of via(u, v, c) between which a way of up to `hops` arcs of rest costs at most c; and what to unpersist after use.

    All searches of a round are one table (u, id, d); one goes on only up to the largest c of its u.
    """
    most = via.groupBy("u").agg(F.max("c").alias("most"))
    front = most.select("u", F.col("u").alias("id"), F.lit(0.0).alias("d"), "most")
    steps = rest.select("src", "dst", "w").persist()
    seen, kept = None, [steps]
    for _ in range(hops):
        reached = front.join(steps, F.col("id") == F.col("src")).select("u", F.col("dst").alias("id"), (F.col("d") + F.col("w")).alias("d"), "most").where("d <= most AND id <> u")
        front = reached.groupBy("u", "id").agg(F.min("d").alias("d"), F.first("most").alias("most")).persist()
        kept.append(front)
        found = via.join(front.select("u", F.col("id").alias("v"), "d"), ["u", "v"]).where("d <= c").select("u", "v")
        seen = found if seen is None else seen.unionAll(found)
    return seen.distinct(), kept


@dataclass(frozen=True)
class Hierarchy:
    """An elimination order in rounds with its fill-in: levels(id, level) and arcs(lo, hi, level), hi eliminated later.

    Nodes of a round are no neighbours of one another, so a round is one join.
    The order looks at the network's shape only; `customise` puts weights on it.
    """

    graph: Graph
    levels: DataFrame
    arcs: DataFrame
    rounds: int

    @classmethod
    def build(cls, graph: Graph, max_rounds: int = 100_000) -> Hierarchy:
        """Each round eliminates the nodes whose (degree, hash, id) is least among their neighbours', and joins what they leave."""
        pairs = materialise(graph.undirected().select("u", "v"), "left")
        alone = materialise(graph.nodes.select("id").join(pairs.select(F.col("u").alias("id")).unionAll(pairs.select(F.col("v").alias("id"))).distinct(), "id", "left_anti"), "alone")
        arcs = None
        for turn in range(max_rounds):
            if pairs.isEmpty():
                break
            both = pairs.select(F.col("u").alias("id"), F.col("v").alias("other")).unionAll(pairs.select(F.col("v").alias("id"), F.col("u").alias("other")))
            rank = both.groupBy("id").agg(F.count("*").alias("degree")).select("id", F.struct("degree", F.xxhash64("id").alias("h"), "id").alias("rank"))
            least = both.join(rank.select(F.col("id").alias("other"), F.col("rank").alias("theirs")), "other").groupBy("id").agg(F.min("theirs").alias("theirs"))
            picked = rank.join(least, "id").where(F.col("rank") < F.col("theirs")).select("id")
            up = materialise(both.join(picked, "id").select(F.col("id").alias("lo"), F.col("other").alias("hi"), F.lit(turn).alias("level")), "up")
            fill = up.alias("a").join(up.alias("b"), "lo").where("a.hi < b.hi").select(F.col("a.hi").alias("u"), F.col("b.hi").alias("v"))
            gone = up.select("lo").distinct()
            rest = pairs.join(gone.withColumnRenamed("lo", "u"), "u", "left_anti").join(gone.withColumnRenamed("lo", "v"), "v", "left_anti")
            arcs = up if arcs is None else arcs.unionAll(up)
            after = materialise(rest.select("u", "v").unionAll(fill).distinct(), "left")
            release(pairs)
            pairs = after
        else:
            raise RuntimeError("the elimination did not end")
        if arcs is None:
            arcs = pairs.select(F.col("u").alias("lo"), F.col("v").alias("hi"), F.lit(0).alias("level"))
        arcs = materialise(arcs, "arcs")
        # each part's last node has no arc upwards
        own = arcs.groupBy(F.col("lo").alias("id")).agg(F.min("level").alias("level"))
        last = arcs.groupBy(F.col("hi").alias("id")).agg((F.max("level") + 1).alias("level")).join(own, "id", "left_anti")
        return cls(graph, materialise(own.unionByName(last).unionByName(alone.withColumn("level", F.lit(0))), "levels"), arcs, turn)

    def customise(self, weights: DataFrame | None = None) -> Weighted:
        """Put weights(src, dst, w) (the graph's own by default) on the arcs.

        Weights lie in partitions by level, and so do the offers that arcs get
        from below. A round reads its own level's, and writes what the ways over
        its nodes offer to arcs above; no arc is written again for a round. The
        least of all offers is an arc's weight.
        """
        w = cheapest(self.graph if weights is None else Graph(self.graph.nodes, weights))
        own = w.select("src", "dst", F.struct("w", F.lit(1).cast("long").alias("n"), F.lit(None).cast("long").alias("mid")).alias("m"))
        level = self.arcs.select("lo", "hi", "level")
        both = level.select(F.col("lo").alias("src"), F.col("hi").alias("dst"), "level", F.lit(True).alias("up")).unionAll(level.select(F.col("hi").alias("src"), F.col("lo").alias("dst"), "level", F.lit(False).alias("up")))
        both = materialise(both, "both")
        tables = [levelled(both.join(own, ["src", "dst"]).select("src", "dst", "level", "up", "m"), "offers")]
        read = tables
        for turn in range(self.rounds):
            here = reduce(DataFrame.unionByName, read).where(F.col("level") == turn).groupBy("src", "dst", "up").agg(F.min("m").alias("m"))
            # from one upper neighbour down to the node and up to the other
            down = here.where("NOT up").select(F.col("dst").alias("mid"), "src", F.col("m").alias("a"))
            rise = here.where("up").select(F.col("src").alias("mid"), "dst", F.col("m").alias("b"))
            via = down.join(rise, "mid").where("src <> dst").select("src", "dst", F.struct((F.col("a.w") + F.col("b.w")).alias("w"), (F.col("a.n") + F.col("b.n")).alias("n"), "mid").alias("m"))
            via = via.groupBy("src", "dst").agg(F.min("m").alias("m")).join(both, ["src", "dst"])
            tables = [*tables, levelled(via.select("src", "dst", "level", "up", "m"), "offers")]
            read = [*read, tables[-1]]
            if len(read) == 8:  # few tables to look into
                rest = reduce(DataFrame.unionByName, read).where(F.col("level") > turn)
                read = [levelled(rest.groupBy("src", "dst", "level", "up").agg(F.min("m").alias("m")).select("src", "dst", "level", "up", "m"), "offers")]
        settled = reduce(DataFrame.unionByName, tables).groupBy("src", "dst", "level", "up").agg(F.min("m").alias("m"))
        arcs = materialise(settled.select("src", "dst", "level", "up", "m.w", "m.n", "m.mid"), "weights")
        for table in {id(t): t for t in [*tables, *read]}.values():
            release(table)
        return Weighted(arcs)


def levelled(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder in partitions by level, so that a round reads its own."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy("level").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.waygraph_path = path
    return out


@dataclass(frozen=True)
class Weighted:
    """A customised hierarchy: arcs(src, dst, level, up, w, n, mid), each way by itself."""

    arcs: DataFrame

    def _ways(self) -> tuple[DataFrame, DataFrame]:
        return self.arcs.where("up").select("src", "dst", "w"), _turned(self.arcs.where("NOT up")).select("src", "dst", "w")

    def pair_costs(self, pairs: DataFrame, max_rounds: int = 100_000) -> DataFrame:
        """(qid, cost) of pairs(qid, src, dst): both ends climb, and the cheapest meeting counts."""
        return _meeting_costs(*self._ways(), pairs, max_rounds)

    def pair_paths(self, pairs: DataFrame) -> DataFrame:
        """(qid, k, id): the nodes of a cheapest path of each pair(qid, src, dst), shortcuts unpacked; none without a path."""
        return meeting_paths(*self._ways(), self.arcs.select("src", "dst", "n", "mid"), pairs)
