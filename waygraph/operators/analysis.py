"""Network analysis: components, bridges, spanning trees, centrality and flow."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waygraph.loop import connected_components, materialise, release
from waygraph.operators.paths import _loop, cheapest
from waygraph.tables import Graph


def components(graph: Graph) -> DataFrame:
    """Undirected components: (id, component), component being the smallest id."""
    labels = connected_components(graph.edges.select(F.col("src").alias("u"), F.col("dst").alias("v")))
    return graph.nodes.select("id").join(labels, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def _spread(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The least label that reaches each node along the edges: (id, label)."""
    start = labels.select(F.lit(0).alias("qid"), "id", F.col("label").cast("double").alias("d"))
    out, _ = _loop(edges, start, F.col("d"), 1_000_000)
    return out.select("id", F.col("d").cast("long").alias("label"))


def strong_components(graph: Graph) -> DataFrame:
    """Strongly connected components: (id, component), the smallest id of each.

    Nodes joined by arcs both ways are contracted first. Then every node takes
    the least id that it reaches; arcs between different labels cross no
    component, and what a label's root reaches within its cell is one. Rounds
    take turns in direction, so that neither long way makes all of them long.
    """
    arcs = materialise(graph.edges.select("src", "dst").where("src <> dst").distinct(), "arcs")
    mutual = arcs.join(arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_semi")
    merged = materialise(connected_components(mutual.toDF("u", "v")), "merged")
    own = graph.nodes.select("id").join(merged, "id", "left").select("id", F.coalesce("component", "id").alias("of"))
    own = materialise(own, "own")
    edges = (
        arcs.join(own.select(F.col("id").alias("src"), F.col("of").alias("a")), "src")
        .join(own.select(F.col("id").alias("dst"), F.col("of").alias("b")), "dst")
        .where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()
    )
    edges = materialise(edges, "scc")
    left = materialise(own.select(F.col("of").alias("id")).distinct(), "left")
    done, turned = None, True
    while not left.isEmpty():
        way = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if turned else edges
        label = materialise(_spread(way, left.withColumn("label", F.col("id"))), "label")
        inside = (
            way.join(label.select(F.col("id").alias("src"), F.col("label").alias("a")), "src")
            .join(label.select(F.col("id").alias("dst"), F.col("label").alias("b")), "dst")
            .where("a = b")
        )
        inside = materialise(inside.select("src", "dst"), "inside")
        back = inside.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        found = materialise(_spread(back, label.where("id = label").select("id", "label")).select("id", F.col("label").alias("component")), "found")
        done = found if done is None else done.unionAll(found)
        left = materialise(left.join(found, "id", "left_anti"), "left")
        rest = back if turned else inside
        edges = materialise(
            rest.join(found.select(F.col("id").alias("src")), "src", "left_anti").join(found.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst"), "scc"
        )
        turned = not turned
    if done is None:
        return graph.nodes.select("id", F.col("id").alias("component"))
    labelled = own.join(done.withColumnRenamed("id", "of"), "of")
    least = labelled.groupBy("component").agg(F.min("id").alias("least"))
    return labelled.join(least, "component").select("id", F.col("least").alias("component"))


def spanning_forest(edges: DataFrame) -> DataFrame:
    """Minimum spanning forest of undirected edges (u, v, w), u < v, in the order (w, u, v), by Boruvka rounds: (u, v, w).

    In a round each part picks its least edge. Following the picks leads to the
    two parts that picked the same edge; pointer doubling takes every part to
    the smaller of those, whose name the joined part bears.
    """
    left = materialise(edges.select("u", "v", "w", F.col("u").alias("cu"), F.col("v").alias("cv")), "mst")
    tree = None
    while not left.isEmpty():
        key = F.struct("w", "u", "v", "cu", "cv")
        ends = left.select(F.col("cu").alias("c"), key.alias("e")).unionAll(left.select(F.col("cv").alias("c"), key.alias("e")))
        picked = materialise(ends.groupBy("c").agg(F.min("e").alias("e")), "picked")
        one = picked.select("e.u", "e.v", "e.w").distinct()
        tree = one if tree is None else tree.unionAll(one)
        other = F.when(F.col("c") == F.col("e.cu"), F.col("e.cv")).otherwise(F.col("e.cu"))
        steps = picked.select("c", other.alias("to"), F.struct("e.u", "e.v").alias("e"))
        theirs = steps.select(F.col("c").alias("to"), F.col("e").alias("same"))
        top = (F.col("e") == F.col("same")) & (F.col("c") < F.col("to"))
        merged = materialise(steps.join(theirs, "to").select("c", F.when(top, F.col("c")).otherwise(F.col("to")).alias("to")), "merged")
        while True:
            ahead = merged.select(F.col("c").alias("to"), F.col("to").alias("then"))
            after = materialise(merged.join(ahead, "to").select("c", F.col("then").alias("to"), F.expr("to <> then").alias("moved")), "merged")
            release(merged)
            merged = after
            if merged.where("moved").isEmpty():
                break
        of = lambda c: merged.select(F.col("c").alias(c), F.col("to").alias(f"n{c}"))
        inner = left.join(of("cu"), "cu").join(of("cv"), "cv").where("ncu <> ncv")
        after = materialise(inner.select("u", "v", "w", F.col("ncu").alias("cu"), F.col("ncv").alias("cv")), "mst")
        release(left)
        left = after
    return tree if tree is not None else edges.select("u", "v", "w")


def spanning_tree(graph: Graph, undirected: bool = True) -> DataFrame:
    """(u, v, w) of the minimum spanning forest. undirected=False takes only arcs stored from the smaller id to the larger."""
    if undirected:
        return spanning_forest(graph.undirected())
    up = graph.edges.where("src < dst").groupBy(F.col("src").alias("u"), F.col("dst").alias("v")).agg(F.min("w").alias("w"))
    return spanning_forest(up)


def bridges(graph: Graph) -> DataFrame:
    """Bridges of the undirected simple projection: (u, v, isolated).

    The tree is rooted at each component's smallest id; u is the end towards it,
    isolated the number of nodes on v's side. A tree edge is a bridge if nothing
    below it touches a preorder number outside of the subtree.
    """
    from waygraph.operators.tour import low_high

    low, _ = low_high(graph)
    cut = low.where("parent IS NOT NULL AND low >= pre AND high < pre + size")
    return cut.select(F.col("parent").alias("u"), F.col("id").alias("v"), F.col("size").alias("isolated"))


def articulation_points(graph: Graph) -> DataFrame:
    """Nodes whose removal splits their component: (id).

    Two tree edges are in one block if a non-tree edge joins their subtrees or
    leaves the lower one past its parent; nodes that touch two blocks are the points.
    """
    from waygraph.operators.tour import low_high

    low, other = low_high(graph)
    low = materialise(low, "low")
    number = lambda c: low.select(F.col("id").alias(c), F.col("pre").alias(f"p{c}"), F.col("size").alias(f"s{c}"))
    apart = other.select("u", "v").join(number("u"), "u").join(number("v"), "v").where("pu + su <= pv OR pv + sv <= pu").select("u", "v")
    up = low.where("parent IS NOT NULL").alias("c").join(low.alias("p"), F.col("c.parent") == F.col("p.id"))
    past = up.where("p.parent IS NOT NULL AND (c.low < p.pre OR c.high >= p.pre + p.size)").select(F.col("c.id").alias("u"), F.col("p.id").alias("v"))
    blocks = connected_components(apart.unionAll(past))
    tree = low.where("parent IS NOT NULL").select("id", "parent").join(blocks, "id", "left").select("id", "parent", F.coalesce("component", "id").alias("block"))
    ends = tree.select("id", "block").unionAll(tree.select(F.col("parent").alias("id"), "block"))
    return ends.groupBy("id").agg(F.count_distinct("block").alias("n")).where("n > 1").select("id")


def biconnected(graph: Graph) -> tuple[DataFrame, DataFrame]:
    """The blocks (parts that no single node splits) of the undirected simple projection, and which nodes and arcs they hold.

    Returns (block, id, is_top, behind), a row for each node of a block, and
    (block, src, dst, w), each arc but self-loops once. is_top is the end towards
    the component's root; behind counts the nodes that are reached from the
    block through this one, itself included.
    """
    from waygraph.operators.tour import low_high

    low, other = low_high(graph)
    low = materialise(low, "low")
    number = lambda c: low.select(F.col("id").alias(c), F.col("pre").alias(f"p{c}"), F.col("size").alias(f"s{c}"))
    apart = other.select("u", "v").join(number("u"), "u").join(number("v"), "v").where("pu + su <= pv OR pv + sv <= pu").select("u", "v")
    up = low.where("parent IS NOT NULL").alias("c").join(low.alias("p"), F.col("c.parent") == F.col("p.id"))
    past = up.where("p.parent IS NOT NULL AND (c.low < p.pre OR c.high >= p.pre + p.size)").select(F.col("c.id").alias("u"), F.col("p.id").alias("v"))
    # a block goes by one of the nodes below its top
    named = connected_components(apart.unionAll(past))
    below = low.where("parent IS NOT NULL").join(named, "id", "left").select("id", "parent", "pre", "size", F.coalesce("component", "id").alias("block"))
    below = materialise(below, "below")
    whole = components(graph)
    many = whole.join(whole.groupBy("component").agg(F.count("*").alias("n")), "component").select("id", "n")
    inner = below.select("block", F.col("parent").alias("id"), "size").groupBy("block", "id").agg(F.sum("size").alias("inside"))
    rest = below.select("block", "id", "size").join(inner, ["block", "id"], "left")
    rest = rest.select("block", "id", F.lit(False).alias("is_top"), (F.col("size") - F.coalesce("inside", F.lit(0))).alias("behind"))
    top = inner.join(below.select("block", "id"), ["block", "id"], "left_anti").join(many, "id")
    held = rest.unionByName(top.select("block", "id", F.lit(True).alias("is_top"), (F.col("n") - F.col("inside")).alias("behind")))
    # both ends of an arc are in its block, one of them at least below the top: the later one
    at = lambda c: low.select(F.col("id").alias(c), F.col("pre").alias(f"p{c}"))
    arcs = graph.edges.where("src <> dst").join(at("src"), "src").join(at("dst"), "dst")
    arcs = arcs.withColumn("id", F.when(F.col("psrc") > F.col("pdst"), F.col("src")).otherwise(F.col("dst"))).join(below.select("id", "block"), "id")
    return materialise(held, "held"), materialise(arcs.select("block", "src", "dst", "w"), "arcs")


def betweenness(graph: Graph, samples: int = 0, seed: int = 42) -> DataFrame:
    """Brandes betweenness, weighted and directed, endpoints excluded, not normalised: (id, score).

    Where each arc has one back, paths between blocks pass their cut nodes for
    sure, so searches stay inside of blocks, from each of its nodes: one stands
    for all that lie behind it. Otherwise, or with `samples` sources, chosen by
    a hash (scores are scaled up), searches go through the whole graph.
    """
    turned = graph.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    pairs = graph.edges.where("src <> dst").select("src", "dst")
    many = graph.nodes.count()
    if 0 < samples < many or not pairs.join(turned, ["src", "dst"], "left_anti").isEmpty() or not graph.edges.where("w <= 0").isEmpty():
        chosen = graph.nodes.select("id")
        if 0 < samples < many:
            chosen = chosen.orderBy(F.xxhash64("id", F.lit(seed))).limit(samples)
        delta = _dependencies(graph.edges, chosen.select("id", F.lit(1).alias("weight")), graph.nodes.select("id", F.lit(1).alias("weight")))
        scale = many / samples if 0 < samples < many else 1.0
        score = delta.groupBy("id").agg((F.sum("delta") * scale).alias("score"))
    else:
        held, arcs = biconnected(graph)
        at = lambda c: F.struct("block", F.col(c).alias("id"))
        ends = materialise(held.select(at("id").alias("id"), F.col("behind").alias("weight")), "ends")
        delta = _dependencies(arcs.select(at("src").alias("src"), at("dst").alias("dst"), "w"), ends, ends)
        inside = delta.groupBy(F.col("id.id").alias("id")).agg(F.sum("delta").alias("score"))
        # a node between its branches: n others in all, of which those of a block it tops are a branch each, and what is left one
        sides = held.select("id", "is_top", "behind").groupBy("id").agg(F.count("*").alias("blocks"))
        branch = held.join(sides.where("blocks > 1").select("id"), "id", "left_semi").select("block", "id")
        others = held.groupBy("block").agg(F.sum("behind").alias("n"))
        own = held.select("block", "id", "behind").join(others, "block").join(branch, ["block", "id"], "left_semi").select("id", (F.col("n") - F.col("behind")).alias("k"))
        between = own.groupBy("id").agg((F.pow(F.sum("k"), F.lit(2)) - F.sum(F.col("k") * F.col("k"))).alias("score"))
        score = inside.unionByName(between).groupBy("id").agg(F.sum("score").alias("score"))
    return graph.nodes.select("id").join(score, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))


def _dependencies(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Brandes' dependencies (qid, id, delta) of sources on other nodes; sources and targets (id, weight) stand for as many ends.

    All sources go through the levels together, as rows that differ in the
    source: least costs, then path counts in the order of cost, then
    dependencies in the reverse order. Parallel arcs of equal cost count as paths
    of their own.
    """
    from waygraph.operators.paths import costs

    graph = Graph(targets.select("id"), edges)
    stands = targets.select("id", F.col("weight").alias("ends"))
    d = materialise(costs(graph, sources.select(F.col("id").alias("qid"), "id")), "costs")
    tight = (
        cheapest(graph).alias("c").join(graph.edges.alias("e"), ["src", "dst"]).where("e.w <= c.w + 1e-12")
        .groupBy("src", "dst").agg(F.min("c.w").alias("w"), F.count("*").alias("arcs"))
    )
    dag = (
        d.select("qid", F.col("id").alias("src"), F.col("cost").alias("ds")).join(tight, "src")
        .join(d.select("qid", F.col("id").alias("dst"), F.col("cost").alias("dd")), ["qid", "dst"])
        .where("abs(ds + w - dd) <= 1e-12 * greatest(1.0, dd)")
    )
    dag = materialise(dag.select("qid", "src", "dst", "arcs"), "dag")
    # levels of the shortest-path graph: the most hops from the source, a node after all before it
    level, _ = _loop_max(dag, sources)
    level = materialise(level, "level")
    deepest = level.agg(F.max("level").alias("m")).first()["m"] or 0
    dag = materialise(
        dag.join(level.select("qid", F.col("id").alias("dst"), F.col("level").alias("ld")), ["qid", "dst"])
        .join(level.select("qid", F.col("id").alias("src"), F.col("level").alias("ls")), ["qid", "src"]),
        "dag",
    )
    sigma = materialise(sources.select(F.col("id").alias("qid"), "id", F.lit(1.0).alias("sigma")), "sigma")
    for k in range(1, deepest + 1):
        here = dag.where(F.col("ld") == k).join(sigma.select("qid", F.col("id").alias("src"), "sigma"), ["qid", "src"])
        sigma = materialise(sigma.unionByName(here.groupBy("qid", F.col("dst").alias("id")).agg(F.sum(F.col("sigma") * F.col("arcs")).alias("sigma"))), "sigma")
    delta = materialise(level.where(F.col("level") == deepest).select("qid", "id", F.lit(0.0).alias("delta")), "delta")
    for k in range(deepest - 1, -1, -1):
        from_below = (
            dag.where(F.col("ls") == k)
            .join(sigma.select("qid", F.col("id").alias("src"), F.col("sigma").alias("ss")), ["qid", "src"])
            .join(sigma.select("qid", F.col("id").alias("dst"), F.col("sigma").alias("sd")), ["qid", "dst"])
            .join(delta.select("qid", F.col("id").alias("dst"), "delta"), ["qid", "dst"])
            .join(stands.withColumnRenamed("id", "dst"), "dst")
            .groupBy("qid", F.col("src").alias("id")).agg(F.sum(F.col("arcs") * F.col("ss") / F.col("sd") * (F.col("ends") + F.col("delta"))).alias("delta"))
        )
        here = level.where(F.col("level") == k).select("qid", "id").join(from_below, ["qid", "id"], "left").select("qid", "id", F.coalesce("delta", F.lit(0.0)).alias("delta"))
        delta = materialise(delta.unionByName(here), "delta")
    of = sources.select(F.col("id").alias("qid"), "weight")
    return delta.where("qid <> id").join(of, "qid").select("qid", "id", (F.col("delta") * F.col("weight")).alias("delta"))


def _loop_max(dag: DataFrame, sources: DataFrame) -> tuple[DataFrame, bool]:
    """Most hops from the source in an acyclic graph: (qid, id, level)."""
    state = materialise(sources.select(F.col("id").alias("qid"), "id", F.lit(0).alias("level"), F.lit(True).alias("new")), "levels")
    while True:
        reached = state.where("new").join(dag, (state["qid"] == dag["qid"]) & (F.col("id") == F.col("src"))).select(state["qid"], F.col("dst").alias("id"), (F.col("level") + 1).alias("level"))
        merged = (
            state.select("qid", "id", "level", F.col("level").alias("old")).unionByName(reached.withColumn("old", F.lit(None).cast("int")))
            .groupBy("qid", "id").agg(F.max("level").alias("level"), F.max("old").alias("old"))
            .select("qid", "id", "level", (F.col("old").isNull() | (F.col("level") > F.col("old"))).alias("new"))
        )
        after = materialise(merged, "levels")
        release(state)
        state = after
        if state.where("new").isEmpty():
            return state.drop("new"), True


def _levels(arcs: DataFrame, node: int) -> DataFrame:
    start = arcs.sparkSession.createDataFrame([(0, node, 0.0)], "qid int, id long, d double")
    out, _ = _loop(arcs, start, F.col("d") + 1.0, 1_000_000)
    return materialise(out.select("id", F.col("d").cast("int").alias("level")), "levels")


def _wave(residual: DataFrame, source: int, sink: int) -> DataFrame | None:
    """Flow (src, dst, p) along shortest residual paths: what every node gets it sends on, arc by arc; what it can't goes back."""
    arcs = residual.where("c > 1e-12")
    ahead = _levels(arcs.select("src", "dst"), source)
    far = ahead.where(F.col("id") == sink).first()
    if far is None:
        return None
    back = _levels(arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst")), sink)
    on = ahead.join(back.select("id", F.col("level").alias("rest")), "id").where(F.col("level") + F.col("rest") == far["level"])
    on = on.select("id", "level")
    layered = arcs.join(on.select(F.col("id").alias("src"), F.col("level").alias("k")), "src").join(
        on.select(F.col("id").alias("dst"), F.col("level").alias("kd")), "dst"
    ).where("kd = k + 1").select("src", "dst", "c", "k")
    layered = materialise(layered, "layered")
    sent: list[DataFrame] = []
    before = Window.partitionBy("src").orderBy("dst").rowsBetween(Window.unboundedPreceding, -1)
    for k in range(far["level"]):
        here = layered.where(F.col("k") == k)
        if k == 0:
            push = here.select("src", "dst", F.col("c").alias("p"))
        else:
            have = sent[-1].groupBy(F.col("dst").alias("src")).agg(F.sum("p").alias("e"))
            rest = F.col("e") - F.coalesce(F.sum("c").over(before), F.lit(0.0))
            push = here.join(have, "src").select("src", "dst", F.least(F.col("c"), F.greatest(F.lit(0.0), rest)).alias("p"))
        sent.append(materialise(push, "push"))
    into = Window.partitionBy("dst").orderBy(F.desc("src")).rowsBetween(Window.unboundedPreceding, -1)
    for k in range(far["level"] - 2, -1, -1):
        out = sent[k + 1].groupBy(F.col("src").alias("dst")).agg(F.sum("p").alias("out"))
        total = Window.partitionBy("dst")
        over = F.sum("p").over(total) - F.col("out") - F.coalesce(F.sum("p").over(into), F.lit(0.0))
        less = sent[k].join(out, "dst").select("src", "dst", (F.col("p") - F.least(F.col("p"), F.greatest(F.lit(0.0), over))).alias("p"))
        sent[k] = materialise(less, "push")
    flow = sent[0]
    for x in sent[1:]:
        flow = flow.unionAll(x)
    return flow


def max_flow(graph: Graph, source: int, sink: int, max_rounds: int = 10_000) -> tuple[float, DataFrame]:
    """Value of the maximum flow, and the residual capacities (src, dst, c).

    Each round sends a wave through the residual arcs on shortest paths, which
    saturates at least one of them. Parallel arcs add up. An unknown node, or the
    same twice, gives 0.
    """
    own = graph.edges.where("src <> dst")
    both = own.select("src", "dst", F.col("w").alias("c")).unionAll(own.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(0.0).alias("c")))
    residual = materialise(both.groupBy("src", "dst").agg(F.sum("c").alias("c")), "residual")
    value = 0.0
    if source == sink:
        return value, residual
    for _ in range(max_rounds):
        flow = _wave(residual, source, sink)
        if flow is None:
            return value, residual
        value += flow.where(F.col("dst") == sink).agg(F.sum("p")).first()[0]
        change = flow.select("src", "dst", (-F.col("p")).alias("p")).unionAll(flow.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "p"))
        after = residual.join(change.groupBy("src", "dst").agg(F.sum("p").alias("p")), ["src", "dst"], "left")
        residual = materialise(after.select("src", "dst", (F.col("c") + F.coalesce("p", F.lit(0.0))).alias("c")), "residual")
    raise RuntimeError("the flow did not settle")


def min_cut(graph: Graph, source: int, sink: int) -> DataFrame:
    """The arcs (src, dst, w) from the side that the residual graph reaches from the source to the rest; parallels each."""
    _, residual = max_flow(graph, source, sink)
    start = graph.nodes.sparkSession.createDataFrame([(0, source, 0.0)], "qid int, id long, d double")
    side, _ = _loop(residual.where("c > 1e-12").select("src", "dst"), start, F.col("d"), 1_000_000)
    side = materialise(side.select("id"), "side")
    return graph.edges.join(side.select(F.col("id").alias("src")), "src", "left_semi").join(side.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst", "w")


def top(report: DataFrame, by: str, ties: list[str], n: int = 10) -> DataFrame:
    """The n rows with the largest `by`; ties in the order of the other columns."""
    return report.orderBy(F.desc(by), *ties).limit(n)


def upper_median(rows: DataFrame, keys: list[str], of: str) -> DataFrame:
    """(keys, median): the middle value of each group, of an even number the upper one. Nulls don't count."""
    return rows.groupBy(*keys).agg(F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{of}` DESC)").alias("median"))
