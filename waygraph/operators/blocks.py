"""Least costs block by block, for networks with places: their paths have many arcs, but cross few blocks.

Nodes are dealt into blocks that lie together. A round takes the blocks that got
better offers at their rims, each in a task of its own, settles them, and sends
what leaves them on to their neighbours. Rounds are as many as blocks lie one
behind another, not as many as arcs do, and a round reads its own blocks only.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waygraph.loop import materialise, release, shared_dir

#: Nodes of a block: what one task searches at once.
BLOCK = 60_000
#: Halvings at most; what is still too large then lies at one place and is dealt by a hash.
LEVELS = 30


def blocks(nodes: DataFrame, size: int = BLOCK) -> DataFrame:
    """(id, block) of nodes(id, x, y): halved at the median of the longer side until at most `size` are left; without a place by a hash."""
    placed = (F.col("x").isNotNull() & F.col("y").isNotNull()).cast("long")
    own = materialise(nodes.select("id", "x", "y", placed.alias("cell")), "cells")
    for _ in range(LEVELS):
        side = lambda c: F.struct((F.max(c) - F.min(c)).alias("long"), F.percentile_approx(c, 0.5, 1000).alias("half"), F.max(c).alias("top"))
        found = own.where("x IS NOT NULL AND y IS NOT NULL").groupBy("cell").agg(F.count("*").alias("n"), side("x").alias("sx"), side("y").alias("sy"))
        longer = F.col("sx.long") >= F.col("sy.long")
        cut = found.where(F.col("n") > size).select("cell", longer.alias("across"), F.when(longer, F.col("sx")).otherwise(F.col("sy")).alias("s")).where("s.long > 0")
        cut = materialise(cut, "cut")
        if cut.isEmpty():
            break
        at = F.when(F.col("across"), F.col("x")).otherwise(F.col("y"))
        above = (at > F.col("s.half")) | ((F.col("s.half") == F.col("s.top")) & (at == F.col("s.top")))
        after = own.join(F.broadcast(cut), "cell", "left")  # a row for each block
        after = materialise(after.select("id", "x", "y", (F.col("cell") * 2 + F.coalesce(above, F.lit(False)).cast("long")).alias("cell")), "cells")
        release(own)
        own = after
    sizes = own.groupBy("cell").agg(F.ceil(F.count("*") / size).alias("parts"))
    dealt = own.join(F.broadcast(sizes), "cell").select("id", F.xxhash64("cell", F.pmod(F.xxhash64("id"), F.col("parts"))).alias("block"))
    return materialise(dealt, "blocks")


def _settle(most: float, columns: list[str]):
    """Of a block's labels (qid, id, block, d, new) and its arcs the labels that get better, as `columns`."""
    from heapq import heapify, heappop, heappush

    import pandas as pd

    def settle(labels, arcs):
        out_of: dict = {}
        for s, t, w in zip(arcs["src"].tolist(), arcs["dst"].tolist(), arcs["w"].tolist()):
            out_of.setdefault(s, []).append((t, w))
        better = []
        for qid, rows in labels.groupby("qid"):
            old, new = rows[~rows["new"]], rows[rows["new"]]
            best, waits, found = {}, list(zip(new["d"].tolist(), new["id"].tolist())), {}
            for at, d in zip(old["id"].tolist(), old["d"].tolist()):
                best[at] = min(d, best.get(at, d))
            heapify(waits)
            while waits:
                d, at = heappop(waits)
                if at in best and d >= best[at]:
                    continue
                best[at] = found[at] = d
                for to, w in out_of.get(at, ()):
                    if d + w <= most and (to not in best or d + w < best[to]):
                        heappush(waits, (d + w, to))
            better.append(pd.DataFrame({"qid": [qid] * len(found), "id": list(found), "d": list(found.values())}))
        out = pd.concat(better, ignore_index=True) if better else pd.DataFrame({"qid": [], "id": [], "d": []})
        return out.assign(block=labels["block"].iloc[0] if len(labels) else 0)[columns]

    return settle


def block_costs(nodes: DataFrame, edges: DataFrame, sources: DataFrame, max_cost: float | None = None, size: int = BLOCK) -> DataFrame:
    """(qid, id, cost) from few sources(qid, id) over edges(src, dst, w), one a pair and not negative; none above max_cost."""
    spark, columns = nodes.sparkSession, ["qid", "id", "block", "d"]
    of = blocks(nodes, size)

    def with_block(df: DataFrame, key: str, name: str) -> DataFrame:
        found = df.join(of.select(F.col("id").alias(key), F.col("block").alias(name)), key, "left")
        return found.withColumn(name, F.coalesce(name, F.pmod(F.xxhash64(key), F.lit(1024))))  # ends that are no nodes

    arcs = materialise(with_block(with_block(edges.where("w IS NOT NULL"), "src", "block"), "dst", "to").select("src", "dst", "w", "block", "to"), "arcs")
    inner = arcs.where("block = to").select("src", "dst", "w", "block")
    path = f"{shared_dir(spark)}/inner-{uuid.uuid4().hex}"
    inner.repartition("block").write.option("compression", "zstd").partitionBy("block").parquet(path)
    inner = spark.read.schema(inner.schema).parquet(path)  # a folder for each block, so that a round reads its own
    cross = materialise(arcs.where("block <> to").select("src", "dst", "w", "to"), "cross")
    release(arcs)
    start = with_block(sources.select("qid", "id"), "id", "block").withColumn("d", F.lit(0.0)).select(*columns).distinct()
    most = float("inf") if max_cost is None else max_cost
    offers, known = materialise(start, "offers"), []
    every = lambda: reduce(DataFrame.unionByName, known)
    while active := [r[0] for r in offers.select("block").distinct().collect()]:  # as many as blocks
        labels = offers.withColumn("new", F.lit(True))
        if known:
            labels = labels.unionByName(every().where(F.col("block").isin(active)).withColumn("new", F.lit(False)))
        own = inner.where(F.col("block").isin(active))
        better = labels.groupBy("block").cogroup(own.groupBy("block")).applyInPandas(_settle(most, columns), start.schema)
        better = materialise(better, "better")
        known.append(better)
        sent = better.join(cross, F.col("id") == F.col("src")).select("qid", F.col("dst").alias("id"), F.col("to").alias("block"), (F.col("d") + F.col("w")).alias("d"))
        sent = materialise(sent.where(F.col("d") <= most).groupBy("qid", "id", "block").agg(F.min("d").alias("d")), "sent")
        keys = ["qid", "id", "block"]
        old = every().where(F.col("block").isin([r[0] for r in sent.select("block").distinct().collect()])).join(F.broadcast(sent.select(*keys)), keys)  # nodes at the rims
        old = old.groupBy(*keys).agg(F.min("d").alias("old"))
        after = materialise(sent.join(old, keys, "left").where("old IS NULL OR d < old").select(*columns), "offers")
        for done in (offers, sent):
            release(done)
        offers = after
        if len(known) == 8:  # few tables to look into
            whole = materialise(every().groupBy(*keys).agg(F.min("d").alias("d")).select(*columns), "better")
            for done in known:
                release(done)
            known = [whole]
    found = every() if known else start
    return found.groupBy("qid", "id").agg(F.min("d").alias("cost"))
