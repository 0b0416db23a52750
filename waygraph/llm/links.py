"""From buckets of likely partners to classes, without emitting all pairs of a bucket."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waygraph.loop import connected_components, materialise, release


#: Nodes of a bucket whose pairs are all compared at once.
FEW = 64


def bucket_components(
    members: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    across: Callable[[DataFrame, bool], DataFrame],
    rounds: int = 1,
) -> DataFrame:
    """Components of the graph of verified pairs that share a bucket.

    members: `(key, node)`, repeats allowed. verify: keeps of `(a, b)` pairs
    those that are links. First each node is held against its bucket's least
    node only. A bucket whose nodes then have one label needs no more, as
    further links cannot join anything. Of the others, `across` gets the
    members as `(key, node, label)` and returns links `(a, b)` between nodes or
    labels: in the last round, and of buckets of FEW nodes at most at once, as
    many as join all labels that have a link, before it any of them. So no component is lost,
    and only large buckets are looked at again. Returns `(id, component)` for linked nodes.
    """
    by_key = Window.partitionBy("key").orderBy("node")
    stars = members.withColumn("center", F.first("node").over(by_key)).where("node <> center").distinct()
    stars = materialise(stars, "stars")
    release(members, shuffles=True)
    pairs = stars.select(F.col("center").alias("a"), F.col("node").alias("b")).distinct()
    links = materialise(verify(pairs).select("a", "b"), "links")
    labels = materialise(connected_components(links.toDF("u", "v")), "labels")
    release(links, shuffles=True)
    for turn in range(rounds):
        own = labels.select(F.col("id").alias("node"), F.col("component").alias("ln"))
        centers = labels.select(F.col("id").alias("center"), F.col("component").alias("lc"))
        both = (
            stars.join(own, "node", "left")
            .join(centers, "center", "left")
            .select("key", "node", "center", F.coalesce("ln", "node").alias("ln"), F.coalesce("lc", "center").alias("lc"))
        )
        keys = materialise(both.where("ln <> lc").select("key").distinct(), "open")
        if keys.isEmpty():
            break
        inside = both.join(keys, "key", "left_semi")
        inside = materialise(
            inside.select("key", "node", F.col("ln").alias("label"))
            .unionAll(inside.select("key", F.col("center").alias("node"), F.col("lc").alias("label")))
            .distinct(),
            "inside",
        )
        # buckets of the same nodes (of several bands) are looked at once
        alike = inside.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.xxhash64("node", F.lit(1)) % F.lit(2**20)).alias("y"))
        alike = alike.where(F.col("n") > FEW) if turn else alike
        once = materialise(alike.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key"), "once")
        every, inside = inside, materialise(inside.join(once, "key", "left_semi"), "inside")
        release(every)
        release(once)
        release(keys, shuffles=True)
        if turn and inside.isEmpty():
            break
        more = materialise(across(inside, turn == rounds - 1).select("a", "b").distinct(), "links")
        release(inside, shuffles=True)
        if not more.isEmpty():
            known = labels.select(F.col("id").alias("u"), F.col("component").alias("v"))
            labels = materialise(connected_components(known.unionAll(more.toDF("u", "v"))), "labels")
        release(more, shuffles=True)
    release(stars)
    return labels
