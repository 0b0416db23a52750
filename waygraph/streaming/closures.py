"""Live road closures by Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waygraph.operators.paths import pair_costs
from waygraph.tables import Graph


def follow_closures(events: DataFrame, graph: Graph, pairs: DataFrame, put: Callable[[DataFrame, int], None], checkpoint: str):
    """Re-route pairs(qid, src, dst) whenever closures change.

    events is a stream of (u, v, closed, at). After each batch the last word on
    every road stands, and `put` gets (qid, cost) on the roads that are open,
    with the batch's number. The state after each batch is a table beside the
    checkpoint, named by the batch: after a restart the next batch reads the one
    before it, and a batch that is run again writes the same table again. Returns the running query.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        seen = df.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "closed", "at")
        if number > 0:
            seen = seen.unionByName(spark.read.parquet(f"{checkpoint}-state/{number - 1}"))
        state = seen.groupBy("u", "v").agg(F.max_by("closed", F.struct("at", "closed")).alias("closed"), F.max("at").alias("at"))
        state.write.mode("overwrite").parquet(f"{checkpoint}-state/{number}")
        put(pair_costs(graph.close(spark.read.parquet(f"{checkpoint}-state/{number}").where("closed")), pairs), number)

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
