"""Shared-folder tables and connected components for level-synchronous loops.

Lineage is cut by writing a Parquet table below the cluster's checkpoint
folder, never by a checkpoint that lives on one executor: any executor may be
lost between two rounds and the next round still finds its input.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one is set only where none is and driver and executors are one process."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="waygraph-"))
        found = sc.getCheckpointDir()
    return found


def materialise(df: DataFrame, name: str = "step") -> DataFrame:
    """Write `df` once to the shared folder and return the table read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.waygraph_path = path
    return out


def release(df: DataFrame, shuffles: bool = False) -> None:
    """Delete the table behind a DataFrame made by `materialise`.

    shuffles: also let Spark delete the shuffle files of finished jobs now; it
    does so once the driver's objects for them are collected, which may be much later.
    """
    path = getattr(df, "waygraph_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
    if shuffles:
        gc.collect()
        df.sparkSession._jvm.System.gc()


def _fingerprint(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64(*df.columns))).first())


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Label every id that occurs in `edges(u, v)` with the smallest id it reaches.

    Alternates the large-star and small-star steps until the edge set is a set
    of stars. Every step is a `min` aggregate (combined before the shuffle) and
    an equi-join whose hot keys adaptive execution can split; no adjacency list
    is ever gathered. Self-loops and nulls are ignored; an empty input gives an
    empty result. Returns `(id, component)`; ids without edges are absent.
    """
    e = (
        edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
        .select(F.greatest("u", "v").alias("hi"), F.least("u", "v").alias("lo"))
        .distinct()
    )
    e = materialise(e, "cc")
    before = _fingerprint(e)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(
            e.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        root = large.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = large.join(root, "hi")
        small = (
            joined.select("hi", F.col("m").alias("lo"))
            .unionAll(joined.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")))
            .distinct()
        )
        nxt = materialise(small, "cc")
        after = _fingerprint(nxt)
        release(e)
        e = nxt
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    roots = e.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct()
    return e.select(F.col("hi").alias("id"), F.col("lo").alias("component")).unionAll(roots)
