"""Exact integer k-means by sorted means.

Each round the other centroids are put in order of distance from each centroid.
A vector starts at the centroid that it had and looks at the others in that
order; by the triangle inequality none that is further from its centroid than
twice the vector's own distance can be nearer, so the scan stops strictly
beyond that. All arithmetic is in integers, so results do not depend on how
rows are dealt.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waygraph.loop import materialise, release

#: Components are below this after scaling, so that squared distances of 64 of them fit into 64 bits.
MOST = 1 << 27


def assign(x: np.ndarray, before: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (ties: the smaller number) and squared distance of each vector; before: where each begins."""
    apart = np.array([((centroids - c) ** 2).sum(1) for c in centroids])
    order = np.argsort(apart, axis=1, kind="stable")
    near = before.copy()
    first = ((x - centroids[before]) ** 2).sum(1)
    best = first.copy()
    for c in np.unique(before):
        rows = np.flatnonzero(before == c)
        for other in order[c]:
            if other == c:
                continue
            rows = rows[first[rows] >= (apart[c, other] + 3) // 4]  # stop beyond twice the distance, squared
            if not len(rows):
                break
            d = ((x[rows] - centroids[other]) ** 2).sum(1)
            better = (d < best[rows]) | ((d == best[rows]) & (other < near[rows]))
            near[rows[better]], best[rows[better]] = other, d[better]
    return near, best


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, dim).astype(np.int64)


def _pack(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        many = batch.num_rows
        x = np.floor(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(many, -1) * scale).astype("<i4") if many else np.zeros((0, 1), "<i4")
        yield pa.record_batch([batch.column(0), pa.array([v.tobytes() for v in x], pa.binary()), pa.array(np.zeros(many, np.int32))], ["id", "x", "cluster"])


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = _vectors(batch.column(1), centroids.shape[1])
        near, d = assign(x, batch.column(2).to_numpy(), centroids)
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(near.astype(np.int32)), pa.array(d)], ["id", "x", "cluster", "distance"])


def _sums(batches: Iterator[pa.RecordBatch], k: int, dim: int) -> Iterator[pa.RecordBatch]:
    """A row for each cluster at most: its vectors, their componentwise sum, their distances."""
    n, total, inertia = np.zeros(k, np.int64), np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
    for batch in batches:
        x, of = _vectors(batch.column(0), dim), batch.column(1).to_numpy()
        n += np.bincount(of, minlength=k)
        np.add.at(total, of, x)
        np.add.at(inertia, of, batch.column(2).to_numpy())
    used = np.flatnonzero(n)
    yield pa.record_batch([pa.array(used), pa.array(n[used]), pa.array(inertia[used]), pa.array(total[used].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "inertia", "sums"])


def _totals(state: DataFrame, k: int, dim: int) -> tuple[dict[int, int], dict[int, int], dict[int, list[int]]]:
    """Vectors, inertia and component sums of each cluster; the driver gets k * (dim + 2) numbers."""
    part = state.select("x", "cluster", "distance").mapInArrow(partial(_sums, k=k, dim=dim), "cluster long, n long, inertia long, sums array<long>")
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    numbers = part.select("cluster", F.posexplode(F.concat(F.array("n", "inertia"), "sums")).alias("at", "v")).groupBy("cluster", "at").agg(exact("v"))
    by: dict[int, dict[int, int]] = {}
    for c, at, v in numbers.collect():
        by.setdefault(c, {})[at] = int(v)
    return {c: v[0] for c, v in by.items()}, {c: v[1] for c, v in by.items()}, {c: [v[2 + i] for i in range(dim)] for c, v in by.items()}


def sorted_means(
    vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, seed: int = 2, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """Clusters of vectors: (id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256), one row for each kept vector, in no order.

    Vectors of exactly `dim` components are kept, none null or non-finite or, by
    its size, beyond MOST after scaling; their components become
    floor(scale * x). The first centroids are the k kept vectors with the least
    sha256 of `seed:id` (rows with one id: the smaller vector first; a null id
    counts as an empty one); fewer vectors give fewer centroids. A round assigns
    every vector to the nearest centroid, ties to the smaller number, and moves
    each centroid to the rounded-down mean of its vectors; one without any
    stays. Then vectors are assigned once more. Repeated rows are vectors each;
    other columns are ignored, whatever their names; an empty table gives an
    empty result.

    The driver holds k centroids and their sums. Each round reads and writes the
    packed vectors once, in the shared folder, and drops those of the round before.
    """
    spark = vectors.sparkSession
    v = F.col(f"`{vector_col}`")
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), v.cast("array<double>").alias("v"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < MOST)
    rows = rows.where(F.coalesce((F.size("v") == dim) & F.forall("v", fine), F.lit(False)))
    kind = rows.schema["id"].dataType.simpleString()
    state = materialise(rows.mapInArrow(partial(_pack, scale=scale), f"id {kind}, x binary, cluster int"), "vectors")
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = state.select("x", named.alias("h")).orderBy("h", "x").limit(k).collect()  # k vectors
    centroids = np.array([np.frombuffer(r["x"], "<i4") for r in first], np.int64).reshape(-1, dim)
    k = len(centroids)
    for turn in range(rounds + 1 if k else 0):
        after = materialise(state.select("id", "x", "cluster").mapInArrow(partial(_assigned, centroids=centroids), f"id {kind}, x binary, cluster int, distance long"), "vectors")
        release(state)
        state = after
        n, inertia, sums = _totals(state, k, dim)
        if turn < rounds:
            centroids = np.array([[s // n[c] for s in sums[c]] if c in n else old for c, old in enumerate(centroids.tolist())], np.int64)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = [(c, inertia.get(c, 0), sum(inertia.values()), name) for c, name in enumerate(names)]
    of = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    if not k:
        state = state.withColumn("distance", F.lit(None).cast("long"))
    out = state.select(F.col("id").alias(id_col), "cluster", "distance").join(F.broadcast(of), "cluster")  # k rows
    return out.select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
