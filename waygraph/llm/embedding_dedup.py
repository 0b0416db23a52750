"""Near-duplicate vectors by randomised-rotation binary codes.

Each unit vector o is rotated at random; its code is the sign of each
coordinate, x = sign / sqrt(D), and with it goes the correction factor f = <x, o>.
For another unit vector q, <x, q> / f estimates <o, q> without bias, and its error
exceeds EPSILON sqrt((1 - f^2) / (f^2 (D - 1))) with vanishing chance. Only pairs
whose upper bound reaches the threshold are computed again, exactly. Further
rotations give bits for the buckets in which vectors meet: BITS of them a band,
as many bands as a pair at the threshold needs to meet with chance 1 - MISS.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waygraph.llm.words import U, mix
from waygraph.loop import connected_components, materialise

MISS = 1e-5
EPSILON = 5.0
#: Vectors that a bucket holds of a random label, about.
FILL = 16
#: A larger bucket is compared in pairs of blocks, each in a task of its own.
BLOCK = 1024


def rotations(dim: int, bits: int, seed: int = 11) -> np.ndarray:
    """Random orthogonal matrices side by side, with `bits` columns at least."""
    rng = np.random.default_rng([seed, dim])
    many = -(-bits // dim)
    return np.concatenate([np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(many)], axis=1)


def plan(rows: int, threshold: float) -> tuple[int, int]:
    """Bits of a band and number of bands for so many vectors under one label."""
    same = 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    bits = min(24, max(4, math.ceil(math.log2(max(2, rows / FILL)))))
    return bits, max(1, math.ceil(math.log(MISS) / math.log1p(-(same**bits)))) if same < 1 else 1


def _vectors(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """The vectors as bytes of their own floats; null where a vector can't link."""
    for batch in batches:
        out = []
        for v in batch.column(2):
            a = None
            if v.is_valid:
                x = v.values
                if len(x) and not x.null_count:
                    x = x.to_numpy(zero_copy_only=False).astype(np.float64)
                    top = np.abs(x).max()
                    a = x.astype(kind).tobytes() if np.isfinite(top) and top > 0 else None
            out.append(a)
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["id", "label", "vec"])


def _unit(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.stack([np.frombuffer(b, kind) for b in raw]).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # neither overflow nor underflow
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _encode(batches: Iterator[pa.RecordBatch], bits: int, bands: int, kind: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, label = batch.column(2).to_pylist(), batch.column(1).to_numpy()
        size = np.array([len(b) // np.dtype(kind).itemsize for b in raw])
        code: list = [None] * len(raw)
        factor = np.zeros(len(raw))
        keys = np.zeros((len(raw), bands), U)
        for dim in np.unique(size):
            at = np.flatnonzero(size == dim)
            r = rotations(int(dim), max(bits * bands, int(dim)))
            turned = _unit([raw[i] for i in at], kind) @ r
            factor[at] = np.abs(turned[:, :dim]).sum(axis=1) / math.sqrt(dim)
            sign = turned > 0
            for i, s in zip(at, np.packbits(sign, axis=1, bitorder="little")):
                code[i] = s.tobytes()
            band = sign[:, : bits * bands].reshape(len(at), bands, bits) @ (U(1) << np.arange(bits, dtype=U))
            salt = mix(np.array([dim], U)) + mix(label[at].astype(np.int64).view(U))[:, None]
            keys[at] = mix(mix(band + (np.arange(1, bands + 1, dtype=U) << U(32))) ^ salt)
        buckets = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands, dtype=np.int32)), pa.array(keys.ravel().view(np.int64)))
        yield pa.record_batch(
            [batch.column(0), batch.column(3), batch.column(2), pa.array(code, pa.binary()), pa.array(factor), buckets],
            ["node", "copies", "vec", "code", "factor", "buckets"],
        )


def _compare(
    node: np.ndarray, copies: np.ndarray, block: np.ndarray, raw: list[bytes], code: list[bytes], factor: np.ndarray,
    threshold: float, bits: int, bands: int, kind: str, band: int, parts: tuple[int, int],
) -> Iterator[tuple[int, int, int | None]]:
    """(node, links, None) and (node, 0, linked node) of one bucket or pair of blocks."""
    o = _unit(raw, kind)
    dim = o.shape[1]
    sign = np.unpackbits(np.frombuffer(b"".join(code), np.uint8).reshape(len(code), -1), axis=1, bitorder="little")
    turned = (o @ rotations(dim, dim)).astype(np.float32)
    estimate = turned @ ((2.0 * sign[:, :dim] - 1) / math.sqrt(dim) / factor[:, None]).T.astype(np.float32)
    bound = EPSILON * np.sqrt(np.maximum(0, 1 - factor**2) / factor**2 / max(1, dim - 1)) + 1e-5
    i, j = np.nonzero(np.triu(estimate + bound[None, :] >= threshold, 1))
    if parts[0] != parts[1]:
        other = block[i] != block[j]
        i, j = i[other], j[other]
    if not len(i):
        return
    key = sign[:, : bits * bands].reshape(len(node), bands, bits)
    earlier = (key[i, :band] == key[j, :band]).all(axis=2).any(axis=1)  # the pair has met in another band
    i, j = i[~earlier], j[~earlier]
    exact = np.concatenate([np.einsum("nd,nd->n", o[i[k : k + 65536]], o[j[k : k + 65536]]) for k in range(0, len(i), 65536)] or [np.zeros(0)])
    i, j = i[exact >= threshold], j[exact >= threshold]
    links = np.bincount(i, copies[j], len(node)) + np.bincount(j, copies[i], len(node))
    for k in np.flatnonzero(links):
        yield int(node[k]), int(links[k]), None
    root = np.arange(len(node))
    for a in np.unique(i):
        to = j[i == a]
        to = to[root[to] != root[a]]
        if len(to):
            roots, first = np.unique(root[to], return_index=True)
            for b in to[first]:
                yield int(node[a]), 0, int(node[b])
            root[np.isin(root, roots)] = root[a]


def _links(batches: Iterator[pa.RecordBatch], threshold: float, bits: int, bands: int, kind: str) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (bucket, low, high): a run is one bucket, or one pair of its blocks."""
    run, rows = None, []

    def done() -> pa.RecordBatch:
        out = []
        if len(rows) > 1:
            _, low, high, band, block, node, copies, vec, code, factor = zip(*rows)
            out = list(_compare(np.array(node), np.array(copies), np.array(block), list(vec), list(code), np.array(factor), threshold, bits, bands, kind, band[0], (low[0], high[0])))
        a, n, b = zip(*out) if out else ((), (), ())
        return pa.record_batch([pa.array(a, pa.int64()), pa.array(n, pa.int64()), pa.array(b, pa.int64())], ["node", "links", "other"])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:3] != run:
                if len(rows) > 1:
                    yield done()
                run, rows = row[:3], []
            rows.append(row)
    yield done()


def near_vectors(
    vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """Link vectors of one label whose cosine is `threshold` or more.

    Returns `(id_col, n_links, component_id, kept)`, one row for each input row.
    A pair found is exactly at or above the threshold; a pair at the threshold is
    missed with chance MISS, a closer one with less. Vectors that are null, empty,
    zero or hold nulls or non-finite numbers link with nothing, nor do those with
    a null label or null id; vectors of different length never link. Equal
    vectors are one vertex, so copies are counted without being compared. A row
    that links with nothing is its own component (null for a null id). Repeated
    rows link with one another. Other columns are ignored.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("vec"))
    kind = "<f4" if isinstance(rows.schema["vec"].dataType.elementType, T.FloatType) else "<f8"
    rows = rows.mapInArrow(partial(_vectors, kind=kind), "id long, label long, vec binary")
    real = "vec IS NOT NULL AND label IS NOT NULL AND id IS NOT NULL"
    rows = materialise(rows.withColumn("node", F.when(F.expr(real), F.xxhash64("label", "vec"))), "vectors")
    classes = rows.where("node IS NOT NULL").groupBy("node", "label", "vec").agg(F.count("*").alias("copies"), F.min("id").alias("rep"))
    most = classes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    bits, bands = plan(most, threshold)
    codes = materialise(
        classes.select("node", "label", "vec", "copies").mapInArrow(
            partial(_encode, bits=bits, bands=bands, kind=kind), "node long, copies long, vec binary, code binary, factor double, buckets array<long>"
        ),
        "codes",
    )
    met = codes.select("node", F.posexplode("buckets").alias("band", "bucket"))
    sizes = met.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("n")).where("n > 1")
    block = F.pmod("node", "blocks").cast("int")
    dealt = (
        met.join(sizes, "bucket")
        .withColumn("block", block)
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("bucket", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), "band", "block", "node")
    )
    found = materialise(
        dealt.join(codes.drop("buckets"), "node")
        .select("bucket", "low", "high", "band", "block", "node", "copies", "vec", "code", "factor")
        .repartition("bucket", "low", "high")
        .sortWithinPartitions("bucket", "low", "high")
        .mapInArrow(partial(_links, threshold=threshold, bits=bits, bands=bands, kind=kind), "node long, links long, other long"),
        "links",
    )
    reps = classes.select("node", "rep", "copies")
    edges = found.where("other IS NOT NULL").select(F.col("node").alias("u"), F.col("other").alias("v"))
    labels = connected_components(edges).withColumnRenamed("id", "node").join(reps, "node")
    least = labels.groupBy("component").agg(F.min("rep").alias("least"))
    labels = labels.join(least, "component").select("node", "least")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    whole = reps.join(labels, "node", "left").join(counts, "node", "left").select(
        "node", F.coalesce("least", "rep").alias("least"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")
    )
    out = rows.select("id", "node").join(whole, "node", "left")
    component = F.coalesce("least", "id")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("links", F.lit(0)).alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )
