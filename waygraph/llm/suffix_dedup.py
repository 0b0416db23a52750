"""Removal of repeated byte strings by bucket-pointer refinement.

Suffixes are put in buckets by their first Q bytes, and buckets are refined by
the bucket identifiers of later offsets; what a refinement finds serves the next
(32 bytes to 64, 128 and LENGTH: see `refined`). An identifier is a 64-bit hash
of the bucket's bytes, so that looking up the bucket of a later offset takes no
exchange between tasks. Two things keep the work far below one row a byte:

* Only anchors are sorted: positions whose Q-gram has the least hash in some
  LENGTH-byte string. The choice depends on that string alone, so two copies of
  a string have an anchor at the same offset, and they meet in its bucket.
* An anchor whose bucket survives refinement over all strings that hold it (the
  bytes to both sides) with a second member is done: all of those strings repeat.
  Only the others (near the ends of a copy) are refined string by string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waygraph.llm.words import U, chunks, mix, powers, prefix_hash
from waygraph.loop import materialise, release

LENGTH, Q = 200, 32
SIDE = LENGTH - Q  # an anchor's strings reach so far to its left, and LENGTH to its right
SPAN = SIDE + LENGTH
#: A bucket of more open anchors than this is refined by rows, not in one task's memory.
MOST = 40_000
_STEP = U(0x9FB21C651E98DF25)


def grams(data: np.ndarray) -> np.ndarray:
    """The bucket of each position: the identifier of its Q bytes."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.zeros(0, U)
    h = prefix_hash(data)
    return mix((h[Q : Q + n] - h[:n]) * powers(len(data) + 1)[1][:n])


def refined(h: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """Identifiers of LENGTH bytes from those of Q: each step looks up the bucket of a later offset.

    h: identifiers along the last axis. at: positions to refine (all, if None).
    """
    if at is None:
        two = mix(h[..., :-Q] * _STEP + h[..., Q:])
        four = mix(two[..., : -2 * Q] * _STEP + two[..., 2 * Q :])
        rest = LENGTH - 4 * Q
        return mix(four[..., :-rest] * _STEP + four[..., rest:])
    two = lambda p: mix(h[p] * _STEP + h[p + Q])
    four = lambda p: mix(two(p) * _STEP + two(p + 2 * Q))
    return mix(four(at) * _STEP + four(at + LENGTH - 4 * Q))


def _sliding(x: np.ndarray, w: int, f: np.ufunc, pad: int) -> np.ndarray:
    """f over each run of w elements, in three passes."""
    n = len(x) - w + 1
    blocks = np.full(-(-len(x) // w) * w, pad, x.dtype)
    blocks[: len(x)] = x
    blocks = blocks.reshape(-1, w)
    ahead = f.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = f.accumulate(blocks, axis=1).ravel()
    return f(ahead[:n], behind[w - 1 : w - 1 + n])


def anchors(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchor positions of the documents in a chunk, and all positions' buckets."""
    w = SIDE + 1
    h = grams(data)
    if len(h) < w:
        return np.zeros(0, np.int64), h
    top = np.maximum(h >> U(32), U(1)).astype(np.uint32)  # 0 stands for no string
    least = _sliding(top, w, np.minimum, 0xFFFFFFFF)
    # strings that cross a document's end are none
    for end in off[1:-1]:
        least[max(0, end - LENGTH + 1) : end] = 0
    padded = np.zeros(len(least) + 2 * (w - 1), np.uint32)
    padded[w - 1 : w - 1 + len(least)] = least
    best = _sliding(padded, w, np.maximum, 0)  # over the strings that hold the Q-gram
    return np.flatnonzero((best == top) & (best > 0)), h


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        uid = batch.column(0).to_numpy()
        for lo, hi, data, off in chunks(batch.column(1)):
            at, h = anchors(data, off)
            doc = np.searchsorted(off, at, "right") - 1
            whole = (at - SIDE >= off[doc]) & (at + LENGTH <= off[doc + 1])
            around = np.zeros(len(at), U)
            a = at[whole]
            around[whole] = mix(refined(h, a - SIDE) * _STEP + refined(h, a))
            yield pa.record_batch(
                [pa.array(uid[lo:hi][doc]), pa.array((at - off[doc]).astype(np.int32)), pa.array(h[at].view(np.int64)), pa.array(around.view(np.int64), mask=~whole)],
                ["uid", "pos", "bucket", "around"],
            )


def _surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes to both sides of each listed anchor; what is beyond the text's ends is zero and never compared."""
    for batch in batches:
        uid = batch.column(0).to_pylist()
        for lo, hi, data, off in chunks(batch.column(1)):
            for i in range(lo, hi):
                t = data[off[i - lo] : off[i - lo + 1]]
                padded = np.zeros(len(t) + SPAN, np.uint8)
                padded[SIDE : SIDE + len(t)] = t
                rows = batch.column(2)[i].values
                pos = rows.field("pos").to_numpy().astype(np.int64)
                around = padded[pos[:, None] + np.arange(SPAN)]
                yield pa.record_batch(
                    [
                        rows.field("bucket"), pa.array([uid[i]] * len(pos), pa.int64()), rows.field("pos"), rows.field("open"),
                        pa.array(np.minimum(pos, SIDE).astype(np.int32)), pa.array(np.minimum(len(t) - pos, LENGTH).astype(np.int32)),
                        pa.array([a.tobytes() for a in around], pa.binary()),
                    ],
                    ["bucket", "uid", "pos", "open", "left", "right", "bytes"],
                )


def _strings(bucket: np.ndarray, left: np.ndarray, right: np.ndarray, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor, identifiers of the strings that hold it by their start (SIDE to 0 bytes left of it), and which of them exist."""
    b = np.frombuffer(b"".join(raw), np.uint8)
    h = grams(np.concatenate([b, np.zeros(Q - 1, np.uint8)])).reshape(-1, SPAN)[:, : SPAN - Q + 1]
    back = SIDE - np.arange(SIDE + 1)
    key = mix(refined(h) + mix(bucket.view(U))[:, None] + mix(back.astype(U))[None, :])
    return key, (back <= left[:, None]) & (LENGTH - back <= right[:, None])


def _refine(batches: Iterator[pa.RecordBatch], at_once: int = 3000) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket. Whole buckets are refined together."""
    held: list[pa.RecordBatch] = []

    def done(t: pa.Table) -> pa.RecordBatch:
        bucket, uid, pos, left, right = (t[c].to_numpy() for c in ("bucket", "uid", "pos", "left", "right"))
        open_ = t["open"].to_numpy(zero_copy_only=False)
        keys = np.empty((SIDE + 1, t.num_rows), U)  # by the strings' start
        real = np.empty(keys.shape, bool)
        for i in range(0, t.num_rows, 1000):
            part = slice(i, i + 1000)
            k, r = _strings(bucket[part], left[part], right[part], t["bytes"].slice(i, 1000).to_pylist())
            keys[:, part], real[:, part] = k.T, r.T
        first, last = np.full(t.num_rows, SIDE + 1), np.full(t.num_rows, -1)
        for at in range(SIDE + 1):
            order = np.argsort(keys[at])
            order = order[real[at][order]]
            same = np.diff(keys[at][order]) == 0
            twice = np.zeros(len(order), bool)
            twice[1:] |= same
            twice[:-1] |= same
            first[order[twice]] = np.minimum(first[order[twice]], at)
            last[order[twice]] = at
        some = open_ & (last >= 0)
        start, end = pos - SIDE + first, pos - SIDE + last + LENGTH
        columns = [pa.array(uid[some]), pa.array(start[some].astype(np.int32)), pa.array(end[some].astype(np.int32))]
        return pa.record_batch(columns, ["uid", "start", "end"])

    for batch in batches:
        held.append(batch)
        t = pa.Table.from_batches(held)
        while t.num_rows > at_once:
            bucket = t["bucket"].to_numpy()
            cut = np.flatnonzero(np.diff(bucket[at_once - 1 :]))
            if not len(cut):
                break
            n = at_once + int(cut[0])
            yield done(t.slice(0, n))
            t = t.slice(n)
        held = t.to_batches()
    if held and (t := pa.Table.from_batches(held)).num_rows:
        yield done(t)


def _string_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 1000):
            b = batch.slice(i, 1000)
            bucket, uid, pos, left, right = (b[c].to_numpy() for c in ("bucket", "uid", "pos", "left", "right"))
            key, real = _strings(bucket, left, right, b["bytes"].to_pylist())
            row, back = np.nonzero(real)
            yield pa.record_batch(
                [pa.array(key[real].view(np.int64)), pa.array(uid[row]), pa.array((pos[row] - SIDE + back).astype(np.int32)), pa.array(b["open"].to_numpy(zero_copy_only=False)[row])],
                ["key", "uid", "start", "open"],
            )


def _cut(batches: Iterator[pa.RecordBatch], kept: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_bytes, removed, runs, sha, rest = [], [], [], [], []
        spans = batch.column(2)
        for lo, hi, data, off in chunks(batch.column(1)):
            for i in range(lo, hi):
                t = data[off[i - lo] : off[i - lo + 1]]
                n_bytes.append(len(t))
                if spans[i].is_valid:
                    edge = np.zeros(len(t) + 1, np.int32)
                    np.add.at(edge, spans[i].values.field("start").to_numpy(), 1)
                    np.add.at(edge, spans[i].values.field("end").to_numpy(), -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    removed.append(int(gone.sum()))
                    runs.append(int((gone & ~np.concatenate([[False], gone[:-1]])).sum()))
                    left = t[~gone].tobytes()
                else:
                    removed.append(0)
                    runs.append(0)
                    left = t.tobytes()
                sha.append(hashlib.sha256(left).hexdigest())
                rest.append(left if kept else None)
        columns = [batch.column(0), *(pa.array(x, pa.int64()) for x in (n_bytes, removed, runs)), pa.array(sha, pa.string()), pa.array(rest, pa.binary())]
        yield pa.record_batch(columns, ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kept: bool = False) -> DataFrame:
    """Remove from each text every byte of a LENGTH-byte string that also starts elsewhere, in it or in another text.

    Texts are UTF-8 bytes, strings never cross texts, and all are judged on the
    input. Returns `(id_col, n_bytes, n_removed, n_spans, kept_sha256)`, and with
    `kept` the remaining bytes, one row for each input row. Null and empty texts
    lose nothing. Repeated rows are places of their own, so they lose everything
    from LENGTH bytes on. Null and repeated ids are allowed (the texts are then
    written once with row numbers). Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    ids = rows.agg(F.count("*").alias("n"), F.count("id").alias("known")).first()
    integral = kind in ("bigint", "int", "smallint", "tinyint")
    if integral and ids["n"] == ids["known"] and rows.groupBy("id").count().where("count > 1").isEmpty():
        rows = rows.withColumn("uid", F.col("id").cast("long"))
    else:
        rows = materialise(rows.withColumn("uid", F.monotonically_increasing_id()), "rows")
    found = materialise(rows.select("uid", "text").mapInArrow(_anchor_rows, "uid long, pos int, bucket long, around long"), "anchors")
    met = found.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    met = materialise(met, "met")  # a table of its own, so that the join can be split at a bucket with very many anchors
    shared = materialise(found.join(met, "bucket"), "shared")
    release(found, shuffles=True)
    release(met)
    kinds = shared.where("around IS NOT NULL").groupBy("bucket", "around").agg(F.count("*").alias("n"), F.min(F.struct("uid", "pos")).alias("one"))
    kinds = materialise(kinds, "kinds")
    whole = shared.join(kinds.where("n > 1").select("bucket", "around"), ["bucket", "around"], "left_semi")
    done = whole.select("uid", F.greatest(F.col("pos") - SIDE, F.lit(0)).alias("start"), (F.col("pos") + LENGTH).alias("end"))
    open_ = (
        kinds.where("n = 1").select("bucket", "one.uid", "one.pos")
        .unionAll(shared.where("around IS NULL").select("bucket", "uid", "pos"))
    )
    sizes = open_.groupBy("bucket").agg(F.count("*").alias("n"))
    many = kinds.where("n > 1").groupBy("bucket").agg(F.count("*").alias("m"))
    sizes = sizes.join(many, "bucket", "left").select("bucket", (F.col("n") + F.coalesce("m", F.lit(0)) > MOST).alias("large"), (F.col("n") + F.coalesce("m", F.lit(0)) > 1).alias("some"))
    listed = materialise(
        open_.select("bucket", "uid", "pos", F.lit(True).alias("open"))
        .unionAll(kinds.where("n > 1").select("bucket", "one.uid", "one.pos", F.lit(False).alias("open")))
        .join(sizes.where("some"), "bucket"),
        "listed",
    )

    def around(some: DataFrame) -> DataFrame:
        of_text = some.groupBy("uid").agg(F.collect_list(F.struct("bucket", "pos", "open")).alias("anchors"))
        return rows.select("uid", "text").join(of_text, "uid").mapInArrow(
            _surroundings, "bucket long, uid long, pos int, open boolean, left int, right int, bytes binary"
        )

    spans = "uid long, start int, end int"
    small = around(listed.where("NOT large")).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_refine, spans)
    small = materialise(small, "spans")
    gone = done.unionAll(small)
    if not listed.where("large").isEmpty():
        strings = around(listed.where("large")).mapInArrow(_string_rows, "key long, uid long, start int, open boolean")
        strings = materialise(strings, "strings")
        twice = strings.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
        gone = gone.unionAll(strings.where("open").join(twice, "key").select("uid", "start", (F.col("start") + LENGTH).alias("end")))
    release(listed, shuffles=True)
    gone = gone.groupBy("uid").agg(F.collect_list(F.struct("start", "end")).alias("spans"))  # of one text
    out = rows.join(gone, "uid", "left").select("id", "text", "spans").mapInArrow(
        partial(_cut, kept=kept), f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )
    out = out.withColumnRenamed("id", id_col)
    return out if kept else out.drop("kept")
