"""Importance resampling towards a target's distribution of hashed n-grams.

Each text's features (runs of words) fall into buckets; a bucket's gain is the
log ratio of its share in the target and in the corpus, a text's weight the mean
gain of its features, and adding Gumbel noise to the weights and taking the
highest scores draws without replacement.

Long texts are cut into overlapping chunks at word boundaries. A chunk owns the
runs that start in its own words and carries the next n - 1 words, which its
last runs need; so each run is counted once, in one chunk, and a text of any
length is dealt over many tasks. Counts and gains of chunks are added up by
document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waygraph.functions.order import running_total
from waygraph.loop import materialise
from waygraph.llm.words import chunks

#: Bytes of a chunk's own words; texts of more are cut.
CHUNK = 1 << 15
#: A run of more bytes is hashed by the library, a shorter one together with all others.
LONG_RUN = 64


def _crc_table() -> np.ndarray:
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, (x >> 1) ^ np.uint32(0xEDB88320), x >> 1)
    return x


CRC = _crc_table()
#: Bytes of words: digits, letters and all beyond ASCII.
WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def crc32(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of each slice of the bytes."""
    size = ends - starts
    out = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    live = np.flatnonzero(size <= LONG_RUN)
    live = live[np.argsort(size[live], kind="stable")]
    lengths, k = size[live], 0
    while len(live):
        first = int(np.searchsorted(lengths, k, "right"))  # those that have ended
        live, lengths = live[first:], lengths[first:]
        c = out[live]
        out[live] = CRC[(c ^ data[starts[live] + k]) & 0xFF] ^ (c >> np.uint32(8))
        k += 1
    out ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > LONG_RUN):
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes())
    return out


def word_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and per document the first word's index."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = WORD[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[off] = True
    starts = np.flatnonzero(inside & (~np.concatenate([[False], inside[:-1]]) | cut[:-1]))
    ends = np.flatnonzero(inside & (~np.concatenate([inside[1:], [False]]) | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def runs(data: np.ndarray, off: np.ndarray, own: np.ndarray, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all runs of 1 to n words that start in a document's own first words, the document of each, and words per document.

    own: how many words of each document are its own; -1 for all.
    """
    starts, ends, first = word_bounds(data, off)
    many = np.diff(first)
    own = np.where(own < 0, many, np.minimum(own, many))
    doc = np.repeat(np.arange(len(many), dtype=np.int64), many)
    mine = np.arange(len(starts)) - first[doc] < own[doc]
    # words side by side, one space between, so that a run is a slice
    size = ends - starts
    place = np.concatenate([[0], np.cumsum(size + 1)])
    total = int(size.sum())
    joined = np.full(int(place[-1]), 0x20, np.uint8)
    inside = np.arange(total) - np.repeat(np.cumsum(size) - size, size)  # the byte's place in its word
    joined[np.repeat(place[:-1], size) + inside] = LOWER[data[np.repeat(starts, size) + inside]]
    found, owner = [], []
    for k in range(n):
        i = np.flatnonzero(mine)
        i = i[i + k < first[doc[i] + 1]] if len(i) else i
        found.append((crc32(joined, place[i], place[i + k] + size[i + k]) % np.uint32(buckets)).astype(np.int64))
        owner.append(doc[i])
    return np.concatenate(found), np.concatenate(owner), own


def _split(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Chunks of texts: (id, key, part, data, own), data being bytes."""
    for batch in batches:
        for row, text in enumerate(batch.column(2)):
            data = np.frombuffer((text.as_py() or "").encode(), np.uint8)
            starts, ends, _ = word_bounds(data, np.array([0, len(data)]))
            pieces, own, lo = [], [], 0
            while lo < len(starts):  # a chunk has one word at least
                hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + CHUNK, "right")))
                pieces.append(data[starts[lo] : ends[min(hi + n - 1, len(starts)) - 1]].tobytes())
                own.append(hi - lo)
                lo = hi
            if not pieces:
                pieces, own = [b""], [0]
            many = len(pieces)
            same = [pa.concat_arrays([batch.column(k).slice(row, 1)] * many) for k in (0, 1)]
            yield pa.record_batch([*same, pa.array(range(many), pa.int64()), pa.array(pieces, pa.binary()), pa.array(own, pa.int64())], ["id", "key", "part", "data", "own"])


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    own = batch.column("own").to_numpy(zero_copy_only=False)
    for lo, hi, data, off in chunks(batch.column("data")):
        yield lo, hi, data, off, own[lo:hi]


def _bucket_counts(batches: Iterator[pa.RecordBatch], n: int, buckets: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(buckets, np.int64)
    for batch in batches:
        for _, _, data, off, own in _parts(batch):
            total += np.bincount(runs(data, off, own, n, buckets)[0], minlength=buckets)
    used = np.flatnonzero(total)
    yield pa.record_batch([pa.array(used), pa.array(total[used])], ["bucket", "n"])


def _gains(batches: Iterator[pa.RecordBatch], n: int, gain: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        features, words, gained = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
        for lo, hi, data, off, own in _parts(batch):
            bucket, doc, many = runs(data, off, own, n, len(gain))
            features[lo:hi] = np.bincount(doc, minlength=hi - lo)
            np.add.at(gained[lo:hi], doc, gain[bucket])
            words[lo:hi] = many
        yield pa.record_batch([*batch.columns[:3], pa.array(features), pa.array(words), pa.array(gained)], ["id", "key", "part", "n_features", "n_words", "gained"])


def _pieces(docs: DataFrame, n: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Short texts as they are, and the chunks of long ones, dealt anew: (id, key, part, data, own)."""
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text, F.lit(1)).alias("key"), text.alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    short = rows.where(size <= CHUNK).select("id", "key", F.lit(0).cast("long").alias("part"), F.col("text").cast("binary").alias("data"), F.lit(-1).cast("long").alias("own"))
    kind = rows.schema["id"].dataType.simpleString()
    long = rows.where(size > CHUNK).mapInArrow(partial(_split, n=n), f"id {kind}, key long, part long, data binary, own long")
    return short, long.repartition("key", "part", "id")


def feature_counts(docs: DataFrame, n: int = 1, buckets: int = 10_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(bucket, n) of all features of the texts; buckets without any are absent. A task sends a row for each bucket at most."""
    counted = None
    for part in _pieces(docs, n, id_col, text_col):
        one = part.mapInArrow(partial(_bucket_counts, n=n, buckets=buckets), "bucket long, n long")
        counted = one if counted is None else counted.unionAll(one)
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, id_col: str = "doc_id", target_id: str = "item_id") -> DataFrame:
    """(bucket, gain): 1000 times the log ratio of smoothed shares, rounded down, for every bucket."""
    every = docs.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    ours = feature_counts(docs, n, buckets, id_col).withColumnRenamed("n", "s")
    theirs = feature_counts(target, n, buckets, target_id).withColumnRenamed("n", "t")
    both = every.join(ours, "bucket", "left").join(theirs, "bucket", "left").select("bucket", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in "st"])
    sums = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    ratio = (F.col("t") + 1) * (F.col("all_s") + buckets) / ((F.col("s") + 1) * (F.col("all_t") + buckets))
    return both.crossJoin(F.broadcast(sums)).select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))  # one row of sums


def noise(id_col: Column, seed: int) -> Column:
    """1000 times a Gumbel variate that the id and the seed choose, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def _ranked(scored: DataFrame, percent: int, least_words: int) -> DataFrame:
    """Adds rank to the drawn rows: where to cut comes from counts by score, of which there are few; only rows above it are sorted."""
    scored = materialise(scored, "scored")
    can = F.col("n_words") >= least_words
    draw = scored.where(can).count() * percent // 100
    ahead = F.sum("n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1))
    by_score = scored.where(can).groupBy("score").agg(F.count("*").alias("n")).withColumn("ahead", F.coalesce(ahead, F.lit(0)))
    cut = by_score.where(F.col("ahead") < draw).agg(F.min("score")).first()[0]
    none = F.lit(None).cast("long")
    if cut is None:
        return scored.withColumn("rank", none)
    above = can & (F.col("score") >= cut)
    order = F.struct((-F.col("score")).alias("s"), F.col("id").isNull().alias("null"), "id", F.monotonically_increasing_id().alias("row"))
    top = running_total(scored.where(above).withColumn("_order", order), "_order", F.lit(1).cast("long")).withColumn("rank", F.col("before") + 1)
    top = top.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank"))).drop("_order", "before")
    return top.unionByName(scored.where(~above).withColumn("rank", none))


def resample(
    docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024,
    id_col: str = "doc_id", target_id: str = "item_id",
) -> DataFrame:
    """Weights of all texts and the draw: (id_col, n_features, weight, score, rank), one row for each input row in no order.

    Of the texts with at least `least_words` words `percent` in a hundred are
    drawn, by score, ties to the smaller id (null ids last; rows with the same
    id and text then in any order, as they are alike); rank is null for the
    others. Null and empty texts have no features and weight 0; a null id
    counts as an empty one in the noise; repeated rows are counted each; other
    columns are ignored, whatever their names. An empty target leaves only the
    corpus' shares to weigh by. No text is cut off: chunks of long ones are
    added up by id and text.

    The driver gets one number for each bucket; every worker holds them.
    """
    spark = docs.sparkSession
    gain = np.zeros(buckets, np.int64)
    for row in bucket_gains(docs, target, n, buckets, id_col, target_id).collect():  # `buckets` rows
        gain[row["bucket"]] = row["gain"]
    kind = docs.schema[id_col].dataType.simpleString()
    weigh = lambda part: part.mapInArrow(partial(_gains, n=n, gain=gain), f"id {kind}, key long, part long, n_features long, n_words long, gained long")
    short, long = map(weigh, _pieces(docs, n, id_col, "text"))
    sums = [F.sum(c).alias(c) for c in ("n_features", "n_words", "gained")]
    whole = long.groupBy("id", "key").agg(*sums, F.count(F.when(F.col("part") == 0, 1)).alias("copies"))
    # copies of a long text have the same sums
    whole = whole.select("id", "key", *[F.expr(f"{c} div copies").alias(c) for c in ("n_features", "n_words", "gained")], F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    both = short.select("id", "key", "n_features", "n_words", "gained", F.lit(1).alias("copy")).unionByName(whole)
    mean = F.when(F.col("n_features") > 0, F.expr("(gained - pmod(gained, n_features)) div n_features")).otherwise(F.lit(0)).cast("long")
    scored = both.select("id", "key", "copy", "n_features", "n_words", mean.alias("weight")).withColumn("score", (F.col("weight") + noise(F.col("id"), seed)).cast("long"))
    return _ranked(scored, percent, least_words).select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
