"""N-gram Jaccard self-join by parity sketches.

A text's set of word n-grams is XOR-hashed into a bit sketch: each n-gram flips
one bit, so the Hamming distance of two sketches never exceeds the symmetric
difference of the sets. Two sets of sizes a and b with Jaccard >= t differ in at
most (a + b)(1 - t)/(1 + t) elements. Within a size band whose largest set has
`top` elements that is d = 2 top (1 - t)/(1 + t). A sketch cut into d / 2 + 1 groups
has for every such pair a group with one difference at most (pigeonhole), and of
the few parts of that group all but one are equal. Texts meet on the digest of
(band, group, part left out, bits of the others), and every meeting is verified on
the sets themselves, so no link is lost and none is invented (up to 64-bit collisions).

Exact copies are one vertex from the start: a vertex is a set, named by the
64-bit hash of its elements, so thousands of copies cost one sketch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waygraph.llm.links import FEW, bucket_components
from waygraph.llm.words import U, chunks, flat, mix, shingle_sets
from waygraph.loop import materialise, release

PART_BITS = 256
#: Parts of a group: with more of them a key holds more of the group, and there are more keys.
PARTS = 3
#: Bits of the filter of texts that are compared: 2 MB are broadcast, however many texts there are.
FILTER_BITS = 1 << 23
#: A band's largest size over its smallest; 1.45 gives the fewest sketch parts in all.
BAND = 1.45


def _bands(most: int) -> np.ndarray:
    at = [1]
    while at[-1] <= most:
        at.append(max(at[-1] + 1, int(np.ceil(at[-1] * BAND))))
    return np.array(at)


BANDS = _bands(1 << 40)


def set_name(s: np.ndarray) -> int:
    return int(mix(np.array([np.bitwise_xor.reduce(mix(s ^ U(0x51ED270B))) + U(len(s))], U)).view(np.int64)[0])


def _set(text: bytes, n: int) -> np.ndarray:
    data = np.frombuffer(text, np.uint8)
    return shingle_sets(data, np.array([0, len(data)]), n)[0]


def sketch_keys(s: np.ndarray, percent: int) -> np.ndarray:
    """The bucket keys of a set: for each band in which it may meet a partner, one for each group of its sketch and part left out."""
    n = len(s)
    lo = int(np.searchsorted(BANDS, n, "right")) - 1
    hi = int(np.searchsorted(BANDS, n * 100 // percent, "right")) - 1
    keys = []
    for band in range(lo, hi + 1):
        top = int(BANDS[band + 1]) - 1
        apart = 2 * top * (100 - percent) // (100 + percent)
        groups, parts = apart // 2 + 1, PARTS if apart else 1
        h = mix(s ^ U(band * 0x9E3779B1 + 1))
        part = ((h >> U(8)) % U(groups * parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        part = part[order]
        bit = mix(((h[order] & U(PART_BITS - 1)) << U(32)) ^ part.astype(U) ^ U(0xABCD))
        start = np.flatnonzero(np.diff(part, prepend=-1))
        digest = np.zeros(groups * parts, U)
        digest[part[start]] = np.bitwise_xor.reduceat(bit, start)
        if apart:  # a group without one of its parts
            digest = digest.reshape(groups, parts)
            digest = (np.bitwise_xor.reduce(digest, axis=1)[:, None] ^ digest).ravel()
        keys.append(mix(digest ^ mix(np.arange(len(digest), dtype=U) + (U(band + 1) << U(40)))))
    return np.concatenate(keys).view(np.int64)


def bit_sketch(s: np.ndarray) -> bytes:
    """The whole parity sketch, of 1 to 2 bits an element; sizes are powers of two, so halves XOR into a smaller sketch."""
    bits = max(512, 1 << (len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & U(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def folded(sketch: bytes, width: int) -> np.ndarray:
    """A sketch's halves XORed until `width` words of 64 bits are left."""
    return np.bitwise_xor.reduce(np.frombuffer(sketch, U).reshape(-1, width), axis=0)


def _features(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    for batch in batches:
        sizes, names, bits = [], [], []
        for _, _, data, off in chunks(batch.column(1)):
            for s in shingle_sets(data, off, n):
                sizes.append(len(s))
                names.append(name := set_name(s) if len(s) else None)
                bits.append(None if name is None or name in seen else bit_sketch(s))
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(name)
        yield pa.record_batch(
            [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(names, pa.int64()), pa.array(bits, pa.binary())],
            ["id", "uid", "n", "node", "bits"],
        )


def _possible(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Drop the pairs whose sketches differ in more bits than a link's sets may differ in elements."""
    for batch in batches:
        n = batch["a_n"].to_numpy() + batch["b_n"].to_numpy()
        far = np.zeros(len(n), np.int64)
        for i, (x, y) in enumerate(zip(batch["a_bits"].to_pylist(), batch["b_bits"].to_pylist())):
            width = min(len(x), len(y)) // 8
            far[i] = np.bitwise_count(folded(x, width) ^ folded(y, width)).sum(dtype=np.int64)
        near = pa.array(far * (100 + percent) <= n * (100 - percent))
        yield batch.select(["a", "b", "a_id", "b_id"]).filter(near)


def _sketches(batches: Iterator[pa.RecordBatch], n: int, percent: int) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()  # copies within the task add nothing
    for batch in batches:
        for _, _, data, off in chunks(batch.column(0)):
            keys, nodes = [], []
            for s in shingle_sets(data, off, n):
                if not len(s) or (name := set_name(s)) in seen:
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(name)
                keys.append(k := sketch_keys(s, percent))
                nodes.append(np.full(len(k), name, np.int64))
            if keys:
                yield pa.record_batch([pa.array(np.concatenate(keys)), pa.array(np.concatenate(nodes))], ["key", "node"])


#: A bucket of more nodes than this is compared in pairs of blocks, each in a task of its own.
BLOCK = 2048


def _near(
    node: np.ndarray, label: np.ndarray, n: np.ndarray, bits: list[bytes], percent: int, last: bool
) -> Iterator[tuple[int, int]]:
    """Pairs of different labels whose sketches allow a link; unless `last`, as many as join the labels that can be joined."""
    width = min(map(len, bits)) // 8
    s = np.stack([np.bitwise_xor.reduce(np.frombuffer(b, U).reshape(-1, width), axis=0) for b in bits])
    label = label.copy()
    for i in range(len(node) - 1):
        to = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        if not len(to):
            continue
        far = np.bitwise_count(s[to] ^ s[i]).sum(axis=1, dtype=np.int64)
        to = to[far * (100 + percent) <= (n[to] + n[i]) * (100 - percent)]
        if not last and len(to):
            roots, first = np.unique(label[to], return_index=True)
            to = to[first]
            label[np.isin(label, roots)] = label[i]
        yield from ((int(node[i]), int(node[j])) for j in to)


def _across(batches: Iterator[pa.RecordBatch], percent: int, last: bool) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (key, part): a run is one bucket, or one pair of its blocks."""
    rows: list[list] = [[], [], [], []]
    run = None

    def pairs() -> pa.RecordBatch:
        node, label, n = (np.array(x, np.int64) for x in rows[:3])
        found = [(min(p), max(p)) for p in _near(node, label, n, rows[3], percent, last or len(node) <= FEW)] if len(node) > 1 else []
        a, b = zip(*found) if found else ((), ())
        return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in batches:
        keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        columns = [batch.column(k).to_pylist() for k in range(2, 6)]
        for i, key in enumerate(keys):
            if key != run:
                if run is not None:
                    yield pairs()
                run, rows = key, [[], [], [], []]
            for x, c in zip(rows, columns):
                x.append(c[i])
    if run is not None:
        yield pairs()


def _verified(batches: Iterator[pa.RecordBatch], n: int, percent: int) -> Iterator[pa.RecordBatch]:
    last: tuple[bytes | None, np.ndarray] = (None, np.zeros(0, U))
    for batch in batches:
        a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        (da, oa), (db, ob) = flat(batch.column(2)), flat(batch.column(3))
        keep = np.zeros(len(a), bool)
        for i in range(len(a)):
            t = da[oa[i] : oa[i + 1]].tobytes()
            if last[0] != t:
                last = (t, _set(t, n))
            x, y = last[1], _set(db[ob[i] : ob[i + 1]].tobytes(), n)
            if not len(x) or not len(y):
                continue
            both = len(np.intersect1d(x, y, assume_unique=True))
            # an id that occurs with several texts brings each of them here
            keep[i] = 100 * both >= percent * (len(x) + len(y) - both) and set_name(x) == a[i] and set_name(y) == b[i]
        yield pa.record_batch([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])


def _filter_place() -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))


def _bit_filter(ids: DataFrame) -> DataFrame:
    """(word, bits): a filter of the ids, of FILTER_BITS / 64 rows at most."""
    bits = ids.select(_filter_place().alias("p")).selectExpr("p div 64 AS word", "shiftleft(1L, cast(p % 64 AS int)) AS bit")
    return bits.groupBy("word").agg(F.bit_or("bit").alias("bits"))


def similarity_groups(
    docs: DataFrame, n: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text", named: bool = False
) -> DataFrame:
    """Group texts whose sets of n-word shingles have a Jaccard similarity of `percent` % or more, transitively.

    Words are runs without ASCII white space with A-Z lowered. A text of fewer
    than n words is one shingle. Returns `(id_col, n_shingles, component_id)`,
    one row for each input row, component_id the smallest id reachable; `named`
    adds uid, xxhash64 of id and text, and class, the group's own name (null
    for a text without words). Null and
    empty texts have n_shingles 0 and stand alone; a row whose id is
    null groups with its exact copies only; repeated rows are copies; other columns are
    ignored, whatever their names. An empty table gives an empty result.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    features = rows.select("id", "text", F.xxhash64("id", "text").alias("uid"))
    features = materialise(features.mapInArrow(partial(_features, n=n), "id long, uid long, n long, node long, bits binary"), "features")
    classes = features.where("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("rep"), F.max("n").alias("n"), F.max("bits").alias("bits"))
    classes = materialise(classes, "classes")
    members = rows.select("text").mapInArrow(partial(_sketches, n=n, percent=percent), "key long, node long")

    def verify(pairs: DataFrame) -> DataFrame:
        own = lambda c: classes.select(F.col("node").alias(c), F.col("rep").alias(f"{c}_id"), F.col("n").alias(f"{c}_n"), F.col("bits").alias(f"{c}_bits"))
        sized = pairs.join(own("a"), "a").join(own("b"), "b").where(
            f"100 * least(a_n, b_n) >= {percent} * greatest(a_n, b_n)"
        )
        sized = sized.where("a_id IS NOT NULL AND b_id IS NOT NULL").mapInArrow(partial(_possible, percent=percent), "a long, b long, a_id long, b_id long")
        sized = materialise(sized, "pairs")
        release(pairs, shuffles=True)
        # only texts of pairs are exchanged
        bits = materialise(_bit_filter(sized.select(F.explode(F.array("a_id", "b_id")).alias("id"))), "bits")
        texts = (
            rows.where("id IS NOT NULL").withColumn("p", _filter_place()).withColumn("word", F.expr("p div 64"))
            .join(F.broadcast(bits), "word")  # FILTER_BITS / 64 rows at most
            .where("shiftright(bits, cast(p % 64 AS int)) & 1L = 1L")
        )
        text = lambda c: texts.select(F.col("id").alias(f"{c}_id"), F.col("text").alias(f"{c}_text"))
        return (
            sized.join(text("b").hint("merge"), "b_id")
            .join(text("a").hint("merge"), "a_id")
            .select("a", "b", "a_text", "b_text")
            .mapInArrow(partial(_verified, n=n, percent=percent), "a long, b long")
        )

    def across(inside: DataFrame, last: bool) -> DataFrame:
        bits = classes.select("node", "n", "bits").join(inside.select("node").distinct(), "node", "left_semi")
        count = inside.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        own = F.pmod("node", "blocks").cast("int")
        dealt = inside.join(count, "key").select(
            "key",
            F.explode(
                F.transform(
                    F.sequence(F.lit(0), F.col("blocks") - 1),
                    lambda j: F.concat_ws("-", F.least(j, own), F.greatest(j, own)),
                )
            ).alias("part"),
            "node",
            "label",
        )
        likely = (
            dealt.join(bits, "node")
            .select("key", "part", "node", "label", "n", "bits")
            .repartition("key", "part")
            .sortWithinPartitions("key", "part")
            .mapInArrow(partial(_across, percent=percent, last=last), "a long, b long")
        )
        return verify(likely.distinct())

    labels = bucket_components(members, verify, across, rounds=3).withColumnRenamed("id", "node")
    linked = classes.join(labels, "node")
    least = linked.groupBy("component").agg(F.min("rep").alias("least"))
    found = linked.join(least, "component").select("node", "component", "least")
    whole = classes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("class"), F.coalesce("least", "rep").alias("least"))
    return features.drop("bits").join(whole, "node", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"), *(["uid", "class"] if named else [])
    )
