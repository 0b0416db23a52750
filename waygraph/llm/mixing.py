"""Mixing sources to target weights by Pfair scheduling.

A source of weight w (its share of all weights, as an exact fraction) may give its
block k from slot floor(k / w) on and has to by slot ceil((k + 1) / w); at each slot
the released block with the earliest deadline goes next. As the weights add up to
one, no deadline is missed, and at every slot each source has had its target number
of blocks to within less than one, against the very weights given, however long the
mix is. A block grows with the corpus, so that the schedule has about SLOTS entries
at any size and goes to every task; the rows themselves are only numbered and joined.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Documents of a block at least, and about how many blocks there are at most.
BLOCK_DOCS, SLOTS = 16, 1 << 18
#: Numbering splits each source by three hexadecimal digits of a hash, 4,096 parts.
DIGITS = 3


def schedule(weights: dict[str, float], blocks: dict[str, int]) -> tuple[list[tuple[str, int]], int]:
    """(source, block) slot by slot, and the last slot before which no source has run out.

    Ties go by name. What the other sources have left then follows, by the same rule but without gaps.
    """
    exact = {x: Fraction(weights[x]) for x in sorted(blocks)}
    if any(not w > 0 for w in exact.values()):
        raise ValueError("weights must be above 0")
    total = sum(exact.values())
    rate = {x: (w / total).as_integer_ratio() for x, w in exact.items()}
    waiting = [(0, x, 0) for x in exact if blocks[x] > 0]
    ready: list[tuple[int, str, int]] = []
    out: list[tuple[str, int]] = []
    ends = None
    heapq.heapify(waiting)
    while waiting or ready:
        while waiting and (waiting[0][0] <= len(out) or not ready):
            _, x, k = heapq.heappop(waiting)
            n, d = rate[x]
            heapq.heappush(ready, (-(-(k + 1) * d // n), x, k))
        due, x, k = heapq.heappop(ready)
        if ends is None and due <= len(out):
            raise AssertionError("a deadline was missed")
        if k + 1 < blocks[x]:
            n, d = rate[x]
            heapq.heappush(waiting, ((k + 1) * d // n, x, k + 1))
        elif ends is None:
            ends = len(out)
        out.append((x, k))
    return out, ends or 0


def mix_sources(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    block_docs: int | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    keep: list[str] | None = None,
) -> DataFrame:
    """Order all rows so that every stretch holds the sources in the target proportions.

    weights: by source; by default the square root of each source's number of
    rows. A null source is the source ''. Sources that are not in `weights` are
    an error, weights of sources without rows are ignored. Within a source rows go
    by md5 of the id, then by id, in blocks of `block_docs` rows (by default
    BLOCK_DOCS, or more so that there are about SLOTS blocks); a row without an
    id goes by a hash of its columns of simple types. Returns the columns `keep` (the id and
    the source by default) with block, slot and position (rising in the mix, and
    unique; a shorter last block leaves a gap) and in_mix: whether every source
    still had blocks at that slot, up to which the deviation bound holds. An added
    column is called mix_<name> where a kept one has its name. All rows are
    kept, repeated ones too: what is left of larger sources follows. An empty
    table gives an empty result. The sources and their counts come to the driver
    (more than SLOTS of them are an error), the rows never do: a source is numbered in 4,096
    parts, so even one with a third of all rows is spread over that many groups.
    """
    source = F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit(""))
    row_hash = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if isinstance(f.dataType, T.AtomicType) and f.dataType.typeName() != "variant"])
    own = F.col(f"`{id_col}`")
    keep = keep or [id_col, source_col]
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), source.alias("of"), own.alias("id"), row_hash.alias("hash"),
        F.md5(F.coalesce(own.cast("string"), row_hash.cast("string")).cast("binary")).alias("md5"),
    ).withColumn("part", F.substring("md5", 1, DIGITS))
    counts = rows.groupBy("of", "part").agg(F.count("*").alias("n"))
    sizes = {r["of"]: r["n"] for r in counts.groupBy("of").agg(F.sum("n").alias("n")).limit(SLOTS + 1).collect()}
    if len(sizes) > SLOTS:
        raise ValueError(f"more than {SLOTS} sources")
    if weights is None:
        weights = {x: n**0.5 for x, n in sizes.items()}
    elif missing := sorted(set(sizes) - set(weights)):
        raise ValueError(f"sources without a weight: {missing}")
    size = block_docs or max(BLOCK_DOCS, -(-sum(sizes.values()) // SLOTS))
    order, ends = schedule(weights, {x: -(-n // size) for x, n in sizes.items()})
    of, block = zip(*order) if order else ((), ())
    plan = pa.table({"of": pa.array(of, pa.string()), "block": pa.array(block, pa.int64()), "slot": pa.array(range(len(order)), pa.int64())})
    slots = docs.sparkSession.createDataFrame(plan)
    before = Window.partitionBy("of").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("of", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("of", "part").orderBy("md5", "id", "hash")
    numbered = (
        rows.withColumn("nth", F.row_number().over(inside) - 1)
        .join(before, ["of", "part"])
        .select("row", "of", (F.col("nth") + F.col("before")).alias("nth"))
        .withColumn("block", F.expr(f"nth div {size}"))
        .join(F.broadcast(slots), ["of", "block"])  # SLOTS rows and one for each source, at most
    )
    added = {"block": F.col("block"), "slot": F.col("slot"), "position": F.col("slot") * size + F.col("nth") % size, "in_mix": F.col("slot") <= ends}
    return numbered.select(
        *[F.col(f"row.`{c}`").alias(c) for c in keep],
        *[x.alias(f"mix_{c}" if c in keep else c) for c, x in added.items()],
    )
