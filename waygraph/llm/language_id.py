"""Language identification by multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waygraph.llm.words import U, flat, mix

#: Labelled texts to learn from, for each language, at most about so many (the bound of the training sample).
TRAIN_ROWS = 6000
FEATURES = 1 << 15
ORDERS = (1, 2, 3)


def held_out(id_col: str) -> Column:
    """crc32 of the id as text leaves 1 by 3; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def ngram_buckets(points: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the documents' code points, order by order, and the document of each."""
    doc = np.repeat(np.arange(len(off) - 1, dtype=np.int32), np.diff(off))
    buckets, owner = [], []
    h = np.zeros(len(points), U)
    for n in range(1, max(ORDERS) + 1):
        m = max(0, len(points) - n + 1)
        h = h[:m] * U(0x100000001B3) + points[n - 1 :].astype(U) + U(n)
        if n in ORDERS:
            inside = doc[:m] == doc[n - 1 :]
            buckets.append((mix(h)[inside] & U(FEATURES - 1)).astype(np.int32))
            owner.append(doc[:m][inside])
    return np.concatenate(buckets), np.concatenate(owner)


def _code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of a batch, white space and digits made one space."""
    data, off = flat(texts)
    whole = data.tobytes().decode("utf-8", "replace")
    size = np.array([0, *np.cumsum(pc.utf8_length(texts.fill_null("")).to_numpy(zero_copy_only=False))])
    points = np.frombuffer(whole.encode("utf-32-le"), np.uint32).copy()
    points[(points >= 65) & (points <= 90)] += 32
    points[((points >= 0xC0) & (points <= 0xDE)) & (points != 0xD7)] += 32
    points[(points < 97) & (points != 39)] = 32
    return points, size.astype(np.int64)


def _slices(texts: pa.Array, most: int = 1 << 19) -> Iterator[pa.Array]:
    size = pc.binary_length(texts.fill_null("")).to_numpy(zero_copy_only=False)
    lo, total = 0, 0
    for i, n in enumerate(size):
        if i > lo and total + n > most:
            yield texts.slice(lo, i - lo)
            lo, total = i, 0
        total += n
    if lo < len(texts):
        yield texts.slice(lo)


def _plain(texts: pa.Array | pa.ChunkedArray) -> pa.Array:
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    return texts.cast(pa.string())


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each language's features: at most one row for each of them and task."""
    total: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), _plain(batch.column(1))
        at = 0
        for part in _slices(texts):
            points, off = _code_points(part)
            buckets, owner = ngram_buckets(points, off)
            names = langs[at : at + len(part)]
            kinds = {x: k for k, x in enumerate(dict.fromkeys(names))}
            of = np.array([kinds[x] for x in names])
            seen = np.bincount(of[owner] * FEATURES + buckets, minlength=len(kinds) * FEATURES).reshape(-1, FEATURES)
            for x, k in kinds.items():
                total[x] = total.get(x, 0) + seen[k]
                docs[x] = docs.get(x, 0) + names.count(x)
            at += len(part)
    for x, c in total.items():
        k = np.flatnonzero(c)
        yield pa.record_batch(
            [pa.array([x] * (len(k) + 1)), pa.array([-1, *k], pa.int32()), pa.array([docs[x], *c[k]], pa.int64())],
            ["lang", "feature", "n"],
        )


def fit(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and log-probabilities (features x languages; the last row has the priors)."""
    rows = docs.where(~held_out(id_col)).select(
        F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")
    ).where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return [], np.zeros((FEATURES + 1, 0), np.float32)
    share = F.create_map(*[F.lit(v) for x, n in sizes.items() for v in (x, min(1.0, per_language / n))])
    drawn = rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)
    counted = (
        drawn.select("lang", "text")
        .repartition(16)
        .mapInArrow(_counts, "lang string, feature int, n long")
        .groupBy("lang", "feature")
        .agg(F.sum("n").alias("n"))
        .toPandas()  # languages x features rows at most
    )
    langs = sorted(counted["lang"].unique())
    table = np.zeros((FEATURES + 1, len(langs)))
    of = {x: k for k, x in enumerate(langs)}
    table[counted["feature"].to_numpy(), counted["lang"].map(of).to_numpy()] = counted["n"].to_numpy()
    prior = table[-1] / max(1, table[-1].sum())
    table = np.log(table + 0.5) - np.log((table[:-1] + 0.5).sum(axis=0))
    table[-1] = np.log(np.maximum(prior, 1e-9))
    return langs, table.astype(np.float32)


def _predict(batches: Iterator[pa.RecordBatch], langs: list[str], table: np.ndarray) -> Iterator[pa.RecordBatch]:
    prior = table[-1]
    for batch in batches:
        texts = _plain(batch.column(2))
        letters = pc.match_substring_regex(texts.fill_null(""), r"\p{L}").to_numpy(zero_copy_only=False)
        best, score = np.zeros(len(texts), int), np.zeros(len(texts))
        at = 0
        for part in _slices(texts) if langs else ():
            buckets, owner = ngram_buckets(*_code_points(part))
            rows = [np.bincount(owner, weights=table[buckets, k], minlength=len(part)) for k in range(len(langs))]
            total = np.stack(rows, axis=1) + prior
            best[at : at + len(part)] = total.argmax(axis=1)
            score[at : at + len(part)] = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            at += len(part)
        known = letters & bool(langs)
        names = [langs[b] if k else "und" for b, k in zip(best, known)]
        yield pa.record_batch(
            [batch.column(0), batch.column(1), pa.array(names), pa.array(np.where(known, score, 0.0))],
            ["id", "held_out", "lang_pred", "score"],
        )


def identify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = TRAIN_ROWS
) -> DataFrame:
    """Predict the language of each whole text, learning from the labelled rows that are not held out.

    The model is fitted on a sample of at most about `per_language` texts for
    each language, drawn by a hash of the id; every row is then scored on its
    whole text. Returns `(id_col, held_out, lang_pred, score)`, one row for each
    input row. A null text, or one without a letter, is `und` with score 0, as
    is any text when there is nothing to learn from. A null id is not held out.
    Repeated rows are each scored; ties go to the language first by name; other
    columns are ignored.
    """
    langs, table = fit(docs, id_col, text_col, lang_col, per_language)
    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(
        partial(_predict, langs=langs, table=table), f"id {kind}, held_out boolean, lang_pred string, score double"
    )
    return out.withColumnRenamed("id", id_col)
