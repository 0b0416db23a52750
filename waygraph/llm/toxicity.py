"""Toxicity by a bidirectional gated recurrent network over overlapping word windows.

Each word enters as the sum of two inputs: an embedding of its hash and the mean
embedding of its hashed character n-grams. A GRU reads each window both ways,
attention pools the states, and a document's score is that of its highest
window. The network is trained in numpy in a task of its own, on a bounded sample of labelled
documents, by multiple-instance learning: a toxic document stands for its most
telling window, a clean one for random windows and those that the current model
finds worst.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waygraph.llm.language_id import held_out
from waygraph.llm.words import TABLE, U, chunks, mix, powers, prefix_hash

#: The bounds of the training sample: labelled documents, at most about so many of either label, and the bytes of their texts.
TRAIN_ROWS, TRAIN_BYTES = 1500, 32 << 20
#: Gradient steps at least, however small the sample.
LEAST_STEPS = 300
WINDOW, STRIDE = 24, 16
HIDDEN, EMBED, ROWS = 8, 8, 1 << 14
GRAMS = (3, 4)

#: Bytes of words: letters, digits, the apostrophe and all of multi-byte characters.
LETTER = np.zeros(256, bool)
LETTER[[39, *range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, and per document the first word's index."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = LETTER[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[off] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


class Words:
    """The distinct words of a chunk: each occurrence's number, and each word's input rows."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        starts, ends, self.first = word_spans(data, off)
        up, down = powers(len(data) + 1)
        h = prefix_hash(data)
        name = mix((h[ends] - h[starts]) * down[starts])
        _, at, self.number = np.unique(name, return_index=True, return_inverse=True)
        s, e = starts[at], ends[at]
        self.word_row = (name[at] & U(ROWS - 1)).astype(np.int32)
        # n-grams over the word with a mark at either end: position s - 1 is the left mark
        size = (e - s) + 2
        edge = np.cumsum(size) - size
        letters = np.empty(int(size.sum()), np.uint8)
        rank = np.arange(len(letters)) - np.repeat(edge, size)
        source = np.repeat(s, size) + rank - 1
        letters[:] = data[np.clip(source, 0, max(0, len(data) - 1))] if len(data) else 0
        letters[edge] = letters[edge + size - 1] = 32
        h = prefix_hash(letters)
        up, down = powers(len(letters) + 1)
        word = np.repeat(np.arange(len(at)), size)
        rows, owner = [], []
        for n in GRAMS:
            i = np.flatnonzero(rank + n <= np.repeat(size, size))
            rows.append((mix((h[i + n] - h[i]) * down[i] + U(n)) & U(ROWS - 1)).astype(np.int32))
            owner.append(word[i])
        rows, owner = np.concatenate(rows), np.concatenate(owner)
        order = np.argsort(owner, kind="stable")
        self.gram_row, self.gram_word = rows[order], owner[order]
        self.gram_count = np.bincount(owner, minlength=len(at)).astype(np.float32)

    def inputs(self, word_table: np.ndarray, gram_table: np.ndarray) -> np.ndarray:
        """Rows of the word table plus the means of rows of the n-gram table, for each distinct word."""
        if not len(self.word_row):
            return np.zeros((0, word_table.shape[1]), np.float32)
        start = np.searchsorted(self.gram_word, np.arange(len(self.word_row)))
        grams = np.add.reduceat(gram_table[self.gram_row], start, axis=0)
        return word_table[self.word_row] + grams / self.gram_count[:, None]

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word numbers of each window (-1: none), its length, and its document. The windows of a text overlap and cover it."""
        n = np.diff(self.first)
        per = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)), 0)
        doc = np.repeat(np.arange(len(n)), per)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
        start = np.minimum(k * STRIDE, np.maximum(0, n[doc] - WINDOW))
        size = np.minimum(WINDOW, n[doc] - start)
        at = (self.first[doc] + start)[:, None] + np.arange(WINDOW)
        inside = np.arange(WINDOW) < size[:, None]
        number = np.where(inside, self.number[np.minimum(at, max(0, len(self.number) - 1))] if len(self.number) else 0, -1)
        return number, size, doc


def start_weights(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    w = {"word": rng.normal(0, 0.1, (ROWS, EMBED)), "gram": rng.normal(0, 0.1, (ROWS, EMBED))}
    for d in "fb":
        w[f"W{d}"] = rng.normal(0, EMBED**-0.5, (EMBED, 3 * HIDDEN))
        w[f"c{d}"] = np.zeros(3 * HIDDEN)
        w[f"U{d}"] = rng.normal(0, HIDDEN**-0.5, (HIDDEN, 3 * HIDDEN))
    w["att"], w["out"], w["bias"] = rng.normal(0, 0.1, 2 * HIDDEN), rng.normal(0, 0.3, 2 * HIDDEN), np.zeros(1)
    return {k: v.astype(np.float32) for k, v in w.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def forward(x: dict[str, np.ndarray], size: np.ndarray, w: dict[str, np.ndarray], keep: bool = False):
    """x: by direction, the projected inputs (time x window x 3 hidden). Returns the windows' logits, with what backward needs if `keep`."""
    steps, many = x["f"].shape[:2]
    state = np.empty((steps, many, 2 * HIDDEN), np.float32)
    saved = {"f": [], "b": []}
    for k, d in enumerate("fb"):
        h = np.zeros((many, HIDDEN), np.float32)
        for t in range(steps) if d == "f" else reversed(range(steps)):
            u = h @ w[f"U{d}"]
            zr = _sigmoid(x[d][t, :, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(x[d][t, :, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
            on = (t < size)[:, None]
            new = np.where(on, n + z * (h - n), h)
            if keep:
                saved[d].append((t, h, z, r, n, u[:, 2 * HIDDEN :], on))
            h = new
            state[t, :, k * HIDDEN : (k + 1) * HIDDEN] = h
    a = state @ w["att"]
    a = np.where(np.arange(steps)[:, None] < size, a, -1e9)
    a = np.exp(a - a.max(axis=0))
    a /= a.sum(axis=0)
    pooled = np.einsum("tm,tmh->mh", a, state)
    logit = pooled @ w["out"] + w["bias"][0]
    return (logit, state, a, pooled, saved) if keep else logit


def backward(x: dict, size: np.ndarray, w: dict, kept: tuple, dlogit: np.ndarray) -> tuple[dict, dict]:
    """Gradients of the weights, and of the projected inputs."""
    _, state, a, pooled, saved = kept
    g = {"out": pooled.T @ dlogit, "bias": np.array([dlogit.sum()], np.float32)}
    dpooled = dlogit[:, None] * w["out"]
    da = np.einsum("mh,tmh->tm", dpooled, state)
    da = a * (da - (a * da).sum(axis=0))
    g["att"] = np.einsum("tm,tmh->h", da, state)
    dstate = a[:, :, None] * dpooled + da[:, :, None] * w["att"]
    dx = {}
    for k, d in enumerate("fb"):
        dx[d] = np.zeros_like(x[d])
        g[f"U{d}"] = np.zeros_like(w[f"U{d}"])
        dh = np.zeros((len(size), HIDDEN), np.float32)
        for t, h, z, r, n, un, on in reversed(saved[d]):
            dh = dh + dstate[t, :, k * HIDDEN : (k + 1) * HIDDEN]
            live = np.where(on, dh, 0)
            dn = live * (1 - z) * (1 - n * n)
            gates = np.concatenate([live * (h - n) * z * (1 - z), dn * un * r * (1 - r), dn], axis=1)
            dx[d][t] = gates
            inner = np.concatenate([gates[:, : 2 * HIDDEN], dn * r], axis=1)
            g[f"U{d}"] += h.T @ inner
            dh = np.where(on, dh * z, dh) + inner @ w[f"U{d}"].T
        g[f"c{d}"] = dx[d].sum(axis=(0, 1))
    return g, dx


def project(words: Words, w: dict) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Inputs of the distinct words, and their projections; the last row is for places without a word."""
    x = np.concatenate([words.inputs(w["word"], w["gram"]), np.zeros((1, EMBED), np.float32)])
    return x, {d: x @ w[f"W{d}"] + w[f"c{d}"] for d in "fb"}


def window_logits(number: np.ndarray, size: np.ndarray, p: dict, w: dict, most: int = 2048) -> np.ndarray:
    out = [np.zeros(0, np.float32)]
    for i in range(0, len(number), most):
        t = number[i : i + most].T
        out.append(forward({d: p[d][t] for d in "fb"}, size[i : i + most], w))
    return np.concatenate(out)


def _telling(words: Words, doc_toxic: np.ndarray, number: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """A first guess at how telling each window is: its word or n-gram that is most one-sided by documents."""

    def scores(ids: np.ndarray, many: int) -> np.ndarray:
        pair = np.unique(ids.astype(np.int64) * len(doc_toxic) + owner)
        toxic = np.bincount(pair // len(doc_toxic), weights=doc_toxic[pair % len(doc_toxic)], minlength=many)
        total = np.bincount(pair // len(doc_toxic), minlength=many)
        share = doc_toxic.mean()
        return (toxic - total * share) / np.sqrt(total * share * (1 - share) + 3)

    owner = np.repeat(np.arange(len(doc_toxic)), np.diff(words.first))
    best = scores(words.number, len(words.word_row))
    return np.where(number >= 0, best[number], -1e9).max(axis=1)


def train(texts: list[str], toxic: list[int], epochs: int = 6, seed: int = 7, batch: int = 128) -> dict[str, np.ndarray]:
    """Fit the network to a bounded sample of labelled texts."""
    w = start_weights(seed)
    y = np.array(toxic, np.float32)
    if not len(y) or y.min() == y.max():
        w["out"][:] = 0
        w["bias"][:] = -4.0 if not len(y) or y.max() == 0 else 4.0
        return w
    rng = np.random.default_rng(seed)
    column = pc.utf8_lower(pa.array(texts, pa.large_string()))
    (_, _, data, off), = chunks(column, 1 << 60)
    words = Words(data, off)
    number, size, doc = words.windows()
    y = y[: len(off) - 1]
    rank = _telling(words, y, number, doc)
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in w.items()}
    step = 0
    start = np.searchsorted(words.gram_word, np.arange(len(words.word_row) + 1))
    batch = min(batch, max(16, len(y) // 8))
    epochs = max(epochs, -(-LEAST_STEPS * batch // (3 * len(y))))
    for epoch in range(epochs):
        if epoch >= 2:
            rank = window_logits(number, size, project(words, w)[1], w)
        order = np.lexsort((-rank, doc))
        top = order[np.searchsorted(doc[order], np.unique(doc))]
        clean = np.flatnonzero(y[doc] == 0)
        some = rng.choice(clean, min(len(clean), 2 * len(top)), replace=False) if len(clean) else clean
        use = rng.permutation(np.concatenate([top, top[y[doc[top]] == 1], some]))
        for i in range(0, len(use), batch):
            b = use[i : i + batch]
            t = number[b].T
            used, back = np.unique(t, return_inverse=True)
            back = back.reshape(t.shape)
            used = used[used >= 0]
            pad = int((t < 0).any())
            gram = np.concatenate([np.arange(start[u], start[u + 1]) for u in used])
            gram_of = np.repeat(np.arange(len(used)), start[used + 1] - start[used])
            edge = np.searchsorted(gram_of, np.arange(len(used)))
            count = words.gram_count[used][:, None]
            x = w["word"][words.word_row[used]] + np.add.reduceat(w["gram"][words.gram_row[gram]], edge, axis=0) / count
            x = np.concatenate([np.zeros((pad, EMBED), np.float32), x])
            p = {d: (x @ w[f"W{d}"] + w[f"c{d}"])[back] for d in "fb"}
            kept = forward(p, size[b], w, keep=True)
            g, dp = backward(p, size[b], w, kept, ((_sigmoid(kept[0]) - y[doc[b]]) / len(b)).astype(np.float32))
            dx = np.zeros_like(x)
            for d in "fb":
                flat = dp[d].reshape(-1, 3 * HIDDEN)
                g[f"W{d}"] = x[back.ravel()].T @ flat
                np.add.at(dx, back.ravel(), flat @ w[f"W{d}"].T)
            dx = dx[pad:]
            g["word"], g["gram"] = np.zeros_like(w["word"]), np.zeros_like(w["gram"])
            np.add.at(g["word"], words.word_row[used], dx)
            np.add.at(g["gram"], words.gram_row[gram], (dx / count)[gram_of])
            step += 1
            for k, v in w.items():
                m, s = moment[k]
                m += 0.1 * (g[k] - m)
                s += 0.01 * (g[k] ** 2 - s)
                v -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-7)
    return w


def _train(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The weights, a row each. Rows come in the order in which they are drawn; texts beyond `most` bytes in all are left out."""
    texts, toxic, total = [], [], 0
    for batch in batches:
        for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
            size = len(text.as_buffer() or b"")
            if total + size <= most:
                total += size
                texts.append(text.as_py())
                toxic.append(label)
    w = train(texts, toxic)
    columns = [pa.array(list(w)), pa.array([list(v.shape) for v in w.values()], pa.list_(pa.int32())), pa.array([v.astype(np.float32).tobytes() for v in w.values()])]
    yield pa.record_batch(columns, ["name", "shape", "data"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, per_label: int = TRAIN_ROWS, most: int = TRAIN_BYTES) -> dict[str, np.ndarray]:
    """Draw the sample by a hash of the id and train in one task; only the weights come to the driver.

    The sample is bounded by `per_label` ids of either label, each with the least of its texts, and by `most` bytes.
    """
    known = labels.where(~held_out(id_col)).where(F.col("toxic").isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("toxic") == 1, per_label / max(sizes.get(1, 0), 1)).otherwise(per_label / max(sizes.get(0, 0), 1))
    drawn = known.where(F.pmod(F.xxhash64("id", F.lit("toxicity")), F.lit(1_000_000)) < share * 1_000_000)
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(drawn), "id").groupBy("id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    rows = rows.withColumn("turn", F.xxhash64("id")).repartition(1).sortWithinPartitions("turn", "id").select("text", "toxic")
    weights = rows.mapInArrow(partial(_train, most=most), "name string, shape array<int>, data binary").collect()
    if not weights:  # no labelled text
        return train([], [])
    return {r["name"]: np.frombuffer(r["data"], np.float32).reshape(r["shape"]) for r in weights}


def _score(batches: Iterator[pa.RecordBatch], w: dict) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        score = np.zeros(batch.num_rows)
        for lo, _, data, off in chunks(pc.utf8_lower(batch.column(2).cast(pa.large_string())), 1 << 20):
            words = Words(data, off)
            number, size, doc = words.windows()
            if len(doc):
                logit = window_logits(number, size, project(words, w)[1], w)
                first = np.flatnonzero(np.diff(doc, prepend=-1))
                score[lo + doc[first]] = _sigmoid(np.maximum.reduceat(logit, first).astype(float))
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(score)], ["carried", "held_out", "score"])


def scored(docs: DataFrame, labels: DataFrame, carry: Column, id_col: str, text_col: str, per_label: int) -> DataFrame:
    """`(carried, held_out, score)` of each row, in one pass over the texts."""
    w = fit(docs, labels, id_col, text_col, per_label)
    rows = docs.select(carry.alias("carried"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([*rows.schema.fields[:2], T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(partial(_score, w=w), schema)


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    threshold: float = 0.7,
    id_col: str = "doc_id",
    text_col: str = "text",
    per_label: int = TRAIN_ROWS,
) -> DataFrame:
    """Score each whole text for toxicity, learning from the labelled rows that are not held out.

    labels: `(id_col, toxic)`; labels other than 0 and 1 and null ids are
    ignored, of several labels of an id the highest counts. Returns
    `(id_col, held_out, score, predicted)`, one row for each input row. A text
    that is null or has no word scores 0. With no labels every text scores near
    0. A null id is not held out. Repeated rows are each scored; other columns
    are ignored. All overlapping windows of a text are scored, however long.
    """
    out = scored(docs, labels, F.col(id_col), id_col, text_col, per_label)
    return out.select(F.col("carried").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", per_label: int = TRAIN_ROWS) -> DataFrame:
    """The rows, with all their columns, that score below the threshold."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return scored(docs, labels, row, id_col, text_col, per_label).where(F.col("score") < threshold).select("carried.*")
