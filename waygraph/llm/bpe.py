"""Byte-level BPE encoding by a queue of merge ranks, and decoding.

The symbols of a block of pre-tokens are one linked list of byte positions,
with a separator between pre-tokens that no token holds. Each merge rank has a
bucket, a heap of the positions where a pair of that rank was seen, and a bitmap
of two levels marks the buckets that hold any: finding the first set bit of each
level gives the least rank, whatever the number of ranks. A merge links two
symbols and files the one or two new pairs; entries whose pair has changed
since are stale and skipped when they come up. So a pre-token of n bytes takes
n - 1 merges at most and each a bounded number of steps plus a heap's within
the bucket, where looking over all pairs for each merge takes n steps a merge.
Pre-tokens of a block share the queue, so that a rank is picked once for all.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import partial
from heapq import heappop, heappush
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct pre-tokens whose ids a worker remembers (the last so many, and as many before them), and the longest of them in characters.
REMEMBERED, SHORT = 250_000, 48
#: Rows that are turned into Python objects at once.
ROWS = 500
#: Characters of the texts that are split and merged at once, and the pre-tokens of a longer text; small enough for a processor's cache.
BLOCK, PIECES = 1 << 16, 16_384
#: Buckets that share a word of the lower bitmap: 2 to this power. The upper bitmap has a bit for each word.
WORD = 8
#: Stands between pre-tokens; no byte of UTF-8.
SEPARATOR = 0xFF


def read_ranks(vocabulary: str) -> dict[bytes, int]:
    """Token to rank; vocabulary is the name of a rank file among the public tokenizers, or a path."""
    if "/" not in vocabulary:
        import public_tokenizers

        vocabulary = public_tokenizers.path(vocabulary)
    with open(vocabulary, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Encoder:
    """Ids of texts under one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        self.pattern = regex.compile(pattern)
        self.ranks = {t: r for t, r in ranks.items() if len(t) == 1 or SEPARATOR not in t}  # others are in no text
        self.single = np.array([ranks[bytes([b])] for b in range(256)])
        self.two = np.full(1 << 16, -1)
        for token, rank in self.ranks.items():
            if len(token) == 2:
                self.two[token[0] << 8 | token[1]] = rank
        most = max(ranks.values()) + 1
        self.buckets: list[list[int]] = [[] for _ in range(most)]  # positions by rank; empty between calls
        self.low = [0] * ((most >> WORD) + 1)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The packed ids of each pre-token: its pair of least rank is merged, the first of several, until there is none."""
        rank_of, buckets, low, top, inside = self.ranks.get, self.buckets, self.low, 0, (1 << WORD) - 1
        gap = bytes([SEPARATOR])
        text = gap + gap.join(pieces) + gap + gap
        data = np.frombuffer(text, np.uint8)
        first = self.two[data[:-1].astype(np.int64) << 8 | data[1:]]
        pair = [*first.tolist(), -1]  # rank of the symbol here and the next, -1 if none
        ids = self.single[data].tolist()  # of the symbol that starts here
        after, before = list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
        some = np.flatnonzero(first >= 0)
        some = some[np.argsort(first[some], kind="stable")]
        used, begin = np.unique(first[some], return_index=True)
        for rank, a, b in zip(used.tolist(), begin.tolist(), [*begin[1:].tolist(), len(some)]):
            buckets[rank] = some[a:b].tolist()  # in order, so a heap
            low[rank >> WORD] |= 1 << (rank & inside)
            top |= 1 << (rank >> WORD)
        while top:
            word = (top & -top).bit_length() - 1
            bits = low[word]
            rank = (word << WORD) + (bits & -bits).bit_length() - 1
            bucket = buckets[rank]
            least = rank
            while bucket and least == rank:  # a new pair may have a lower rank
                at = heappop(bucket)
                if pair[at] != rank:
                    continue  # stale
                gone, left = after[at], before[at]
                end = after[at] = after[gone]
                before[end] = at
                ids[at], ids[gone], pair[gone] = rank, -1, -1
                pair[at] = right = rank_of(text[at : after[end]], -1)
                pair[left] = new = rank_of(text[left:end], -1)
                while True:
                    if new >= 0:
                        if least > new:
                            least = new
                        onto = buckets[new]
                        if onto:
                            heappush(onto, left)
                        else:
                            onto.append(left)
                            low[new >> WORD] |= 1 << (new & inside)
                            top |= 1 << (new >> WORD)
                    if left == at:
                        break
                    new, left = right, at
            if not bucket:
                low[word] = bits = low[word] & ~(1 << (rank & inside))
                if not bits:
                    top &= ~(1 << word)
        left = np.array(ids, np.int32)
        ends = np.cumsum([len(p) + 1 for p in pieces])  # each piece's separator
        left[0], left[ends], left[-1] = -1, -1, -1
        heads = np.concatenate([[0], np.cumsum(left >= 0)])[np.concatenate([[0], ends])].tolist()
        flat = left[left >= 0].astype("<u4").tobytes()
        return [flat[4 * a : 4 * b] for a, b in zip(heads, heads[1:])]

    def lookup(self, pres: list[str]) -> dict[str, bytes]:
        """A table that holds these pre-tokens: whole tokens by the vocabulary, known ones from memory, the others merged together."""
        fresh = set(pres)
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known, self.older = {}, self.known
        known, older, ranks = self.known, self.older, self.ranks
        found, rest = {}, []
        for pre in fresh:
            if pre not in known:
                ids = older.get(pre)
                if ids is None:
                    piece = pre.encode()
                    if piece in ranks:
                        ids = ranks[piece].to_bytes(4, "little")
                    else:
                        rest.append((pre, piece))
                        continue
                found[pre] = ids
        if rest:
            found |= zip([pre for pre, _ in rest], self.merge([piece for _, piece in rest]))
        known |= found
        if long := [p for p in found if len(p) > SHORT]:
            whole = dict(known)
            for p in long:
                del known[p]
            return whole
        return known

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The packed ids of each text: unsigned 32-bit integers, the low byte first."""
        lo = 0
        while lo < len(texts):
            hi, size = lo + 1, len(texts[lo])
            while hi < len(texts) and size + len(texts[hi]) <= BLOCK:
                size += len(texts[hi])
                hi += 1
            if size > BLOCK:  # one long text, by parts
                found, ids = (m[0] for m in self.pattern.finditer(texts[lo])), bytearray()
                while pres := list(islice(found, PIECES)):
                    ids += b"".join(map(self.lookup(pres).__getitem__, pres))
                yield bytes(ids)
            else:
                split = [self.pattern.findall(t) for t in texts[lo:hi]]
                table = self.lookup(list(chain.from_iterable(split)))
                for pres in split:
                    yield b"".join(map(table.__getitem__, pres))
            lo = hi


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            yield batch.slice(k, ROWS)


def _encode(batches: Iterator[pa.RecordBatch], vocabulary: str, pattern: str) -> Iterator[pa.RecordBatch]:
    encoder = Encoder(read_ranks(vocabulary), pattern)
    for batch in _slices(batches):
        ids = pa.array(encoder.encode([text.as_py() or "" for text in batch.column(1)]), pa.binary())
        counts = pc.cast(pc.divide(pc.binary_length(ids), 4), pa.int64())
        yield pa.record_batch([batch.column(0), counts, ids], ["id", "n_tokens", "ids"])


def _decode(batches: Iterator[pa.RecordBatch], vocabulary: str) -> Iterator[pa.RecordBatch]:
    tokens = {rank: token for token, rank in read_ranks(vocabulary).items()}
    for batch in _slices(batches):
        texts = [b"".join(map(tokens.__getitem__, np.frombuffer(x.as_py() or b"", "<u4").tolist())) for x in batch.column(0)]
        yield pa.record_batch([*batch.columns[1:], pa.array(texts, pa.binary())], [*batch.schema.names[1:], "decoded"])


def bpe_encode(docs: DataFrame, vocabulary: str, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of each whole text, as the tiktoken library gives them for these ranks without special tokens.

    pattern splits texts into pre-tokens (the public tokenizers' by default);
    each is encoded by itself. Returns `(id_col, n_tokens, ids)`, one row for
    each input row in no order; ids are packed as little-endian unsigned 32-bit
    integers. Null and empty texts have no ids; null ids stay null; repeated
    rows are encoded each; other columns are ignored, whatever their names. No
    text or pre-token is cut, however long.
    """
    if pattern is None:
        from public_tokenizers import PATTERN as pattern
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(partial(_encode, vocabulary=vocabulary, pattern=pattern), f"id {kind}, n_tokens long, ids binary")
    return out.select(F.col("id").alias(id_col), "n_tokens", "ids")


def bpe_decode(encoded: DataFrame, vocabulary: str, ids_col: str = "ids") -> DataFrame:
    """The rows with `decoded`, the bytes of the packed ids, in place of a column of that name; null ids decode to nothing.

    An id that the vocabulary lacks is an error. The columns' names must differ.
    """
    keep = [c for c in encoded.columns if c != "decoded"]
    rows = encoded.select(F.col(f"`{ids_col}`").alias("_packed"), *[F.col(f"`{c}`") for c in keep])
    schema = rows.drop("_packed").schema.add("decoded", "binary")
    return rows.mapInArrow(partial(_decode, vocabulary=vocabulary), schema)
