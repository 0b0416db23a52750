"""Token counts with a whole-token shortcut.

No piece of the vocabulary holds a word-start mark after another character, so
merges never cross the gap before a space: a text's count is the sum over its
pre-tokens (spaces and the run of other characters after them). Offline, every
vocabulary string is encoded alone; those that come back as one token are
proven whole tokens, and a pre-token that is one of them counts 1 without any
merging. Only the rest is merged by the library, once for each distinct
pre-token that a worker remembers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Spaces (or their mark) with what follows up to the next; a line feed is no part of any piece, so it ends one too.
PRE_TOKEN = re.compile(f"[ {MARK}]+[^ {MARK}\n]*|[^ {MARK}\n]+|\n")
REMEMBERED = 400_000


def load(model: str):
    """The library's processor; model is the file's name among the public tokenizers, or a path."""
    import sentencepiece

    if "/" not in model:
        import public_tokenizers

        model = public_tokenizers.path(model)
    return sentencepiece.SentencePieceProcessor(model_file=model)


def whole_tokens(model: str) -> tuple:
    """The processor and the proven whole tokens, as pre-tokens in front of which nothing is put."""
    sp = load(model)
    lead = len(sp.encode("\n")) - 1  # the mark that the library puts before a text
    whole = set()
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    for piece in pieces:
        if MARK in piece.lstrip(MARK):
            raise ValueError(f"{piece!r} crosses a word start: pre-tokens are not independent in this vocabulary")
        if "\n" in piece:
            raise ValueError("a piece holds a line feed: pre-tokens are not independent in this vocabulary")
    # "\n" is encoded by itself, so what follows it stands alone
    for piece, ids in zip(pieces, sp.encode(["\n" + p.replace(MARK, " ") for p in pieces])):
        if len(ids) - lead - 1 == 1:
            whole.add(piece.replace(MARK, " "))
    return sp, lead, frozenset(whole)


class _Counts(dict):
    """Pre-token to count; what is no whole token is merged once and remembered."""

    def __init__(self, model: str):
        self.sp, self.lead, whole = whole_tokens(model)
        self.whole = dict.fromkeys(whole, 1) | {"\n": 1}
        super().__init__(self.whole)

    def __missing__(self, pre: str) -> int:
        n = len(self.sp.encode("\n" + pre)) - self.lead - 1
        if len(pre) <= 64:
            if len(self) > REMEMBERED:
                self.clear()
                self.update(self.whole)
            self[pre] = n
        return n


def count(text: str, counts: _Counts) -> int:
    if not text:
        return 0
    # the library puts a mark before a text
    return sum(map(counts.__getitem__, PRE_TOKEN.findall(" " + text)))


def _count(batches: Iterator[pa.RecordBatch], model: str) -> Iterator[pa.RecordBatch]:
    counts = _Counts(model)
    for batch in batches:
        texts = [t.as_py() or "" for t in batch.column(1)]
        n = pa.array([count(t, counts) for t in texts], pa.int64())
        size = pa.array([len(t.encode()) for t in texts], pa.int64())
        yield pa.record_batch([batch.column(0), size, n], ["id", "n_bytes", "n_tokens"])


def token_counts(
    docs: DataFrame, model: str = "piece_bpe_32k.model", limit: int = 4096, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Tokens of each whole text, as the sentencepiece model gives them without added tokens.

    Returns `(id_col, n_bytes, n_tokens, over_limit)`, one row for each input
    row in no order. Null and empty texts have no bytes and no tokens; null ids
    stay null; repeated rows are counted each; other columns are ignored,
    whatever their names. No text is cut, however long.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(partial(_count, model=model), f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
