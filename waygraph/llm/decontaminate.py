"""Benchmark decontamination by template canonicalisation.

Numbers, names and units are replaced by typed placeholders, so that a question
asked again with other values keeps its template. Windows of WINDOW template
tokens are hash-joined between documents and benchmark by their templates, unless
they are mostly placeholders, and by their values, whatever their case. What meets
is put on diagonals (document position minus item position) and cut into the
longest runs of windows with consistent slots: each value of the item stands for
one value in the document, while two values may become the same one.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waygraph.llm.words import U, _Cache, mix, powers
from waygraph.loop import materialise

WINDOW = 8
#: Words of its item that a passage must cover: so many, or the whole of a shorter item.
LEAST = 13
#: Placeholders at most in a window that is looked up by its template; with more of them, by its values alone.
SLOTS = 4
#: Bytes of texts, about, that are cut into tokens together.
RUN = 1 << 19
#: Bits of the filter of benchmark windows: 1 MB is broadcast however large the benchmark is.
FILTER_BITS = 1 << 23

#: Scripts without spaces between words, of which each character is a token.
SIGNS = ((0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))
#: Units of measure and money.
UNITS = (
    "mm cm m km in ft yd mi mile miles inch inches foot feet meter meters metre metres kilometer kilometers kilometre kilometres "
    "mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons tonne tonnes "
    "ms s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years "
    "ml cl dl l liter liters litre litres gallon gallons mph kmh kph percent dollar dollars euro euros cent cents usd eur gbp "
    "% ° € $ £"
).split()
OTHER, SPACE, LETTER, SIGN, DIGIT, MONEY, APOSTROPHE, POINT, NEW = range(9)
_chars = _Cache()


def _kind(c: str) -> int:
    if c.isdecimal():
        return DIGIT
    if any(lo <= ord(c) <= hi for lo, hi in SIGNS):
        return SIGN
    if c.isalnum():
        return LETTER
    if c.isspace():
        return OTHER if c == "\n" else SPACE
    return MONEY if c in "%°€$£" else APOSTROPHE if c in "'’" else POINT if c in ".,:/" else OTHER


def _characters(points: np.ndarray) -> dict[str, np.ndarray]:
    """Tables by code point: kind, whether upper case, and the lower-cased character's hash; filled in as characters occur."""
    if "kind" not in _chars:
        _chars.update(kind=np.full(0x110000, NEW, np.uint8), upper=np.zeros(0x110000, bool), hash=np.zeros(0x110000, U))
    kind = _chars["kind"]
    new = np.unique(points[kind[points] == NEW])
    for p in new.tolist():
        kind[p] = _kind(chr(p))
        _chars["upper"][p] = chr(p).isupper()
        _chars["hash"][p] = ord(chr(p).lower()[0]) + 1
    _chars["hash"][new] = mix(_chars["hash"][new] * U(0xD6E8FEB86659FD93))
    return _chars


class Tokens:
    """The template tokens of a run of texts, as flat arrays.

    Tokens are words (inner apostrophes included), numbers (inner points, commas,
    colons and strokes included), signs of money and percent, and characters of SIGNS.
    A number is a slot; so is a unit after a number, and a name: a capitalised word
    that follows another token with only spaces in between. hash has one value for
    all slots of a kind, value the lower-cased token's own.
    """

    def __init__(self, texts: list[str]):
        self.text = "\0".join(texts) + "\0"
        points = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
        table = _characters(points)
        kind = table["kind"][points]
        for mark, side in ((APOSTROPHE, LETTER), (POINT, DIGIT)):
            at = np.flatnonzero(kind[1:-1] == mark) + 1
            kind[at[(kind[at - 1] == side) & (kind[at + 1] == side)]] = side
        runs, single = (kind == LETTER) | (kind == DIGIT), (kind == SIGN) | (kind == MONEY)
        change = kind[1:] != kind[:-1]
        self.start = np.flatnonzero((runs & np.concatenate([[True], change])) | single)
        self.end = np.flatnonzero((runs & np.concatenate([change, [True]])) | single) + 1
        text_end = np.cumsum([len(t) + 1 for t in texts])
        self.first = np.searchsorted(self.start, np.concatenate([[0], text_end]))
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        up, down = powers(len(points) + 1)
        h = np.zeros(len(points) + 1, U)
        np.cumsum(table["hash"][points] * up[: len(points)], out=h[1:])
        self.value = mix((h[self.end] - h[self.start]) * down[self.start])
        number = kind[self.start] == DIGIT
        after = np.flatnonzero(number[:-1] & (self.doc[1:] == self.doc[:-1]) & ~number[1:]) + 1
        unit = np.zeros(len(number), bool)
        unit[after[np.isin(self.value[after], _units())]] = True
        name = table["upper"][points[self.start]] & ~number & ~unit
        name[:1] = False
        at = np.flatnonzero(name)
        solid = np.concatenate([[0], np.cumsum(kind != SPACE)])
        before = self.end[at - 1]
        name[at[(self.doc[at] != self.doc[at - 1]) | (self.start[at] == before) | (solid[self.start[at]] != solid[before])]] = False
        self.slot = number | unit | name
        self.hash = np.where(self.slot, mix(U(1) + number + unit * U(2)), self.value)

    def slots(self, at: int, size: int) -> list[str]:
        """The values of a window's slots, in order; the template says which kinds they are."""
        return [self.text[self.start[k] : self.end[k]].lower() for k in range(at, at + size) if self.slot[k]]


def _units() -> np.ndarray:
    if "units" not in _chars:
        _chars["units"] = np.zeros(0, U)  # while the units themselves become tokens
        _chars["units"] = np.unique(Tokens(UNITS).value)
    return _chars["units"]


_PLACE = mix(np.arange(1, WINDOW + 1, dtype=U)) | U(1)
_RAW, _SHORT = U(0x9E3779B97F4A7C15), U(0xD1B54A32D192ED03)


def _sums(h: np.ndarray, length: int) -> np.ndarray:
    n = max(0, len(h) - length + 1)
    out = np.zeros(n, U)
    for k in range(length):
        out += h[k : k + n] * _PLACE[k]
    return out


def windows(t: Tokens) -> Iterator[tuple[np.ndarray, np.ndarray, int, bool]]:
    """(first tokens, hashes, size, whether of the values) of the windows; a text of fewer tokens is one window as a whole.

    Each window is there by its values, and by its template if that has a slot and
    SLOTS of them at most (half of a shorter text).
    """
    many = np.diff(t.first)
    for size in range(1, WINDOW + 1):
        if size < WINDOW:
            at = t.first[:-1][many == size]
        else:
            at = np.arange(max(0, len(t.doc) - WINDOW + 1))
            at = at[t.doc[at] == t.doc[at + WINDOW - 1]] if len(at) else at
        if not len(at):
            continue
        slots = np.concatenate([[0], np.cumsum(t.slot)])
        slots = slots[at + size] - slots[at]
        yield at, mix(_sums(t.value, size)[at] + _RAW + U(size)), size, True
        some = (slots > 0) & (slots <= min(SLOTS, size // 2))
        yield at[some], mix(_sums(t.hash, size)[at[some]] + U(size)), size, False


def runs_of(t: Tokens, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First tokens and hashes of the values of each run of `length` tokens, for items of that length."""
    at = np.arange(max(0, len(t.doc) - length + 1))
    at = at[t.doc[at] == t.doc[at + length - 1]] if len(at) else at
    return at, mix(_sums(t.value, length)[at] + _SHORT + U(length))


def _place(h: np.ndarray) -> np.ndarray:
    return (mix(h ^ U(0xB10C)) & U(FILTER_BITS - 1)).astype(np.int64)


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[dict] = []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            t = Tokens([text or ""])
            found = list(windows(t))
            if 0 < len(t.doc) < WINDOW:
                found.append((*runs_of(t, len(t.doc)), len(t.doc), True))
            for at, h, size, _ in found:
                for k, key in zip(at.tolist(), h.view(np.int64).tolist()):
                    out.append({"window": key, "item": item, "at": k, "size": len(t.doc), "slots": t.slots(k, size)})
        yield pa.RecordBatch.from_pylist(out, _ITEM)


_ITEM = pa.schema([("window", pa.int64()), ("item", pa.int64()), ("at", pa.int32()), ("size", pa.int32()), ("slots", pa.list_(pa.string()))])
_DOC = pa.schema([("uid", pa.int64()), ("window", pa.int64()), ("pos", pa.int32()), ("size", pa.int32()), ("verbatim", pa.bool_()), ("slots", pa.list_(pa.string()))])


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        p = np.unique(_place(batch.column(0).to_numpy().view(U)))
        yield pa.record_batch([pa.array(p >> 6), pa.array(np.left_shift(np.uint64(1), (p & 63).astype(U)).view(np.int64))], ["word", "bit"])


def _documents(batches: Iterator[pa.RecordBatch], bits: np.ndarray, short: list[int]) -> Iterator[pa.RecordBatch]:
    """Windows of whole documents that may occur in the benchmark. short: the sizes of its templates below one window."""
    for batch in batches:
        uid, texts = batch.column(0).to_numpy(), batch.column(1)
        size = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
        lo = 0
        while lo < len(uid):
            hi = lo + max(1, int(np.searchsorted(np.cumsum(size[lo:]), RUN, "right")))
            t = Tokens(texts.slice(lo, hi - lo).fill_null("").to_pylist())
            own, n = uid[lo:hi], np.diff(t.first)
            out: list[dict] = []
            for at, h, length, verbatim, whole in [*((*w, True) for w in windows(t)), *((*runs_of(t, k), k, True, False) for k in short)]:
                p = _place(h)
                for i in np.flatnonzero((bits[p >> 6] >> (p & 63).astype(U)) & U(1)):
                    k = int(at[i])
                    d = t.doc[k]
                    out.append({
                        "uid": own[d], "window": int(h[i : i + 1].view(np.int64)[0]), "pos": k - int(t.first[d]), "size": int(n[d]) if whole else length,
                        "verbatim": verbatim, "slots": [] if verbatim else t.slots(k, length),
                    })
            yield pa.RecordBatch.from_pylist(out, _DOC)
            lo = hi


def longest_run(windows: list[tuple[int, list[str], list[str]]]) -> int:
    """Tokens that the longest run of a diagonal's windows (at, values of the item, values of the document) covers.

    In a run each value of the item stands for one value of the document. A
    window covers what the one before it does not reach.
    """
    windows = sorted(windows)
    stands: dict[str, Counter] = defaultdict(Counter)
    best = left = twice = cover = 0
    for k, (at, its, mine) in enumerate(windows):
        cover += min(WINDOW, at - windows[k - 1][0]) if k > left else WINDOW
        for x, y in zip(its, mine):
            twice += y not in stands[x] and len(stands[x]) > 0
            stands[x][y] += 1
        while twice:
            for x, y in zip(*windows[left][1:]):
                stands[x][y] -= 1
                if not stands[x][y]:
                    del stands[x][y]
                    twice -= len(stands[x]) > 0
            left += 1
            cover -= min(WINDOW, windows[left][0] - windows[left - 1][0]) if left <= k else cover
        best = max(best, cover)
    return best


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        covered = [min(size, longest_run([(w["at"], w["its"], w["mine"]) for w in of])) for size, of in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array(covered, pa.int32())], ["uid", "item", "size", "covered"])


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    least: int = LEAST,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Which benchmark items each whole text holds, verbatim or with other numbers, names and units.

    Returns `(id_col, uid, contaminated, n_items, item_ids, covered)`, one row for
    each input row: item_ids ascending, covered the longest passage in tokens. A
    passage is a run of meeting windows on one diagonal that covers `least` of the
    item's template tokens, or all of a shorter item, with consistent slots.
    Templates below WINDOW tokens match a document with the same template, and
    any document that holds their words and values verbatim.
    Null and empty texts and items match nothing, null item ids are ignored, null
    ids are kept, repeated rows are each reported, other columns are ignored. The
    benchmark may be of any size: its windows are joined by hash, after a filter
    of fixed size.
    """
    items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long"), F.col(item_text_col).cast("string"))
    items = materialise(items.distinct().mapInArrow(_items, "window long, item long, at int, size int, slots array<string>"), "items")
    bits = np.zeros(FILTER_BITS >> 6, U)
    for r in items.select("window").mapInArrow(_bits, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bit")).toLocalIterator():
        bits[r["word"]] = np.array([r["bit"]], np.int64).view(U)[0]  # FILTER_BITS / 64 rows at most
    short = sorted(r["size"] for r in items.where(f"size < {WINDOW}").select("size").distinct().collect())  # WINDOW - 1 rows at most
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("id", F.xxhash64("id", "text").alias("uid"), "text")
    found = rows.select("uid", "text").mapInArrow(partial(_documents, bits=bits, short=short), "uid long, window long, pos int, size int, verbatim boolean, slots array<string>")
    met = (
        found.distinct()
        .withColumnRenamed("size", "doc_size")
        .join(items, "window")
        .where(f"size >= {WINDOW} OR doc_size = size")
        .select("uid", "item", (F.col("pos") - F.col("at")).alias("diagonal"), "at", "size", items["slots"].alias("its"), F.when(F.col("verbatim"), items["slots"]).otherwise(found["slots"]).alias("mine"))
    )
    # a diagonal of one document and item holds no more rows than the item has windows
    runs = met.groupBy("uid", "item", "diagonal").agg(F.max("size").alias("size"), F.collect_set(F.struct("at", "its", "mine")).alias("windows"))
    passages = runs.select("uid", "item", "size", "windows").mapInArrow(_runs, "uid long, item long, size int, covered int")
    passages = passages.where(F.col("covered") >= F.least(F.lit(least), F.col("size")))
    by_doc = passages.groupBy("uid").agg(F.sort_array(F.collect_set("item")).alias("item_ids"), F.max("covered").alias("covered"))
    return rows.select("id", "uid").join(by_doc, "uid", "left").select(
        F.col("id").alias(id_col),
        "uid",
        F.col("item_ids").isNotNull().alias("contaminated"),
        F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("item_ids", F.expr("CAST(array() AS array<bigint>)")).alias("item_ids"),
        F.coalesce("covered", F.lit(0)).cast("long").alias("covered"),
    )
