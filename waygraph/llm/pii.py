"""Personal data: patterns, and terms that the corpus shows to reveal them.

Base entities (e-mail, ip, card, phone) are found by pattern in every text. A
term of a text with an entity discloses it in so far as seeing the term makes the entity
likelier: with document counts c, the pointwise mutual information
log2(c(t, e) N / (c(t) c(e))) over the entity's own information log2(N / c(e)) is
the share of the entity that the term gives away. Terms whose share reaches the
disclosure threshold, with enough documents behind them, become spans too, at
all their places in all texts, to be generalised to a placeholder like the
entities themselves.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waygraph.llm.toxicity import word_spans
from waygraph.llm.words import LOWER_TABLE, U, chunks, mix, word_hashes
from waygraph.loop import materialise

KINDS = ("email", "ip", "card", "phone", "term")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DISCLOSURE, SUPPORT = 0.8, 3
#: Bits of the filter of candidate terms: what is broadcast is 512 kB, however many terms there are.
FILTER_BITS = 1 << 22


def emails(t: str) -> Iterator[tuple[int, int]]:
    """Each @ is tried with all local characters before it: that is the leftmost match, without trying every start."""
    end, at = 0, t.find("@")
    while at >= 0:
        start = at
        while start > end and t[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(t, at + 1)):
            end = m.end()
            yield start, end
        at = t.find("@", max(at + 1, end))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def base_spans(t: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base entities, by start and kind."""
    found = [(s, 0, e) for s, e in emails(t)]
    for m in IP.finditer(t):
        if all(map(_small, m[0].split("."))):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(t):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in t:
        for m in PHONE.finditer(t):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def _name(kind: int, value: str) -> int:
    raw = hashlib.blake2b(f"{kind}:{value.lower()}".encode(), digest_size=8).digest()
    return int.from_bytes(raw, "little", signed=True)


def own_terms(t: str, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """Hashes of the text's terms; places that touch an entity don't count."""
    raw = np.frombuffer(t.encode("utf-8", "replace"), np.uint8)
    a, b, _ = word_spans(raw, np.array([0, len(raw)]))
    point = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # code points before each byte
    free = np.ones(len(a), bool)
    for s, _, e in spans:
        free[np.searchsorted(point[b], s, "right") : np.searchsorted(point[a], e, "left")] = False
    return np.unique(word_hashes(raw, a[free], b[free]).view(np.int64))


_SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans, entities, digest = [], [], []
        for text in batch.column(2):
            t = text.as_py() or ""
            s = base_spans(t)
            spans.append([{"start": a, "kind": k, "end": e} for a, k, e in s])
            entities.append(list({_name(k, t[a:e]) for a, k, e in s}))
            digest.append(hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{e}" for a, k, e in s).encode()).hexdigest())
        yield pa.record_batch(
            [batch.column(0), batch.column(1), pa.array(digest), pa.array(spans, pa.list_(_SPAN)), pa.array(entities, pa.list_(pa.int64()))],
            ["id", "uid", "base_sha256", "base", "entities"],
        )


def _filter_place(h: np.ndarray) -> np.ndarray:
    return (mix(h.view(U) ^ U(0x7E57)) & U(FILTER_BITS - 1)).astype(np.int64)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        p = np.unique(_filter_place(batch.column(0).to_numpy()))
        yield pa.record_batch([pa.array(p >> 6), pa.array(np.left_shift(np.uint64(1), (p & 63).astype(U)).view(np.int64))], ["word", "bit"])


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts of the batch each term occurs."""
    for batch in batches:
        found = []
        for _, _, data, off in chunks(batch.column(0)):
            a, b, first = word_spans(data, off)
            h = word_hashes(data, a, b, LOWER_TABLE).view(np.int64)
            doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
            order = np.lexsort((doc, h))
            h, doc = h[order], doc[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            found.append(h[new])
        h, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64),) * 2
        yield pa.record_batch([pa.array(h), pa.array(n.astype(np.int64))], ["term", "n"])


def _hits(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    p = _filter_place(h)
    return ((bits[p >> 6] >> (p & 63).astype(U)) & U(1)).astype(bool)


def _beside(batches: Iterator[pa.RecordBatch], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The terms in the filter of each text that has entities."""
    for batch in batches:
        uids, terms = [], []
        for uid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if text and (spans := base_spans(text)):
                h = own_terms(text, spans)
                terms.append(h[_hits(h, bits)])
                uids.append(np.full(len(terms[-1]), uid, np.int64))
        none = [np.zeros(0, np.int64)]
        yield pa.record_batch([pa.array(np.concatenate(uids or none)), pa.array(np.concatenate(terms or none))], ["uid", "term"])


def _marks(batches: Iterator[pa.RecordBatch], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """All places of the terms in the filter, in code points."""
    for batch in batches:
        uid = batch.column(0).to_numpy()
        for lo, _, data, off in chunks(batch.column(1)):
            a, b, first = word_spans(data, off)
            h = word_hashes(data, a, b, LOWER_TABLE).view(np.int64)
            doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
            hit = _hits(h, bits)
            a, b, h, doc = a[hit], b[hit], h[hit], doc[hit]
            point = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            places = [(point[x] - point[off[doc]]).astype(np.int32) for x in (a, b)]
            yield pa.record_batch([pa.array(uid[lo + doc]), pa.array(h), *map(pa.array, places)], ["uid", "term", "start", "end"])


def _filter(terms: DataFrame) -> np.ndarray:
    bits = np.zeros(FILTER_BITS >> 6, U)
    words = terms.select("term").mapInArrow(_places, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bit"))
    for r in words.toLocalIterator():  # at most FILTER_BITS / 64 rows
        bits[r["word"]] = np.array([r["bit"]], np.int64).view(U)[0]
    return bits


def personal_data(
    docs: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Spans of personal data in each whole text.

    Returns `(id_col, uid, found, base_sha256)`, one row for each input row:
    `found` has (start, kind, end) in code points by start and kind, kind being a
    place in KINDS. Base spans come from the patterns, `term` spans from the
    corpus: all places, but those inside an entity, of a term that stands in at
    least `support` documents with an entity and discloses it to `disclosure` or
    more; also in documents without that entity, which it still reveals. Null
    and empty texts have none; null ids are kept; repeated rows have the same
    spans each and count once in the statistics; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("id", F.xxhash64("id", "text").alias("uid"), "text")
    kind = rows.schema["id"].dataType.simpleString()
    found = materialise(
        rows.mapInArrow(
            _find,
            f"id {kind}, uid long, base_sha256 string, base array<struct<start:int,kind:int,end:int>>, "
            "entities array<long>",
        ),
        "pii",
    )
    many = found.agg(F.count_distinct("uid").alias("n")).first()["n"]
    holds = found.select("uid", F.explode("entities").alias("entity")).distinct()
    of_entity = materialise(holds.groupBy("entity").agg(F.count("*").alias("of_entity")).where((F.col("of_entity") >= support) & (F.col("of_entity") < many)), "entities")
    share = lambda both, ce: F.log2(both * many / (F.greatest("of_term", both) * ce)) / F.log2(many / ce)
    most = F.lit(of_entity.agg(F.max("of_entity").alias("m")).first()["m"] or 0)
    # a term in too many texts discloses no entity, even if it stands in all of the entity's
    terms = rows.select("text").mapInArrow(_document_counts, "term long, n long").groupBy("term").agg(F.sum("n").alias("of_term"))
    terms = terms.where((F.col("of_term") >= support) & (most > 0))
    terms = materialise(terms.where((F.col("of_term") <= most) | (share(most, F.greatest(most, F.lit(1))) >= disclosure)), "terms")
    beside = rows.select("uid", "text").mapInArrow(partial(_beside, bits=_filter(terms)), "uid long, term long")
    pairs = beside.distinct().join(terms, "term").join(holds.join(of_entity, "entity"), "uid")
    pairs = pairs.where(share(F.least("of_term", "of_entity"), F.col("of_entity")) >= disclosure)
    told = pairs.groupBy("entity", "term").agg(F.count("*").alias("both"), F.first("of_term").alias("of_term"), F.first("of_entity").alias("of_entity"))
    told = told.where((F.col("both") >= support) & (share(F.col("both"), F.col("of_entity")) >= disclosure))
    told = materialise(told.select("term").distinct(), "told")
    marks = rows.select("uid", "text").mapInArrow(partial(_marks, bits=_filter(told)), "uid long, term long, start int, end int")
    more = marks.join(told, "term").groupBy("uid").agg(F.collect_set(F.struct("start", F.lit(4).alias("kind"), "end")).alias("terms"))  # of one text
    outside = F.filter("terms", lambda t: ~F.exists("base", lambda b: (t["start"] < b["end"]) & (t["end"] > b["start"])))
    both = found.join(more, "uid", "left")
    return both.select(
        F.col("id").alias(id_col),
        "uid",
        F.array_sort(F.concat("base", F.coalesce(outside, F.expr("CAST(array() AS array<struct<start:int,kind:int,end:int>>)")))).alias("found"),
        "base_sha256",
    )


def span_digest(spans: DataFrame) -> DataFrame:
    """Counts by kind and the spans as text, in place of `found`."""
    names = F.array(*map(F.lit, KINDS))
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    text = F.array_join(F.transform("found", lambda x: F.concat_ws(":", names[x["kind"]], x["start"], x["end"])), ",")
    return spans.select(*[c for c in spans.columns if c not in ("uid", "found", "base_sha256")], *map(count, range(5)), "base_sha256", text.alias("spans"))


def _redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if text is not None:
                at, parts = 0, []
                for x in spans:
                    if x["start"] >= at:
                        parts += [text[at : x["start"]], f"<{KINDS[x['kind']].upper()}>"]
                    at = max(at, x["end"])
                text = "".join([*parts, text[at:]])
            out.append(text)
        yield pa.record_batch([batch.column(0), pa.array(out, pa.string())], ["id", "text"])


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """The texts with every span replaced by its kind's placeholder: `(id_col, text_col)`; null texts stay null."""
    spans = personal_data(docs, id_col=id_col, text_col=text_col, **limits).select("uid", "found").dropDuplicates(["uid"])
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("uid", F.xxhash64("id", "text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.join(spans, "uid").select("id", "text", "found").mapInArrow(_redact, f"id {kind}, text string")
    return out.toDF(id_col, text_col)
