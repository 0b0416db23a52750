"""Resampling, byte-level BPE and clustering against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from waygraph.llm import bpe, clustering, resampling

SCHEMA = "doc_id long, text string, key string, part long, id string, own long, rank int, cluster int, x string"
rng = random.Random(11)
VOCAB = ["".join(rng.choice("abcdefgéñ你XY7") for _ in range(rng.randint(1, 9))) for _ in range(300)]


def prose(n):
    return "".join(rng.choice(VOCAB) + rng.choice([" ", " ", ", ", "\n", "--"]) for _ in range(n))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "k", 1, "i", 2, 3, 4, "x") for i, t in rows], SCHEMA).repartition(3)


def corpus():
    out = [(i, prose(rng.randint(0, 90))) for i in range(80)]
    long = [(200, prose(400)), (201, "z" * 3000 + " end"), (202, "é" * 500)]
    return out + long + [(200, long[0][1]), (300, None), (301, ""), (302, " -- "), (None, out[3][1]), (None, out[3][1]), (5, out[5][1]), (5, "other text " * 15)]


# ---- 11


def words(text):
    return [w.decode() for w in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(b"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))]


def features(text, n):
    w = words(text)
    return [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


@pytest.mark.parametrize("n", [1, 3])
def test_resampling(spark, monkeypatch, n):
    monkeypatch.setattr(resampling, "CHUNK", 200)  # most texts are cut, into many chunks
    rows, target, buckets = corpus(), [(0, prose(200)), (1, None), (2, prose(30))], 97
    counts = [Counter(zlib.crc32(f.encode()) % buckets for _, t in table for f in features(t, n)) for table in (rows, target)]
    s, t = counts
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + buckets) / ((s[b] + 1) * (sum(t.values()) + buckets)))) for b in range(buckets)]
    want, can = [], []
    for i, text in rows:
        f = features(text, n)
        weight = sum(gain[zlib.crc32(x.encode()) % buckets] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"9:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        want.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))])
        can.append(len(words(text)) >= 20)
    order = sorted((k for k in range(len(rows)) if can[k]), key=lambda k: (-want[k][3], want[k][0] is None, want[k][0] or 0))
    rank = {k: r + 1 for r, k in enumerate(order[: 40 * len(order) // 100])}
    want = [(*row, rank.get(k)) for k, row in enumerate(want)]
    bench = spark.createDataFrame(target, "item_id long, text string")
    got = resampling.resample(docs(spark, rows), bench, n=n, buckets=buckets, percent=40, least_words=20, seed=9)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    # rows with one id and one score may take each other's rank
    assert sorted((tuple(r)[:4] for r in got.collect()), key=key) == sorted((r[:4] for r in want), key=key)
    assert sorted((r["rank"], r["doc_id"], r["score"]) for r in got.collect() if r["rank"]) == sorted((r[4], r[0], r[3]) for r in want if r[4])


def test_resampling_hot_words_and_crc(spark):
    data = np.frombuffer(("a" * 70 + "bc" + "é").encode(), np.uint8)
    starts, ends = np.array([0, 70, 72, 3, 70]), np.array([70, 72, 74, 3, 74])
    assert resampling.crc32(data, starts, ends).tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends)]
    rows = [(i, "the the the " * 30) for i in range(40)]
    none = spark.createDataFrame([], "item_id long, text string")
    got = resampling.resample(docs(spark, rows), none, percent=100).collect()
    assert {r["n_features"] for r in got} == {90} and sorted(r["rank"] for r in got) == list(range(1, 41))
    assert not resampling.resample(docs(spark, rows[:0]), none).collect()
    assert {r["rank"] for r in resampling.resample(docs(spark, rows[:9]), none).collect()} == {None}  # floor(0.9)


# ---- 12


def library():
    import public_tokenizers
    import tiktoken

    ranks = bpe.read_ranks("byte_bpe_50k.tiktoken")
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    signs = ["  two  spaces ", "it's we'll DON'T", "\t\n\r\n  x", "<|endoftext|> in a text", "1234567 89", "\x00\x01", "ﬀ ﷽ 👩‍👩‍👧 ​", "你好世界" * 50]
    runs = ["a" * 5000, "ab" * 3000, "".join(rng.choice("ab") for _ in range(20_000)), "=" * 777, " " * 300 + "x", "é" * 2000]
    return signs + runs


def test_bpe_like_the_library(spark):
    lib = library()
    rows = corpus() + [(400 + i, t) for i, t in enumerate(odd_texts())]
    encoded = bpe.bpe_encode(docs(spark, rows), "byte_bpe_50k.tiktoken")
    both = bpe.bpe_decode(encoded, "byte_bpe_50k.tiktoken")
    assert both.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    want = []
    for i, t in rows:
        ids = np.array(lib.encode_ordinary(t or ""), "<u4")
        want.append((str(i), len(ids), ids.tobytes(), (t or "").encode()))
    assert sorted((str(r[0]), r[1], bytes(r[2]), bytes(r[3])) for r in both.collect()) == sorted(want)
    assert not bpe.bpe_encode(docs(spark, []), "byte_bpe_50k.tiktoken").collect()


def test_bpe_merges_like_looking_at_all_pairs():
    ranks = {bytes([b]): b for b in range(256)}
    pick = random.Random(3)
    for k in range(400):  # a made-up vocabulary over few letters: many ties and stale entries
        tokens = [x for x in ranks if set(x) <= set(b"abc")]
        ranks.setdefault(pick.choice(tokens) + pick.choice(tokens), 256 + k)
    ranks = {t: r for r, t in enumerate(ranks)}
    encoder = bpe.Encoder(ranks, r"\S+")
    pieces = ["".join(pick.choice("abc") for _ in range(pick.randint(1, 60))).encode() for _ in range(300)]
    want = []
    for piece in pieces:
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best = min((ranks.get(a + b, 10**9), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best[0] == 10**9:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        want.append(np.array([ranks[p] for p in parts], "<u4").tobytes())
    assert encoder.merge(pieces) == want and [x for p in pieces for x in encoder.merge([p])] == want
    assert not any(encoder.buckets) and not any(encoder.low)
    with pytest.raises(ValueError):
        bpe.Encoder({b"a": 0}, r"\S+")


def test_bpe_decodes_any_ids(spark):
    rows = spark.createDataFrame([(1, bytearray(np.array([0, 50255, 300], "<u4").tobytes()), "kept"), (2, None, "kept")], "doc_id long, ids binary, decoded string")
    ranks = {r: t for t, r in bpe.read_ranks("byte_bpe_50k.tiktoken").items()}
    got = {r["doc_id"]: bytes(r["decoded"]) for r in bpe.bpe_decode(rows, "byte_bpe_50k.tiktoken").collect()}
    assert got == {1: ranks[0] + ranks[50255] + ranks[300], 2: b""}


# ---- 13


def lloyd(rows, k, rounds, dim, scale, seed):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    packed = lambda v: np.array(v, "<i4").tobytes()
    cents = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), packed(r[1])))[:k]]
    for turn in range(rounds + 1):
        near = [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents)) for _, v in kept]
        if turn < rounds:
            for j in range(len(cents)):
                mine = [v for (_, v), (_, c) in zip(kept, near) if c == j]
                if mine:
                    cents[j] = [sum(x) // len(mine) for x in zip(*mine)]
    inertia = [sum(d for d, c in near if c == j) for j in range(len(cents))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return [(i, c, d, inertia[c], sum(inertia), sha[c]) for (i, _), (d, c) in zip(kept, near)]


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "c", "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, id string, x string").repartition(3)


def test_sorted_means(spark):
    pick = np.random.default_rng(5)
    base = pick.normal(0, 1, (6, 4))
    rows = [(i, (base[i % 6] + pick.normal(0, 0.3, 4)).tolist()) for i in range(150)]
    rows += [(200, [0.5] * 4)] * 5 + [(None, [-1.0] * 4), (None, [1.0] * 4), (7, [0.25, -0.25, 0.0, 3.0])]  # ties, repeated ids and rows
    odd = [(300, None), (301, []), (302, [1.0] * 3), (303, [1.0, None, 1.0, 1.0]), (304, [1.0, float("nan"), 0.0, 0.0]), (305, [float("inf")] * 4), (306, [1e30] * 4)]
    got = clustering.sorted_means(vectors(spark, rows + odd), k=9, rounds=3, dim=4, scale=256, seed=2).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, lloyd(rows, 9, 3, 4, 256, 2)))


def test_sorted_means_with_few_or_no_vectors(spark):
    rows = [(i, [float(i % 2)] * 4) for i in range(3)]  # two centroids are alike: the larger number stays empty
    got = clustering.sorted_means(vectors(spark, rows), k=9, rounds=2, dim=4).collect()
    assert sorted(map(tuple, got)) == sorted(lloyd(rows, 9, 2, 4, 256, 2))
    assert not clustering.sorted_means(vectors(spark, []), dim=4).collect()
    assert not clustering.sorted_means(vectors(spark, [(1, None)]), dim=4).collect()


def test_sorted_scan_is_exact_and_stops_early():
    pick = np.random.default_rng(8)
    cents = pick.integers(-50, 50, (30, 6)) * 40
    x = cents[pick.integers(0, 30, 4000)] + pick.integers(-60, 60, (4000, 6))
    before = pick.integers(0, 30, 4000)
    all_d = ((x[:, None] - cents[None]) ** 2).sum(2)
    near, d = clustering.assign(x, before, cents)
    assert (near == all_d.argmin(1)).all() and (d == all_d.min(1)).all()
    # halves and doubles: a centroid at just twice the distance, and equally near, still counts
    line = np.array([[10], [0], [4]])
    assert [a.tolist() for a in clustering.assign(np.array([[5], [2], [7]]), np.array([0, 2, 0]), line)] == [[2, 1, 0], [1, 4, 9]]
