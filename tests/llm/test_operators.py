"""Each operator against a brute-force version, on small tables with nulls, empty and long texts, copies and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from waygraph.llm import decontaminate, embedding_dedup, language_id, line_dedup, mixing, ngram_join, pii, suffix_dedup, token_count, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n int, uid string, node string, id string"
rng = random.Random(5)
VOCAB = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 9))) for _ in range(400)]


def prose(n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def docs(spark, texts, langs=None, sources=None):
    """A table with columns whose names the operators use inside."""
    rows = [(i, t, (langs or {}).get(i), (sources or {}).get(i), 1, "u", "n", "i") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def edge_cases():
    return [(900, None), (901, ""), (902, " \n\t "), (903, "one"), (904, "one"), (905, "two words"), (906, prose(3000)), (907, "é" * 300)]


def corpus():
    out = [(i, prose(rng.randint(1, 90))) for i in range(60)]
    for i in range(60, 100):
        words = out[i - 60][1].split()
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = rng.choice(VOCAB)
        out.append((i, " ".join(words)))
    return out + edge_cases() + [(5, out[5][1]), (None, out[6][1]), (None, None)]


def components(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


# ---- 10


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80), (2, 50)])
def test_ngram_groups(spark, n, percent):
    rows = [r for r in corpus() if r[0] is not None]
    sets = []
    for _, t in rows:
        w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set()))
    linked = [
        (a, b) for b in range(len(rows)) for a in range(b)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    label = components(len(rows), linked)
    least = defaultdict(lambda: 10**9)
    for k, c in enumerate(label):
        least[c] = min(least[c], rows[k][0])
    want = sorted((rows[k][0], len(sets[k]), least[label[k]]) for k in range(len(rows)))
    got = ngram_join.similarity_groups(docs(spark, rows), n, percent)
    assert sorted(tuple(r) for r in got.collect()) == want


def test_ngram_groups_of_large_near_copies(spark):
    """A hot group whose members are mostly no links of its least member; blocks are forced to be small."""
    base = prose(120).split()
    rows = []
    for i in range(90):
        w = list(base)
        for k in rng.sample(range(120), 1 + i % 4):
            w[k] = rng.choice(VOCAB)
        rows.append((i, " ".join(w)))
    old, ngram_join.BLOCK = ngram_join.BLOCK, 16
    try:
        got = {r[0]: r[2] for r in ngram_join.similarity_groups(docs(spark, rows), 3, 90).collect()}
    finally:
        ngram_join.BLOCK = old
    sets = [{tuple(t.split()[k : k + 3]) for k in range(118)} for _, t in rows]
    linked = [(a, b) for b in range(90) for a in range(b) if 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    assert [got[i] for i in range(90)] == components(90, linked)


def test_ngram_empty(spark):
    assert ngram_join.similarity_groups(docs(spark, corpus()).limit(0)).count() == 0


def test_parity_sketch_bounds_the_difference():
    a = np.unique(np.random.default_rng(1).integers(0, 2**63, 500).astype(np.uint64))
    b = np.concatenate([a[20:], a[:5] + np.uint64(1)])
    x, y = (np.frombuffer(ngram_join.bit_sketch(np.unique(s)), np.uint64) for s in (a, b))
    assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


# ---- 6


def removed(rows, length=200):
    seen = Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[k : k + length] for k in range(len(b) - length + 1))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, y in zip(b, gone) if not y)
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most,repeated_ids", [(40_000, False), (2, False), (40_000, True)])
def test_repeats(spark, most, repeated_ids):
    passages = [prose(60) for _ in range(6)]
    rows = []
    for i in range(50):
        t = prose(rng.randint(0, 60))
        for _ in range(rng.randint(0, 2)):
            p, a = rng.choice(passages), rng.randint(0, 60)
            t += p[a : a + rng.randint(150, 350)] + prose(rng.randint(0, 20))
        rows.append((i, t))
    rows += edge_cases() + [(800, "x" * 900), (801, "ab" * 200), (802, "x" * 199), (803, "x" * 200), (804, rows[3][1])]
    if repeated_ids:
        rows += [rows[0], (None, rows[5][1]), (None, None)]
    old, suffix_dedup.MOST = suffix_dedup.MOST, most
    try:
        got = sorted((tuple(r) for r in suffix_dedup.remove_repeats(docs(spark, rows)).collect()), key=repr)
    finally:
        suffix_dedup.MOST = old
    assert got == removed(rows)


def test_repeats_kept_bytes(spark):
    p = prose(60)
    got = {r["doc_id"]: bytes(r["kept"]).decode() for r in suffix_dedup.remove_repeats(docs(spark, [(1, "start " + p), (2, p + " end")]), kept=True).collect()}
    assert got == {1: "start ", 2: " end"}


# ---- 2


def test_near_vectors(spark):
    r = np.random.default_rng(3)
    rows = []
    for c in range(12):
        base = r.normal(size=16)
        for _ in range(9):
            v = base + r.normal(size=16) * r.choice([0.02, 0.15, 0.3])
            rows.append((len(rows), [float(x) for x in v], c % 3))
    rows += [(len(rows) + k, rows[k][1], rows[k][2]) for k in range(20)]
    n = len(rows)
    x = np.array([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([c for _, _, c in rows])
    near = (x @ x.T >= 0.93) & (label[:, None] == label[None, :])
    want = [(k, int(near[k].sum()) - 1) for k in range(n)]
    comp = components(n, [(a, b) for b in range(n) for a in range(b) if near[a, b]])
    odd = [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [float("nan")] * 16, 1), (n + 3, [1.0, None], 1), (n + 4, rows[0][1], None), (None, rows[0][1], 0), (n + 5, [], 1), (n + 6, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit("x"))
    old, embedding_dedup.BLOCK = embedding_dedup.BLOCK, 8
    try:
        got = {r["vec_id"]: r for r in embedding_dedup.near_vectors(df).collect()}
    finally:
        embedding_dedup.BLOCK = old
    assert [(k, got[k]["n_links"]) for k in range(n)] == want
    assert [got[k]["component_id"] for k in range(n)] == comp
    assert all(got[k]["kept"] == (comp[k] == k) for k in range(n))
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i for i, _, _ in odd)
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["float", "double"])
def test_recall_of_planted_pairs(spark, kind):
    """Pairs a little above the threshold among many others, of single and double floats; repeated rows link with one another."""
    r = np.random.default_rng(8)
    base = r.normal(size=(300, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    aside = r.normal(size=base.shape)
    aside -= (aside * base).sum(axis=1, keepdims=True) * base
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    c = r.uniform(0.9305, 0.94, 300)[:, None]
    both = np.concatenate([base, c * base + np.sqrt(1 - c * c) * aside])
    rows = [(k, [float(x) for x in v], k % 2) for k, v in enumerate(both)]
    rows = [(k, v, (k % 300) % 2) for k, v, _ in rows] + [(1000, rows[0][1], 0), (1000, rows[0][1], 0)]
    got = embedding_dedup.near_vectors(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")).collect()
    links = {x["vec_id"]: x["n_links"] for x in got}
    assert len(got) == len(rows) and links[1000] == links[0] == 3 and links[300] == 3
    assert sum(links[k] == 1 for k in range(1, 300)) >= 0.99 * 299


def test_rotation_codes_estimate_without_bias():
    r = np.random.default_rng(0)
    o = r.normal(size=(400, 64))
    o /= np.linalg.norm(o, axis=1, keepdims=True)
    q = o[::-1]
    turn = embedding_dedup.rotations(64, 64)
    code = np.where(o @ turn > 0, 1, -1) / 8
    f = (code * (o @ turn)).sum(axis=1)
    error = ((q @ turn) * code).sum(axis=1) / f - (o * q).sum(axis=1)
    bound = embedding_dedup.EPSILON * np.sqrt((1 - f**2) / f**2 / 63)
    assert abs(error.mean()) < 0.02 and (abs(error) <= bound).all()


# ---- 3


def test_token_counts(spark):
    model = "piece_bpe_32k.model"
    sp = token_count.load(model)
    pool = list("ab c\n\t▁é①💩 the of  .,0")
    rows = edge_cases()[:-2] + [(i, "".join(rng.choice(pool) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    rows += [(700, "<s> </s> <unk>"), (701, " " * 50 + "x\n\n  y"), (702, prose(900)), (None, "null id"), (700, "again")]
    got = Counter(tuple(r) for r in token_count.token_counts(docs(spark, rows), model, limit=20).collect())
    want = Counter((i, len((t or "").encode()), n := len(sp.encode(t or "")), n > 20) for i, t in rows)
    assert got == want
    assert token_count.token_counts(docs(spark, rows).limit(0)).count() == 0


# ---- 5

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(t):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m[0])
            total = sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(map(int, reversed(d))))
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and total % 10 == 0, "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), list(BASE).index(kind), m.end()))
    return sorted(out)


def test_base_spans():
    pool = ["a", "b@", "c.d", "@", "x@y.zz", ".", "-", "é", " ", "1.2.3.4", "255.256.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (415) 555-2671", "+", "7", "007.1.2.3", "..", "%", "\n", "1.2.3.4.5.6.7.8", "(", "00"]
    for _ in range(4000):
        t = "".join(rng.choice(pool) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(t) == plain_spans(t), t
    long = "a" * 20_000 + "9" * 20_000 + "+1" * 5_000
    assert pii.base_spans(long) == []


def test_disclosing_terms(spark):
    """A name that stands by one address only, in several texts, discloses it; common words don't."""
    rows = [(i, f"{prose(8)} Zyxwvut wrote to zed@mail.example.org about {prose(8)}") for i in range(6)]
    rows += [(10 + i, f"{prose(20)} wrote about {prose(20)}") for i in range(60)] + edge_cases()[:-2] + [(3, None)]
    got = pii.span_digest(pii.personal_data(docs(spark, rows))).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got if r["doc_id"] != 3}
    assert by[1]["n_email"] == 1 and by[1]["n_term"] >= 1
    terms = {t for r in pii.sanitise(docs(spark, rows)).collect() if r["doc_id"] == 1 for t in r["text"].split()}
    assert "Zyxwvut" not in terms and "wrote" in terms and "<EMAIL>" in terms and "<TERM>" in terms
    a, e = rows[1][1].index("zed@"), rows[1][1].index("zed@") + len("zed@mail.example.org")
    assert by[1]["base_sha256"] == hashlib.sha256(f"email:{a}:{e}".encode()).hexdigest()
    assert by[900]["base_sha256"] == hashlib.sha256(b"").hexdigest() and by[900]["spans"] == ""
    assert pii.personal_data(docs(spark, rows).limit(0)).count() == 0


def test_terms_of_whole_documents(spark):
    """A name on another line, far off, or in texts without the address is marked too, however short; entities are not marked again."""
    far = "é " * 200
    rows = [(i, f"Zyxwvut Qo\n{far}{prose(8)}\nwrite to zed@mail.example.org {prose(8)}") for i in range(6)]
    rows += [(10 + i, f"{prose(20)} write to {prose(20)}") for i in range(60)] + [(90, f"{far}\nzyxwvut QO was here"), (91, "nothing")] + edge_cases()[:-2]
    found = {r["doc_id"]: [tuple(x) for x in r["found"]] for r in pii.personal_data(docs(spark, rows)).collect()}
    marked = {i: {dict(rows)[i][a:b].lower() for a, k, b in x if k == 4} for i, x in found.items() if x}
    assert all({"zyxwvut", "qo"} <= marked[i] and not marked[i] & {"write", "zed", "mail"} for i in range(6))
    assert marked[90] >= {"zyxwvut", "qo"} and 91 not in marked
    text = {r["doc_id"]: r["text"] for r in pii.sanitise(docs(spark, rows)).collect()}
    assert text[90].endswith("<TERM> <TERM> was here") and "<EMAIL>" in text[0]


# ---- 1


def test_mix(spark):
    sizes = {"a": 900, "b": 300, "c": 60, None: 10}
    rows, of, i = [], {}, 0
    for s, n in sizes.items():
        for _ in range(n):
            rows.append((i, "t"))
            of[i] = s
            i += 1
    out = mixing.mix_sources(docs(spark, rows, sources=of), block_docs=4).collect()
    assert len(out) == len(rows) and len({r["position"] for r in out}) == len(rows)
    total = sum(n**0.5 for n in sizes.values())
    blocks = sorted({(r["slot"], r["source"]) for r in out if r["in_mix"]}, key=lambda x: x[0])
    assert [s for s, _ in blocks] == list(range(len(blocks))) and len(blocks) > 40
    for s, n in sizes.items():
        had = 0
        for k, (_, x) in enumerate(blocks):
            had += x == s
            assert abs(had - n**0.5 / total * (k + 1)) < 1
    assert mixing.mix_sources(docs(spark, rows).limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix_sources(docs(spark, rows, sources=of), {"a": 1.0})


@pytest.mark.parametrize("weights", [{"a": 3, "b": 1, "c": 0.001}, {"a": 0.1, "b": 0.2, "c": 0.7}, {str(k): (k + 1) ** 0.5 for k in range(12)}, {"only": 2.5}])
def test_schedule(weights):
    """Less than one block from the weights as given, at every slot of a long mix."""
    total = sum(map(Fraction, weights.values()))
    order, ends = mixing.schedule(weights, {x: int(100_000 * float(Fraction(w) / total)) + 1 for x, w in weights.items()})
    assert ends > 50_000 and len(order) == len(set(order))
    share = {x: Fraction(w) / total for x, w in weights.items()}
    scale = math.lcm(*(w.denominator for w in share.values()))
    units = {x: int(w * scale) for x, w in share.items()}
    had = Counter()
    for t, (x, k) in enumerate(order[: ends + 1], 1):
        assert k == had[x]
        had[x] += 1
        assert all(abs(had[y] * scale - u * t) < scale for y, u in units.items())
    rest = [k for x, k in order if x == max(weights)]
    assert rest == sorted(rest)


def test_mix_odd_rows(spark):
    """Null ids, repeated rows, names that clash or hold a dot."""
    rows = [(None, "a", k, "x") for k in range(40)] + [(7, "a", 1, "y")] * 3 + [(k, "b", 0, None) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, source string, slot int, `a.b` string")
    out = mixing.mix_sources(df, {"a": 2, "b": 1, "unused": 5}, block_docs=4, keep=df.columns)
    assert out.columns == ["doc_id", "source", "slot", "a.b", "block", "mix_slot", "position", "in_mix"]
    got = out.collect()
    assert Counter(tuple(r)[:4] for r in got) == Counter(rows) and len({r["position"] for r in got}) == len(rows)


# ---- 4


def test_contamination(spark):
    item = "Alice has 12 apples and Bob has 30 apples so together they hold how many apples after eating 12 of them"
    again = item.replace("12", "77").replace("30", "5").replace("Bob", "Carol")
    mixed = item.replace("12 apples", "77 apples").replace("30", "5")  # one value stands for two
    bench = spark.createDataFrame([(1, item), (2, prose(30)), (3, None), (4, ""), (None, "x"), (5, "alpha beta gamma")], "item_id long, text string").withColumn("size", F.lit(1))
    second = bench.where("item_id = 2").first()["text"]
    rows = [(1, prose(20) + ". " + item), (2, f"{prose(5)}\n{again} {prose(5)}"), (3, mixed), (4, prose(40)), (5, f"{prose(9)} {' '.join(second.split()[3:20])} {prose(9)}"), (6, " ".join(second.split()[:9])), (7, "Alpha, beta gamma!"), (8, "alpha beta gamma delta"), (1, prose(9))]
    rows += edge_cases()
    got = decontaminate.contamination(docs(spark, rows), bench).collect()
    assert len(got) == len(rows)
    found = {(r["doc_id"], tuple(r["item_ids"])) for r in got if r["contaminated"]}
    # 3 has a run of 13 tokens beside the value that conflicts, 8 holds a short item verbatim
    assert found == {(1, (1,)), (2, (1,)), (3, (1,)), (5, (2,)), (7, (5,)), (8, (5,))}
    assert decontaminate.contamination(docs(spark, rows), bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(docs(spark, rows).limit(0), bench).count() == 0


def test_contamination_of_whole_passages(spark):
    """Verbatim passages that are mostly values, short items in a document, and a passage beside a value that conflicts."""
    sums = " ".join(str(k * 7) for k in range(20))
    title = "The Grand Old Duke Of York Had Ten Thousand Men And He Marched Them Up"
    tail = prose(16)
    items = [(1, sums), (2, title), (3, "who wrote the Iliad"), (4, f"12 boats sail and 12 boats sink {tail}"), (5, "中国的首都是哪一座城市请回答我"), (6, "小王有几只羊"), (7, "a 12 b 30 " + prose(11))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [
        (1, f"{prose(9)} {sums} {prose(9)}"), (2, f"{prose(9)}. {title} {prose(9)}"), (3, f"{prose(9)} Who wrote the Iliad? {prose(9)}"), (4, f"7 boats sail and 12 boats sink {tail}"),
        (5, f"{prose(4)}好的{items[4][1]}谢谢"), (6, f"问{items[5][1]}呢"), (7, items[6][1].replace("12", "5").replace("30", "5")), (11, prose(9) + " " + " ".join(str(k * 9) for k in range(20))),
        (12, "The Grand New Duke Of Ghent Had Nine Hundred Men And She Led Them Down"), (13, prose(9) + " who wrote the Odyssey"), (14, "中国的首都在哪里"),
    ]
    got = decontaminate.contamination(docs(spark, rows), bench).collect()
    assert {(r["doc_id"], tuple(r["item_ids"])) for r in got if r["contaminated"]} == {(k, (k,)) for k in range(1, 8)}


SIGNS = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
TOKEN = re.compile(rf"[^\W\d_{SIGNS}]+(?:['’][^\W\d_{SIGNS}]+)*|[{SIGNS}]|\d+(?:[.,:/]\d+)*|[%°€$£]")


def plain_template(text):
    """Template tokens and values, token by token."""
    tokens, values, end, before = [], [], 0, False
    for m in TOKEN.finditer(text):
        word, low = m[0], m[0].lower()
        inner = before and text[end : m.start()].isspace() and "\n" not in text[end : m.start()]
        if word[0].isdecimal():
            t = "<number>"
        elif low in decontaminate.UNITS and tokens and tokens[-1] == "<number>":
            t = "<unit>"
        else:
            t = "<name>" if inner and word[0].isupper() else low
        tokens.append(t)
        values.append(low)
        end, before = m.end(), True
    return tokens, values


def test_template_tokens():
    """The flat tokeniser against one that goes token by token."""
    pool = ["Bob", "bob", "12", "3.5", "1,", "km", "%", "€", " ", " ", "\n", "\t", "it's", "l’Été", "'", ".", "中", "国人", "é", "_", "x1", "7h", "А", "-", "½", "\u3000", "💩", "\0", "ǅ"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    t = decontaminate.Tokens(texts)
    names = {}
    for i, text in enumerate(texts):
        tokens, values = plain_template(text)
        lo, hi = t.first[i : i + 2]
        assert [t.text[a:b].lower() for a, b in zip(t.start[lo:hi], t.end[lo:hi])] == values, text
        assert list(t.slot[lo:hi]) == [x in ("<number>", "<unit>", "<name>") for x in tokens], text
        for key, h in [*zip(tokens, t.hash[lo:hi].tolist()), *zip([("value", x) for x in values], t.value[lo:hi].tolist())]:
            assert names.setdefault(key, h) == h
    plain = {k: h for k, h in names.items() if isinstance(k, str)}
    assert len(set(plain.values())) == len(plain)


def plain_covered(text, item, least=decontaminate.LEAST):
    """Whether a text holds an item, by all diagonals and all windows on them."""
    (a, av), (b, bv) = plain_template(text), plain_template(item)
    slot = lambda x: x in ("<number>", "<unit>", "<name>")
    if len(b) < decontaminate.WINDOW:
        same = a == b and sum(map(slot, b)) <= len(b) // 2
        return bool(b) and (same or any(av[k : k + len(b)] == bv for k in range(len(av) - len(b) + 1)))
    w = decontaminate.WINDOW
    for diagonal in range(-len(b) + w, len(a) - w + 1):
        met = []
        for at in range(max(0, -diagonal), min(len(b), len(a) - diagonal) - w + 1):
            x, y, d = slice(at, at + w), slice(at + diagonal, at + diagonal + w), at + diagonal
            if bv[x] == av[y] or (b[x] == a[y] and sum(map(slot, b[x])) <= decontaminate.SLOTS):
                met.append((at, {(bv[at + k], av[d + k]) for k in range(w) if slot(b[at + k])}))
        for lo in range(len(met)):
            pairs, cover = set(), set()
            for at, p in met[lo:]:
                pairs |= p
                if len({x for x, _ in pairs}) < len(pairs):
                    break
                cover |= set(range(at, at + w))
                if len(cover) >= min(least, len(b)):
                    return True
    return False


def test_contamination_by_brute_force(spark):
    """All documents against all items, with values, case, order and words changed."""
    r = random.Random(17)
    some = ["Alice", "Bob", "Carol", "12", "30", "7", "3.5 km", "20 %", "apples", "sold", "at", "noon", "the", "cost", "of", "is"]
    items = [(k, " ".join(r.choice(some) for _ in range(r.randint(2, 26)))) for k in range(25)] + [(25, " ".join(str(k * k) for k in range(15)))]
    rows = []
    for i in range(120):
        words = r.choice(items)[1].split()
        kind = i % 6
        if kind == 1:
            change = {x: r.choice(["44", "5", "Dave", "Erin"]) for x in words if x[0].isdigit() or x[0].isupper()}
            words = [change.get(x, x) for x in words]
        if kind == 2:
            words = [x.upper() if i % 4 else x.lower() for x in words]
        if kind == 3:
            words[len(words) // 2 : len(words) // 2] = ["filler"] * 3
        if kind == 4:
            words = words[: r.randint(1, len(words))]
        if kind == 5:
            words = r.sample(words, len(words))
        rows.append((i, f"{prose(r.randint(0, 6))} {' '.join(words)} {prose(r.randint(0, 6))}"))
    rows += edge_cases()
    got = decontaminate.contamination(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = {i: tuple(k for k, item in items if plain_covered(t or "", item)) for i, t in rows}
    assert {x["doc_id"]: tuple(x["item_ids"]) for x in got} == want
    assert sum(map(bool, want.values())) > 40


def test_longest_run():
    """Against all runs of windows."""
    r = random.Random(2)
    for _ in range(500):
        at = sorted(r.sample(range(40), r.randint(1, 20)))
        windows = [(a, [r.choice("ab") for _ in range(r.randint(0, 2))], []) for a in at]
        windows = [(a, its, [r.choice("xxxxxy") for _ in its]) for a, its, _ in windows]
        best = 0
        for lo in range(len(at)):
            for hi in range(lo + 1, len(at) + 1):
                pairs = {p for _, its, mine in windows[lo:hi] for p in zip(its, mine)}
                if len({x for x, _ in pairs}) == len(pairs):
                    best = max(best, len({a + k for a, _, _ in windows[lo:hi] for k in range(decontaminate.WINDOW)}))
        assert decontaminate.longest_run(windows) == best


# ---- 7 and 8, by held-out accuracy


def test_languages(spark):
    syllables = {"xx": ["ka", "to", "mi"], "yy": ["ber", "schu", "ung"], "zz": ["é", "oui", "eau"]}
    rows, langs = [], {}
    for i in range(300):
        lang = sorted(syllables)[i % 3]
        langs[i] = lang if i % 7 else None
        rows.append((i, " ".join("".join(rng.choice(syllables[lang]) for _ in range(3)) for _ in range(12))))
    odd = [(900, None), (901, ""), (902, "123 !?"), (None, rows[0][1]), (5, rows[6][1])]
    got = language_id.identify(docs(spark, rows + odd, langs)).collect()
    assert len(got) == len(rows) + len(odd)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got if r["doc_id"] is not None)
    by = {r["doc_id"]: r for r in got if r["doc_id"] != 5}
    assert all(by[i]["lang_pred"] == sorted(syllables)[i % 3] for i in range(300) if i != 5)
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (900, 901, 902))
    assert all(0 <= r["score"] <= 1 for r in got)
    nothing = language_id.identify(docs(spark, rows[:5])).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}
    assert language_id.identify(docs(spark, rows).limit(0)).count() == 0


def test_toxicity(spark):
    bad = ["grumblo", "snarfit", "vexatol"]
    rows, toxic = [], []
    for i in range(400):
        w = prose(rng.randint(5, 120)).split()
        y = i % 4 == 0
        if y:
            w[rng.randrange(len(w))] = rng.choice(bad)
        rows.append((i, " ".join(w)))
        toxic.append((i, int(y)))
    labels = spark.createDataFrame(toxic + [(900, None), (None, 1), (7, 2)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs(spark, rows + [(900, None), (901, ""), (902, "..."), (None, rows[0][1])]), labels).collect()
    by = {r["doc_id"]: r for r in got}
    held = [i for i in range(400) if by[i]["held_out"]]
    right = sum(by[i]["predicted"] == (i % 4 == 0) for i in held)
    assert len(held) > 90 and right / len(held) > 0.95
    assert all(by[i]["score"] == 0 for i in (900, 901, 902))
    kept = toxicity.drop_toxic(docs(spark, rows), labels)
    assert kept.columns == docs(spark, rows).columns and kept.count() < 400
    assert toxicity.toxicity(docs(spark, rows).limit(0), labels.limit(0)).count() == 0


# ---- 9


def test_lines(spark):
    """Against all pairs of lines; the seeds are such that no pair is missed by the bands."""
    lines = [prose(12) for _ in range(40)]
    texts = []
    for i in range(40):
        own = []
        for _ in range(rng.randint(1, 6)):
            w = rng.choice(lines).split()
            if rng.random() < 0.4:
                w[-1] = rng.choice(VOCAB)
            own.append(" ".join(w))
        texts.append((i, "\n".join(own + ["short"])))
    texts += edge_cases()[:-2] + [(None, None)]
    old, line_dedup.BLOCK = line_dedup.BLOCK, 4
    try:
        got = line_dedup.dedup_lines(docs(spark, texts)).select("row.doc_id", "text", "n_lines", "n_removed").collect()
    finally:
        line_dedup.BLOCK = old
    every = [(i, k, x.strip(" ")) for i, t in texts if t is not None for k, x in enumerate(t.split("\n")) if len(x.strip(" ")) >= 30]
    every.sort(key=lambda x: x[:2])
    shingles = [{x[k : k + 12] for k in range(len(x) - 11)} for _, _, x in every]
    linked = [(a, b) for b in range(len(every)) for a in range(b) if 100 * len(shingles[a] & shingles[b]) >= 80 * len(shingles[a] | shingles[b])]
    label = components(len(every), linked)
    gone = {every[k][:2] for k in range(len(every)) if label[k] != k}
    want = {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in texts}
    assert {r["doc_id"]: r["text"] for r in got} == want
    assert all(r["n_removed"] == sum(g[0] == r["doc_id"] for g in gone) for r in got)
    assert all(r["n_lines"] == (0 if dict(texts)[r["doc_id"]] is None else dict(texts)[r["doc_id"]].count("\n") + 1) for r in got)
    assert line_dedup.dedup_lines(docs(spark, texts).limit(0)).count() == 0


def lines_left(texts):
    """By all pairs of lines and the shingles at every character."""
    every = sorted(((i, k, x.strip(" ")) for i, t in texts for k, x in enumerate(t.split("\n")) if len(x.strip(" ")) >= 30), key=lambda x: x[:2])
    shingles = [{x[k : k + 12] for k in range(len(x) - 11)} for _, _, x in every]
    linked = [(a, b) for b in range(len(every)) for a in range(b) if 100 * len(shingles[a] & shingles[b]) >= 80 * len(shingles[a] | shingles[b])]
    label = components(len(every), linked)
    gone = {every[k][:2] for k in range(len(every)) if label[k] != k}
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in texts}


@pytest.mark.parametrize("block", [2, 64])
def test_lines_without_spaces(spark, block):
    """Links by every character: addresses, tables, encoded bytes, Chinese and characters beyond 16 bits."""
    r = random.Random(11)
    some = lambda pool, n: "".join(r.choice(pool) for _ in range(n))
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    kinds = [lambda: "https://www." + some(letters, 60), lambda: "\t".join(some(letters, 5) for _ in range(14)), lambda: some("的一是不了人我在有他这中大来上国", 90), lambda: some("😀😃😄😁🙂é", 80)]
    texts = []
    for i in range(48):
        line = kinds[i % 4]()
        near = line[:-1] + ("x" if line[-1] != "x" else "y")  # one shingle of many
        far = line[:12] + kinds[i % 4]()[12:]
        texts.append((i, "\n".join([line, "word " * 8 + some(letters, 40)])))
        texts += [(100 + i, near), (200 + i, far)]
    old, line_dedup.BLOCK = line_dedup.BLOCK, block
    try:
        got = {x["doc_id"]: x["text"] for x in line_dedup.dedup_lines(docs(spark, texts)).select("row.doc_id", "text").collect()}
    finally:
        line_dedup.BLOCK = old
    want = lines_left(texts)
    assert sum(t == "" for t in want.values()) == 48 and all(want[200 + i] for i in range(48))
    assert got == want


def test_lines_by_every_character(spark):
    """Lines of words, also with a long last word of which only the end differs."""
    r = random.Random(3)
    lines = [" ".join(r.choice(VOCAB) for _ in range(14)) for _ in range(20)]
    texts = [(i, "\n".join(r.choice(lines)[: r.choice([None, -1, -2])] for _ in range(3))) for i in range(30)]
    tails = ["".join(r.choice("abcdefgh") for _ in range(60)) for _ in range(6)]
    texts += [(100 + i, "see the page at " + t) for i, t in enumerate(tails)] + [(200, "see the page at " + tails[0][:12] + tails[1][12:])]
    got = {x["doc_id"]: x["text"] for x in line_dedup.dedup_lines(docs(spark, texts)).select("row.doc_id", "text").collect()}
    assert got == lines_left(texts)


def test_lines_recall(spark):
    """Of pairs at 80 to 84 % nine in ten at least are found; pairs below 80 % never are."""
    r = random.Random(23)
    some = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    shingles = lambda x: {x[k : k + 12] for k in range(len(x) - 11)}
    near, below, texts = [], [], []
    while len(near) < 150 or len(below) < 50:
        a = "x" + some(r.randint(150, 400)) + "x"
        at = r.randint(20, len(a) - 20)
        b = a[:at] + "".join(r.choice("0123456789") for _ in range(r.randint(1, len(a) // 8))) + a[at:]
        x, y = shingles(a), shingles(b)
        j = len(x & y) / len(x | y)
        where = near if 0.8 <= j <= 0.84 else below if 0.72 <= j < 0.8 else None
        if where is not None:
            where.append(len(texts) + 1)
            texts += [(len(texts), a), (len(texts) + 1, b)]
    gone = {x["doc_id"] for x in line_dedup.dedup_lines(docs(spark, texts)).where("n_removed > 0").select("row.doc_id").collect()}
    assert not gone - set(near) and len(gone) >= 0.9 * len(near)


def test_equal_lines_of_repeated_rows(spark):
    """Rows with one id and text are one document; equal lines elsewhere go; short ones stay."""
    line = prose(20)
    rows = [(3, line), (3, line), (4, f"{line}\nshort"), (5, "short"), (2, None), (1, "")]
    got = Counter((x["doc_id"], x["text"]) for x in line_dedup.dedup_lines(docs(spark, rows)).select("row.doc_id", "text").collect())
    assert got == Counter([(3, line), (3, line), (4, "short"), (5, "short"), (2, None), (1, "")])


# ---- the pipeline


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    before = {r["doc_id"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = corpus_pipeline.run(spark, sf).collect()
    after = {r["doc_id"] for r in out}
    assert len(after) == len(out) and after <= before and len(after) > len(before) / 2
    assert len({r["position"] for r in out}) == len(out)


def odd_documents(spark):
    """Nulls in every column, an empty text, repeated rows and ids, columns whose names the stages use inside."""
    rows = [(i, prose(30), "en", f"s{i % 3}", 1) for i in range(40)]
    rows += [(50, rows[0][1], "en", "s0", 1), (51, rows[1][1] + " more", None, None, None), rows[5], (6, prose(30), "de", "s1", 2)]
    rows += [(None, prose(30), None, None, None), (60, None, None, "s1", None), (61, "", "en", "s2", 0), (None, None, None, None, None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    more = {"uid": 1, "row": "r", "_uid": 2, "node": 3, "id": 4, "slot": 5, "position": 6, "block": 7, "class": 8, "a.b": 9, "n_removed": 10, "score": 0.5}
    return df.withColumns({c: F.lit(v) for c, v in more.items() if "." not in c}).withColumn("a.b", F.lit(9)).repartition(2), rows


def test_stages_of_odd_documents(spark):
    """Every stage keeps the columns and the clean rows, also of an empty table."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    df, rows = odd_documents(spark)
    quoted = ["doc_id", "text", "`a.b`"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, sf)
        assert set(df.columns) <= set(out.columns)
        assert (out.columns == df.columns) == (name != "mixing")
        kept[name] = Counter((r[0], r[1]) for r in out.select(quoted).collect())
        assert stage(spark, df.limit(0), sf).count() == 0
    every = Counter((r[0], r[1]) for r in rows)
    assert kept["mixing"] == every
    assert sum(kept["toxicity"].values()) >= len(rows) - 6
    assert kept["benchmark decontamination"] == every
    gone = every - kept["n-gram Jaccard join"]
    assert gone == Counter([(50, rows[0][1]), (51, rows[1][1] + " more"), rows[5][:2], (None, None)])
    left = kept["line dedup"]
    assert sum(left.values()) == len(rows) - 2 and (60, None) in left and (61, "") in left  # 50 and 51 lose their only line


def test_lines_of_a_loose_group_make_few_links(spark, monkeypatch):
    """All lines of a bucket link with each other and none with its centre: their links name each label once a block, not each pair."""
    from waygraph.llm import line_dedup

    base = "the quick brown fox jumps over the lazy dog and runs back into the dark forest before the night falls "
    texts = [(k, f"{base}{k:03d}") for k in range(200)] + [(900, "nothing of this line is like any of the other ones, whatever its end")]
    made = []

    def watched(members, verify, across, rounds=1):
        nodes = [r[0] for r in members.select("node").distinct().collect()]
        verify(spark.createDataFrame([(min(nodes), n) for n in nodes], "a long, b long"))  # names the texts
        inside = spark.createDataFrame([(1, n, n) for n in nodes], "key long, node long, label long")
        for last in (False, True):
            links = across(inside, last).select("a", "b").collect()
            root = {n: n for n in nodes}

            def top(n):
                return n if root[n] == n else top(root[n])

            for a, b in links:
                root[top(a)] = top(b)
            made.append((len(links), len({top(n) for n in nodes})))
        return spark.createDataFrame([], "id long, component long")

    monkeypatch.setattr(line_dedup, "bucket_components", watched)
    line_dedup.duplicate_lines(spark.createDataFrame(texts, "doc_id long, text string"))
    (few, _), (all_, classes) = made
    assert classes == 2  # the group, and the line that is like none
    assert few < 201 and all_ < 201 * 8  # 19,900 pairs
