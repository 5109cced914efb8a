"""Permutation index, prefix trie and phrase collocations against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoloom.llm import collocations, permutation_index, prefix_trie
from cytoloom.llm.shared import Work

# ---- permutation index --------------------------------------------------------------------------------------------------------


def nearest(data, queries, k):
    """data, queries: (id, vector); the k nearest usable others of each query."""
    good = [(i, np.array(v, float)) for i, v in data if usable(v)]
    out = set()
    for q, v in {(i, tuple(v)) for i, v in queries if usable(v)}:
        best = {}
        for i, x in good:
            if i != q and len(x) == len(v):
                best[i] = min(best.get(i, np.inf), float(np.sqrt(((x - np.array(v, float)) ** 2).sum())))
        for rank, (i, d) in enumerate(sorted(best.items(), key=lambda t: (t[1], t[0]))[:k], 1):
            out.add((q, rank, i, round(d, 9)))
    return out


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)


def found(df):
    return [(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in df.collect()]


def vectors(spark, rows, more=""):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>" + more)


def test_permutation_index_measures_all_of_few_rows(spark):
    odd = [(90, None), (91, [0.0, 0.0]), (92, [1.0, None]), (93, [float("nan"), 1.0]), (94, [float("inf"), 1.0]), (95, []), (96, [1.0, 2.0, 3.0]), (97, [1.0, 2.0, 4.0])]
    rows = [(i, [float(i % 5), 1.0]) for i in range(40)] + [(3, [3.0, 1.0]), (7, [0.5, 0.5])] + odd
    data = vectors(spark, rows)
    queries = data.where("vec_id % 10 IN (0, 3, 6)")
    got = found(permutation_index.search(queries, data, k=4))
    assert len(got) == len(set(got)) and set(got) == nearest(rows, [r for r in rows if r[0] % 10 in (0, 3, 6)], 4)


def test_permutation_index_empty_and_clashing_columns(spark):
    data = vectors(spark, [(1, [1.0]), (2, [2.0]), (None, [3.0])])
    more = data.selectExpr("vec_id", "embedding", *[f"7 AS {c}" for c in ("id", "v", "h", "ranks", "d", "pivot", "part", "parts", "place", "rank", "score", "query_id", "far")])
    assert found(permutation_index.search(more, more)) == [(1, 1, 2, 1.0), (2, 1, 1, 1.0)]
    assert found(permutation_index.search(data.where("false"), data)) == [] == found(permutation_index.search(data, data.where("false")))
    with pytest.raises(ValueError):
        permutation_index.search(data, data, most_pivots=300)


def test_permutation_index_recall(spark):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(12, 24))
    x = (centers[rng.integers(12, size=3000)] + 0.6 * rng.normal(size=(3000, 24))).astype(np.float32)
    x[1000:2000] = centers[0] + 0.01 * rng.normal(size=(1000, 24))  # a third: near copies of each other
    x[2000:2400] = x[0]  # and exact copies of a query
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    data = vectors(spark, rows)
    got = found(permutation_index.search(data.where("vec_id % 100 = 0"), data, part=500))
    want = nearest(rows, [r for r in rows if r[0] % 100 == 0], 10)
    by_id = {(q, i): d for q, _, i, d in want}
    assert Counter(q for q, *_ in got) == Counter({q: 10 for q in range(0, 3000, 100)})
    assert len(by_id.keys() & {(q, i) for q, _, i, _ in got}) >= 0.95 * len(by_id)
    assert {g[1:] for g in got if g[0] == 0} == {w[1:] for w in want if w[0] == 0} and {g[2] for g in got if g[0] == 0} == set(range(2000, 2010))


def test_permutations_and_footrule():
    to = np.array([[0.0, 0.0], [1.0, 0.0], [5.0, 0.0]])
    ranks = permutation_index.permutations(np.array([[0.1, 0.0], [4.0, 0.0]]), to)
    assert ranks.tolist() == [[0, 1, 2], [2, 1, 0]]
    assert permutation_index.footrule(ranks, ranks[0]).tolist() == [0, 4]


# ---- prefix trie --------------------------------------------------------------------------------------------------------------


def brute_trie(rows):
    """rows: (conv_id, turn, role, text) -> the rows of the trie."""
    told = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            told[c].append((turn is not None, turn or 0, role or "", text or ""))
    told = {c: [t[2:] for t in sorted(x, key=lambda t: (t[0], t[1], hashlib.sha256(f"{len(t[2])}:{t[2]}{t[3]}".encode()).digest()))] for c, x in told.items()}
    new = {}
    for c, own in told.items():
        h = zlib.crc32(str(c).encode()) % 4
        new[c] = told.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])[:h] + own[h:]
    members, kids = defaultdict(list), defaultdict(set)
    for c, turns in new.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                kids[tuple(turns[: d - 1])].add(tuple(turns[:d]))

    def total(node):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        below = [total(x) for x in kids[node]]
        return (sum(b[0] for b in below) or 1, (len(members[node]) - 1) * words + sum(b[1] for b in below))

    out = []
    for node, who in members.items():
        ends = ",".join(map(str, sorted(c for c in who if len(new[c]) == len(node))))
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(kids[node]), *total(node), hashlib.sha256(ends.encode()).hexdigest()))
    return Counter(out)


def trie_rows(df):
    return Counter(map(tuple, prefix_trie.trie(df).collect()))


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("seed", range(2))
def test_trie_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-30, 90), 70):
        for i in range(rng.randrange(1, 7)):
            rows.append((c, rng.choice([i, i, i, None, 2]), rng.choice(["user", "user", None, "a"]), rng.choice(["hi there", "ok", "", None, "a b\tc"])))
    rows += rows[:20] + [(None, 1, "user", "lost")]
    assert trie_rows(spark.createDataFrame(rows, SCHEMA)) == brute_trie(rows)


def test_trie_of_long_and_copied_conversations(spark):
    """A conversation of 400 turns has two copies, and another leaves it at its third turn: no round for each turn."""
    rows = [(c, i, "user", f"turn {i} of it") for c in (0, 21, 42) for i in range(400)] + [(63, i, "user", f"turn {i} of it") for i in range(3)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert trie_rows(df) == brute_trie(rows)


def test_trie_empty_null_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, 0, None, None), (2, None, "a", "b c"), (40, 0, "a", "b c")], SCHEMA)
    want = brute_trie([tuple(r) for r in df.collect()])
    names = ("c", "at", "r", "d", "tok", "a", "b", "s", "depth", "part", "own", "n_convs", "waits", "single", "h", "base", "given")
    assert trie_rows(df.selectExpr("*", *[f"9 AS {c}" for c in names])) == want
    assert trie_rows(df.where("false")) == Counter() == trie_rows(df.withColumn("conv_id", F.lit(None).cast("long")))


def test_running_sums_across_tasks(spark):
    work = Work(spark)
    rows = [(c, i, (c * 7 + i * 2**61) % 2**63) for c in (1, 2, 3) for i in range({1: 5, 2: 900, 3: 1}[c])]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 13)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = {(r.c, r.i): (r.x, r.x_before) for r in prefix_trie.running(spark.createDataFrame(rows, "c long, i long, x long"), "c", ["i"], ["x"], work).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", old)
    signed = lambda x: (x + 2**63) % 2**64 - 2**63
    for c in (1, 2, 3):
        total = 0
        for _, i, x in (r for r in rows if r[0] == c):
            assert got[c, i] == (signed(total + x), signed(total))
            total += x


# ---- collocations -------------------------------------------------------------------------------------------------------------


def brute_phrases(rows, max_n=4, least=30, inside=80, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for i in range(len(w)):
                for m in range(1, max_n + 1):
                    if i + m <= len(w):
                        f[lang][tuple(w[i : i + m])] += 1
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in cand.items():
            longer = any(100 * b >= inside * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in cand.items() if len(q) > len(p))
            if not longer:
                score, _, left, right = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def mined(df, **options):
    return sorted(map(tuple, collocations.mine(df, **options).collect()))


@pytest.mark.parametrize("max_n,least,top", [(2, 5, 2000), (4, 30, 7), (5, 5, 2000)])
def test_phrases_against_brute_force(spark, max_n, least, top):
    rng = random.Random(max_n)
    words = ["the", "The", "of", "ÄB", "äb", "x1", "New", "york", "city", "é è", "a-b"]
    texts = []
    for i in range(300):
        t = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", "\r\n", ","]) for _ in range(rng.randrange(40)))
        texts.append((rng.choice(["en", "en", "en", "fr", None, "und"]), rng.choice([t, t, t, "New York City hall " * 3, None, ""])))
    df = spark.createDataFrame(texts, "lang string, text string").repartition(5)
    assert mined(df, max_n=max_n, least=least, top=top) == brute_phrases(texts, max_n, least, top=top)


def test_phrases_do_not_depend_on_filters_or_chunks(spark, monkeypatch):
    """A filter that says yes to all, and texts cut at the end of every piece, give the same phrases."""
    texts = [("en", "to be or not to be, that is the question. " * 40), ("fr", "to be or not. to be")] * 2
    df = spark.createDataFrame(texts, "lang string, text string")
    want = brute_phrases(texts, least=3)
    assert mined(df, least=3) == want
    batch = df.coalesce(1).toArrow().to_batches()[0]
    chunks = list(collocations._chunks(batch, 64))
    assert len(chunks) > 20 and b"".join(x for c in chunks for x in c.values()).count(b"question") == 80
    monkeypatch.setattr(collocations.Filter, "of", classmethod(lambda cls, phrases: cls(np.full(4, 2**64 - 1, np.uint64))))
    assert mined(df, least=3) == want


def test_phrases_filter_never_says_no(spark):
    rows = [("en", f"word{i} b{i % 7}") for i in range(5000)]
    made = collocations.Filter.of(spark.createDataFrame(rows, "lang string, phrase string"))
    h = np.array([collocations.hashed(*r) for r in rows])
    other = np.array([collocations.hashed("fr", p) for _, p in rows])
    assert made.has(h).all() and made.has(other).mean() < 0.1


def test_phrases_empty_null_and_clashing_columns(spark):
    df = spark.createDataFrame([(None, "a b " * 20), ("x", None), ("y", "")], "lang string, text string")
    want = brute_phrases([tuple(r) for r in df.collect()], least=3)
    names = ("size", "phrase", "f", "c", "a", "l", "r", "n", "score", "rank", "part", "place", "w", "k", "left", "right", "of", "within")
    assert mined(df.selectExpr("*", *[f"9 AS `{c}`" for c in names]), least=3) == want and want[0][0] == "und"
    assert mined(df.where("false")) == [] == mined(df.where("text IS NULL"))


# ---- near copies of short texts -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n,changed", [(5, 1), (6, 1), (10, 2), (12, 2), (15, 3), (20, 4), (30, 6), (40, 8), (60, 12)])
def test_short_near_copies_share_a_sketch(n, changed):
    """Of pairs of the least similarity that counts, by length, at least nine in ten are candidates."""
    from cytoloom.llm import order_minhash

    rng, met = np.random.default_rng(n), 0
    for _ in range(300):
        a = rng.integers(1 << 62, size=n)
        b = a.copy()
        b[rng.choice(n, changed, replace=False)] = rng.integers(1 << 62, size=changed)
        met += bool(np.isin(order_minhash.sketches(a), order_minhash.sketches(b)).any())
    assert met >= 270


def test_short_near_copies_are_one_class(spark):
    from cytoloom.llm import order_minhash

    rows = [(1, "one two three four five"), (2, "one two other four five"), (3, "a b c d e f g h i j"), (4, "a b c X e f g Y i j"), (5, "one two or four and"), (6, "j i h g f e d c b a")]
    got = {r.doc_id: r.class_id for r in order_minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 6}
