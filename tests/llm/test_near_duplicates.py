"""Large groups of near copies: how often two texts meet, and how the pairs are dealt to tasks."""

import numpy as np
import pyarrow as pa

from cytoloom.llm import order_minhash
from cytoloom.llm.shared import Work


def test_long_texts_meet_once():
    rng = np.random.default_rng(4)
    rare, base = rng.integers(1, 1 << 62, 60), rng.integers(1, 1 << 62, 700)
    found = []
    for _ in range(8):  # 700 words, of which 140 are of 60 words that all the texts have: more than 64 rows for each
        w = base.copy()
        w[rng.choice(700, 140, replace=False)] = rare[rng.integers(0, 60, 140)]
        found.append(order_minhash.labelled_kmers(w, 1))
    counts = np.bincount(np.concatenate(found) % np.uint64(order_minhash.CELLS), minlength=order_minhash.CELLS)
    bits = pa.array([order_minhash.parities(w).tolist() for w in found], pa.list_(pa.int64()))
    names = pa.array([bytes([i]) for i in range(8)], pa.binary())
    batch = pa.RecordBatch.from_arrays([names, names, pa.array([w.view(np.int64).tolist() for w in found], pa.list_(pa.int64())), bits], names=["tid", "comp", "words", "bits"])
    rows = [r for b in order_minhash.rare_rows(batch, counts) for r in b.to_pylist()]
    assert len(rows) == sum(len(order_minhash.rare_first(w & np.uint64(0xFFFFFFFF), counts)[0]) for w in found) > 64 * 8
    for a in range(8):
        for b in range(a):
            own, other = ({r["word"]: set(r["before"]) for r in rows if r["tid"] == bytes([i])} for i in (a, b))
            shared = own.keys() & other.keys()
            assert len(shared) > 1 and sum(not own[w] & other[w] for w in shared) == 1


def test_pairs_dealt_by_groups_of_texts_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(order_minhash, "SMALL", 1)
    monkeypatch.setattr(order_minhash, "TOGETHER", 2)
    monkeypatch.setattr(order_minhash, "PARTNERS", 3)
    tables, written = [], Work.table
    monkeypatch.setattr(Work, "table", lambda self, df, keep=False: tables.append(written(self, df, keep)) or tables[-1])
    monkeypatch.setattr(Work, "drop", lambda self: None)
    rng = np.random.default_rng(9)
    base, texts = [f"w{i}" for i in range(60)], []
    for i in range(40):
        w = list(base)
        for j in rng.choice(60, 7 + i % 3, replace=False):
            w[j] = f"e{rng.integers(0, 12)}"
        texts.append(" ".join(w))
    got = {r.doc_id: r.class_id for r in order_minhash.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    hashed = [np.array([hash(w) for w in t.split()], np.int64) for t in texts]
    for i in range(40):
        for j in range(i):
            if order_minhash.similarity(hashed[i], hashed[j]) >= order_minhash.SIMILAR:
                assert got[i] == got[j]  # all share words, so a link that bounds of sketches don't leave out is found
    pairs, dealt = ([t for t in tables if t.columns == c] for c in (["of", "a", "b"], ["of", "side", "part", "a", "b"]))
    assert len(pairs) == len(dealt) == 3 and [t.count() for t in pairs] == [t.count() for t in dealt]
    assert max(r["count"] for t in dealt for r in t.select("of", "side", "part", "a").distinct().groupBy("of", "side", "part").count().collect()) <= 8


def test_main_classes_rows_are_told_from_the_others():
    rng, pool = np.random.default_rng(5), np.random.default_rng(6).integers(1, 1 << 62, 40)
    found, cls = [], [7] * 30 + list(range(100, 120))
    for _ in cls:
        found.append(order_minhash.labelled_kmers(np.concatenate([rng.choice(pool, 20), rng.integers(1, 1 << 62, 5)]), 1))
    counts = np.bincount(np.concatenate(found) % np.uint64(order_minhash.CELLS), minlength=order_minhash.CELLS)
    told = [order_minhash.rare_first(w & np.uint64(0xFFFFFFFF), counts)[0] for w in found]
    parts = [order_minhash.Mains(order_minhash.MAINS) for _ in range(3)]
    for i, w in enumerate(told):
        parts[i % 3].count((w % np.uint64(order_minhash.MAINS)).astype(np.int64), np.full(len(w), cls[i]))
    for p in parts[1:]:
        at = np.flatnonzero(p.n)
        parts[0].take(at, p.of[at], p.n[at], p.several[at])
    names = pa.array([bytes([i]) for i in range(50)], pa.binary())
    longs = [pa.array([w.view(np.int64).tolist() for w in x], pa.list_(pa.int64())) for x in (found, [order_minhash.parities(w) for w in found])]
    batch = pa.RecordBatch.from_arrays([names, names, *longs, pa.array(cls, pa.int64())], names=["tid", "comp", "words", "bits", "cls"])
    every, own, others = ({(r["tid"][0], r["word"]) for b in order_minhash.rare_rows(batch, counts, **k) for r in b.to_pylist()} for k in ({}, *({"mains": (parts[0].of, parts[0].several > 0), "own": o} for o in (True, False))))
    assert own and others and not own & others and own | others <= every
    for i, w in every:
        for j, v in every:
            if w == v and cls[i] != cls[j]:  # such a pair meets: both have a row, one of them beside the main class's
                assert {(i, w), (j, v)} <= own | others and {(i, w), (j, v)} & others


def test_a_large_class_has_no_rows_joined_by_word(spark, monkeypatch):
    monkeypatch.setattr(order_minhash, "SMALL", 4)
    tables, written = [], Work.table
    monkeypatch.setattr(Work, "table", lambda self, df, keep=False: tables.append(written(self, df, keep)) or tables[-1])
    monkeypatch.setattr(Work, "drop", lambda self: None)
    rng, base = np.random.default_rng(3), [f"w{i}" for i in range(60)]
    texts = []
    for i in range(60):  # 50 near copies, then 10 texts that share half of their words
        w = list(base) if i < 50 else base[:30] + [f"o{i}x{j}" for j in range(30)]
        for j in rng.choice(30 if i >= 50 else 60, 4, replace=False):
            w[j] = f"e{rng.integers(0, 6)}"
        texts.append(" ".join(w))
    got = {r.doc_id: r.class_id for r in order_minhash.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert {got[i] for i in range(50)} == {0} and all(got[i] == i for i in range(50, 60))
    rows = [t for t in tables if "before" in t.columns]
    assert rows and all(t.select("tid").distinct().count() <= 10 for t in rows)


def test_frequent_cells_keep_their_order(spark):
    lists = [[x] * n for x, n in ((1, 2), (2, 40_000), (3, 50_000))]
    found = order_minhash.histogram(spark.createDataFrame([(x,) for x in lists], "words array<bigint>"))
    assert found.dtype == np.uint16 and found[1] == 2 and 2 < found[2] < found[3]
