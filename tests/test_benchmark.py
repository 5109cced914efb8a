"""The benchmark of embeddings: its metrics on small tables, its totals and its gates."""

import numpy as np
import pytest

from cytoloom.operators import benchmark
from cytoloom.sources.scratch import Scratch


def test_mutual_information(spark):
    read = lambda rows: benchmark.mutual(spark.createDataFrame(rows, "a string, b string, n long")).first().nmi
    assert abs(read([("x", "1", 10), ("y", "2", 20)]) - 1) < 1e-12 and abs(read([("x", "1", 10), ("x", "2", 10), ("y", "1", 10), ("y", "2", 10)])) < 1e-12
    assert read([("x", "1", 3)]) == 1 and read([]) is None


def test_connectivity(spark):
    names = spark.createDataFrame([(i, "a" if i < 6 else "b") for i in range(9)], "id long, label string")
    near = spark.createDataFrame([(0, 1), (1, 2), (3, 4), (5, 6), (6, 7), (7, 8), (8, 0)], "id long, neighbour long")
    got = {r.label: (r.n, round(r.share, 6)) for r in benchmark.connectivity(near, names, Scratch(spark)).collect()}
    assert got == {"a": (6, 0.5), "b": (3, 1.0)}


def test_batch_variance(spark):
    rng = np.random.default_rng(0)
    of, x = rng.integers(3, size=100), rng.normal(size=(100, 4))
    x[of == 1] += 2
    df = spark.createDataFrame([(f"b{b}", v.tolist()) for b, v in zip(of, x)], "batch string, embedding array<double>")
    fitted = np.stack([x[of == b].mean(0) for b in range(3)])[of]
    want = ((fitted - x.mean(0)) ** 2).sum() / ((x - x.mean(0)) ** 2).sum()
    assert abs(benchmark.batch_variance(df, "batch").first().explained - want) < 1e-12
    assert benchmark.batch_variance(df.limit(1), "batch").first().explained is None


def test_best_embedding(spark):
    """Three labels of 40 cells: one embedding parts them and mixes batches, the other parts batches."""
    rng = np.random.default_rng(1)
    label, batch = np.arange(120) % 3, rng.integers(2, size=120)
    good = 6 * np.eye(4)[label] + rng.normal(size=(120, 4)) * 0.5
    bad = 6 * np.eye(4)[batch] + np.eye(4)[label] + rng.normal(size=(120, 4))
    names = spark.createDataFrame([(i, f"t{k}", f"s{b}") for i, (k, b) in enumerate(zip(label.tolist(), batch.tolist()))] + [(500, "Doublet", "s0"), (501, "rare", "s1")], "id long, label string, batch string")
    emb = lambda x: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(500, [0.0] * 4), (501, [0.0] * 4), (900, [1.0] * 4)], "id long, v array<double>")
    rows = {r.embedding: r for r in benchmark.compare({"good": emb(good), "bad": emb(bad)}, names, before="bad", near=10).collect()}
    assert rows["good"].best and not rows["bad"].best and rows["good"].total > rows["bad"].total + 0.2
    assert rows["good"].nmi > 0.99 and rows["good"].graph_connectivity > 0.95 and rows["bad"].pcr_comparison == 0 and rows["good"].pcr_comparison > 0.9
    for r in rows.values():
        assert abs(r.total - 0.6 * r.bio_conservation - 0.4 * r.batch_correction) < 1e-12 and all(-1e-9 <= r[c] <= 1 + 1e-9 for c in ("nmi", "clisi", "ilisi", "silhouette_label", "silhouette_batch"))
    with pytest.raises(ValueError, match="two embeddings"):
        benchmark.compare({"good": emb(good)}, names)
    with pytest.raises(ValueError, match="no cells"):
        benchmark.compare({"good": emb(good), "bad": emb(bad)}, names.where("label = 'rare'"))
