"""Variable genes, set scores and small tables against brute force and results worked out by hand."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoloom.operators import selection


def long(spark, m):
    rows = [(i, f"g{j:03d}", float(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1]) if m[i, j]]
    return spark.createDataFrame(rows, "cell_id long, gene string, cnt double")


def test_smooth_keeps_a_parabola():
    x = np.random.default_rng(1).uniform(-2, 3, 900)
    assert np.abs(selection.smooth(x, 1 + 2 * x - x * x) - (1 + 2 * x - x * x)).max() < 1e-3
    assert np.allclose(selection.smooth(np.ones(5), np.full(5, 3.0)), 3)


@pytest.mark.parametrize("batched", [False, True])
def test_variable_genes(spark, batched):
    rng = np.random.default_rng(2)
    m = rng.poisson(rng.uniform(0.2, 8, 150), (80, 150)).astype(float)
    m[:, [3, 17, 44]] = rng.poisson(1.0, (80, 3)) * np.where(np.arange(80) < 40, 6, 1)[:, None]  # of a mean in the middle of all
    m[40:41, 5] = 500  # one cell's outlier is cut off
    batch = np.array(["x", "y"])[np.arange(80) % 2] if batched else np.array(["all"] * 80)
    cells = spark.createDataFrame([(i, str(b)) for i, b in enumerate(batch)], "cell_id long, b string")
    got = selection.variable_genes(long(spark, m), cells, 10, "b" if batched else None).orderBy("place").collect()
    ranks, score = [], np.zeros(150)
    for name in np.unique(batch):
        c = m[batch == name]
        n, mean, var = len(c), c.mean(0), c.var(0, ddof=1)
        sd = np.sqrt(10 ** selection.smooth(np.log10(mean), np.log10(var)))
        z = ((np.minimum(c, mean + np.sqrt(n) * sd) - mean) ** 2).sum(0) / ((n - 1) * sd**2)
        rank = np.empty(150)
        rank[np.lexsort((np.arange(150), -z))] = np.arange(150)
        ranks.append(np.where(rank < 10, rank, np.nan))
        score += z / len(np.unique(batch))
    ranks = np.array(ranks)
    order = sorted((np.nanmedian(r), -np.isfinite(r).sum(), g) for g, r in enumerate(ranks.T) if np.isfinite(r).any())[:10]
    assert [(r.gene, r.median_rank, r.n_batches) for r in got] == [(f"g{g:03d}", r, -k) for r, k, g in order]
    assert np.allclose([r.score for r in got], [score[g] for _, _, g in order])
    assert {"g003", "g017", "g044"} <= {r.gene for r in got}
    assert selection.variable_genes(long(spark, m).limit(0), cells, 10).count() == 0


def test_set_scores(spark):
    rng = np.random.default_rng(3)
    m = rng.poisson(1.0, (30, 100)).astype(float)
    m[:10, :4] += 9
    x, cells = long(spark, m).withColumnRenamed("cnt", "v"), spark.range(31).withColumnRenamed("id", "cell_id")
    got = {r.cell_id: r.score for r in selection.set_scores(x, cells, ["g000", "g001", "g002", "g003", "none"], 5).collect()}
    assert len(got) == 31 and got[30] == 0 and min(got[i] for i in range(10)) > 4 > max(got[i] for i in range(10, 30))
    assert all(r.score is None for r in selection.set_scores(x, cells, ["none"]).collect())


def test_small_tables(spark):
    cells = spark.createDataFrame([("a", 0.1, True), ("a", None, None), (None, float("nan"), False), ("b", 0.3, False)], "s string, v double, d boolean")
    got = {r["sample"]: tuple(r)[1:] for r in selection.doublet_rates(cells, "s", F.col("d"), "v").collect()}
    assert got == {"a": (2, 1, 0.5), "nan": (1, 0, 0.0), "b": (1, 1, 0.0), None: (4, 2, 0.5)}
    assert [tuple(r) for r in selection.spread(cells, ["v"]).collect()] == [("v", 0.1, 0.2, 0.3)]
    support = spark.createDataFrame([("1", "T", 0.9), ("2", "T", 0.25), ("3", "B", 0.5), ("4", None, 0.1)], "cluster string, label string, support double")
    assert [tuple(r) for r in selection.label_support(support).collect()] == [("T", 2, 0.25, 0.9, 0.65)]
    for rows, want in (([("p", 0.9, 0.1), ("q", 0.5, 0.5)], ["p"]), ([("p", 0.9, 0.1), ("q", 0.9, 0.5)], []), ([("p", 0.9, 0.6), ("q", 0.5, 0.5)], []), ([("p", 0.9, 0.1)], []), ([], [])):
        table = spark.createDataFrame(rows, "embedding string, batch_score double, bio_score double")
        assert [r.embedding for r in selection.over_corrected(table).collect()] == want


def test_adjusted_mutual(spark):
    """Chance taken over all orders of one side."""
    ref, pred = "aaabbcc", "xxyyyzz"

    def mutual(p):
        n = len(ref)
        return sum((k := sum(u == i and v == j for u, v in zip(ref, p))) and k / n * math.log(n * k / (ref.count(i) * pred.count(j))) for i in set(ref) for j in set(pred))

    orders = set(itertools.permutations(pred))
    chance = sum(mutual(p) for p in orders) / len(orders)
    entropy = sum(-sum(s.count(c) / 7 * math.log(s.count(c) / 7) for c in set(s)) for s in (ref, pred)) / 2
    table = spark.createDataFrame(list(zip(ref, pred)), "ref string, pred string").groupBy("ref", "pred").agg(F.count("*").alias("n"))
    assert abs(selection.adjusted_mutual(table).first().ami - (mutual(pred) - chance) / (entropy - chance)) < 1e-9
    assert selection.adjusted_mutual(table.limit(0)).first().ami == 1
    assert abs(selection.adjusted_mutual(table.withColumn("pred", F.col("ref")).groupBy("ref", "pred").agg(F.sum("n").alias("n"))).first().ami - 1) < 1e-12
