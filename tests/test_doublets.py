"""Doublet scores on planted doublets, and the parts they are made of."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoloom.operators import doublets
from cytoloom.sources.scratch import Scratch


@pytest.fixture(scope="module")
def planted(spark):
    """Sample a: 150 cells of three programs and 15 sums of two of them; b: the same with other cells; c: 20 cells."""
    rng = np.random.default_rng(11)
    programs = rng.gamma(0.3, 4, size=(3, 60)) + 0.05
    cells, rows, both = [], [], set()
    for sample, n, extra in (("a", 150, 15), ("b", 120, 12), ("c", 20, 0)):
        one = [rng.poisson(programs[i % 3] * 4) for i in range(n)]
        two = [rng.poisson(programs[i % 3] * 4) + rng.poisson(programs[(i + 1) % 3] * 4) for i in range(extra)]
        for k, v in enumerate(one + two):
            cid = len(cells)
            both |= {cid} if k >= n else set()
            cells.append((cid, sample if sample != "b" else None))
            rows += [(cid, f"g{j:02d}", float(v[j])) for j in np.flatnonzero(v).tolist()]
    return both, spark.createDataFrame(rows, "cell_id long, gene string, cnt double").repartition(4), spark.createDataFrame(cells, "cell_id long, sample string")


def test_planted_doublets_are_separated(planted):
    both, counts, cells = planted
    got, skipped = doublets.scores(counts, cells.union(cells.limit(3)), "sample", components=8)
    rows = got.collect()
    assert len(rows) == 317 and all((r.doublet_score is None) == (r["sample"] == "c") for r in rows)
    for sample in ("a", "nan"):
        high = [r.doublet_score for r in rows if r["sample"] == sample and r.cell_id in both]
        low = [r.doublet_score for r in rows if r["sample"] == sample and r.cell_id not in both]
        assert np.mean([x > y for x in high for y in low]) > 0.95
    called = {r.cell_id for r in rows if r.predicted_doublet}
    told = {r["sample"]: r.reason for r in skipped.collect()}
    assert told["c"] == "too_few_cells" and set(told) <= {"a", "nan", "c"}
    assert not called or len(called & both) >= 0.7 * len(called)


def test_placed_and_simulated(spark):
    cells = spark.createDataFrame([(i, "s" if i < 500 else "t") for i in range(530)], "cell_id long, sample string")
    ranks = doublets.placed(cells, "sample", bucket=16)
    assert sorted(r.r for r in ranks.where("sample = 's'").collect()) == list(range(500)) and sorted(r.r for r in ranks.where("sample = 't'").collect()) == list(range(30))
    counts = cells.select("cell_id", F.lit("g").alias("gene"), F.pow(F.lit(2.0), F.col("cell_id") % 40).alias("cnt")).union(cells.select("cell_id", F.lit("n"), F.lit(1.0)))
    made = doublets.simulated(counts, ranks, ratio=2)
    each = made.where("gene = 'n'").groupBy("sample").agg(F.count("*").alias("k"), F.min("cnt").alias("low"), F.max("cnt").alias("high")).collect()
    assert {(r["sample"], r.k, r.low, r.high) for r in each} == {("s", 1000, 2.0, 2.0), ("t", 60, 2.0, 2.0)}
    assert made.where("gene = 'g'").agg(F.sum("cnt")).first()[0] == 4 * counts.where("gene = 'g'").agg(F.sum("cnt")).first()[0]


def test_shares_equal_a_plain_search(spark, monkeypatch):
    monkeypatch.setattr(doublets, "PART", 20)
    x = np.random.default_rng(1).normal(size=(90, 3))
    points = spark.createDataFrame([("s", i, i >= 30, 30, v.tolist()) for i, v in enumerate(x)], "sample string, id long, sim boolean, n long, v array<double>")
    far = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(far, np.inf)
    k = 9  # half the root of 30, rounded, times 3
    want = {i: int((np.argsort(far[i])[:k] >= 30).sum()) for i in range(90)}
    got = {r.id: (r.k, r.doublets) for r in doublets.neighbour_shares(points, 2, Scratch(spark)).collect()}
    assert got == {i: (k, d) for i, d in want.items()}


def test_valley():
    two = np.concatenate([np.exp(-((np.arange(128) - 40) ** 2) / 200), np.exp(-((np.arange(128) - 80) ** 2) / 200)]) * 100
    assert 80 < doublets.valley(two) < 180
    assert doublets.valley(np.exp(-((np.arange(256) - 90) ** 2) / 900)) is None and doublets.valley(np.zeros(256)) is None


def test_no_cells(planted):
    _, counts, cells = planted
    got, skipped = doublets.scores(counts, cells.where("false"), "sample")
    assert got.collect() == [] == skipped.collect()


def test_pairs_of_cells_are_not_sent_whole(spark):
    """Two rows a cell and turn come from the ranks, whose estimated size is small: they are merged with the counts, not broadcast."""
    ranks = spark.range(40).selectExpr("'s' AS sample", "id AS cell_id", "40L AS n", "id AS r")
    counts = spark.range(40).selectExpr("id AS cell_id", "'g' AS gene", "1.0D AS cnt")
    made = doublets.simulated(counts, ranks)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan and made.agg({"cnt": "sum"}).first()[0] == 160.0
