"""What doublet scores send between tasks: packed cells and points, no distances, and counts that are made once."""

import numpy as np
import pytest

from cytoloom.operators import doublets
from cytoloom.sources.scratch import Scratch


@pytest.mark.parametrize("part", [15, 1 << 18])
def test_shares_of_many_places_send_no_distances(spark, monkeypatch, part):
    """Places in groups of two at most, and groups in one task or several: the k nearest of the two nearest places, as in a plain search."""
    for name, value in (("PLACE", 16), ("GROUP", 2), ("PART", part), ("HELD", 256)):
        monkeypatch.setattr(doublets, name, value)
    x = np.random.default_rng(5).normal(size=(150, 3)).astype("f4").astype(float)
    points = spark.createDataFrame([("s", i, i >= 50, 50, v.tolist()) for i, v in enumerate(x)], "sample string, id long, sim boolean, n long, v array<double>")
    shares = doublets.neighbour_shares(points, 2, Scratch(spark))
    plan = shares._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "binary" not in plan
    (_, c), k = doublets._centers(points, 0)["s"], 12  # half the root of 50, rounded, times 3
    near = np.argsort(((x[:, None] - c[None]) ** 2).sum(2), axis=1)[:, :2]
    want = {}
    for i in range(150):
        others = np.array([j for j in range(150) if j != i and near[j, 0] in near[i]])
        best = others[np.argsort(((x[others] - x[i]) ** 2).sum(1))[:k]]
        want[i] = (min(k, len(others)), int((best >= 50).sum()))
    assert len(c) > 4 and {r.id: (r.k, r.doublets) for r in shares.collect()} == want


def test_ties_dont_depend_on_the_order_of_rows():
    y = np.zeros((40, 2))
    order = np.random.default_rng(0).permutation(40)
    got = doublets._nearest_sims(y[:1], np.array([0]), y, 20, order, 10)
    rest = [i for i in np.argsort(order).tolist() if i != 0][:10]
    assert got.tolist() == [sum(i >= 20 for i in rest)]


def test_counts_are_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    def told(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    rng = np.random.default_rng(2)
    rows = [(c, f"g{g}", float(n)) for c in range(60) for g, n in enumerate(rng.poisson(2, 12)) if n]
    counts = spark.createDataFrame(rows, "cell_id long, gene string, cnt double").mapInArrow(told, "cell_id long, gene string, cnt double")
    cells = spark.range(62).selectExpr("id AS cell_id", "'s' AS sample")
    got, _ = doublets.scores(counts, cells, "sample", components=4)
    assert got.where("doublet_score IS NOT NULL").count() == 62 and read.value == len(rows)


def test_packed_doublets_equal_simulated_ones(spark):
    """The same pairs, counts and normalisation as the long form; totals are of all genes."""
    rng = np.random.default_rng(3)
    counts = spark.createDataFrame([(c, f"g{g}", float(n)) for c in range(40) for g, n in enumerate(rng.poisson(1, 8)) if n], "cell_id long, gene string, cnt double")
    ranks = doublets.placed(spark.range(41).selectExpr("id AS cell_id", "'s' AS sample"), "sample")
    names = [f"g{g}" for g in range(6)]
    held = doublets.packed_cells(counts, ranks, names)
    got = {(r.sim, names[a]): v for r in doublets.packed_doublets(held, 3, 6).collect() for a, v in zip(r["at"], r.v)}
    long = {(r.sim, r.gene): r.cnt for r in doublets.simulated(counts, ranks, 3).collect()}
    total = {}
    for (s, _), n in long.items():
        total[s] = total.get(s, 0) + n
    want = {(s, g): np.log1p(n / total[s] * 1e4) for (s, g), n in long.items() if g in names}
    assert got.keys() == want.keys() and all(abs(got[e] - want[e]) < 1e-9 for e in want)
