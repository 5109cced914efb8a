"""Copy-number profiles against a dense version and a planted amplification."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoloom.operators import copynumber


def dense(x, of, chromosomes, window, step, low, high, clip=3.0, noise=1.5):
    """x: cells by genes in order; chromosomes: (first, many)."""
    c = np.clip(np.where(x > high, x - high, np.where(x < low, x - low, 0)), -clip, clip)
    out = []
    for first, many in chromosomes:
        n = min(window, many)
        w = np.minimum(np.arange(1, n + 1), np.arange(n, 0, -1))
        out += [(c[:, first + s : first + s + n] * w).sum(1) / w.sum() for s in range(0, many - n + 1, step)]
    p = np.stack(out, 1)
    p = p - np.median(p, axis=1, keepdims=True)
    return np.where(np.abs(p) < noise * p.std(), 0, p)


@pytest.fixture(scope="module")
def planted(spark):
    """160 cells and three chromosomes of 70 genes; the first is amplified in the 80 tumour cells."""
    rng = np.random.default_rng(0)
    mean = np.ones((160, 210))
    mean[80:, :70] *= 3
    counts = rng.poisson(mean * rng.gamma(2, 1, 210))
    counts[3] = 0
    x = np.log1p(counts / np.maximum(counts.sum(1, keepdims=True), 1) * 1e3)
    rows = [(i, f"g{j:03d}", float(x[i, j])) for i, j in zip(*map(lambda a: a.tolist(), np.nonzero(x)))]
    cells = spark.createDataFrame([(i, "Normal" if i < 80 else "Tumor", ["a", "b"][i % 2] if i < 80 else "t") for i in range(160)], "cell_id long, condition string, kind string")
    places = spark.createDataFrame([(f"g{j:03d}", f"chr{j // 70 + 1}", 10 * j) for j in range(210)] + [("g000", "chr9", 1), ("zz", "chr1", 5), ("g001", "chrX", 1), (None, "chr1", 1), ("g002", None, 3)], "gene string, chromosome string, start long")
    return x, spark.createDataFrame(rows, "cell_id long, gene string, v double").repartition(5), cells, places


@pytest.mark.parametrize("window,step", [(20, 3), (101, 10)])
def test_profiles_equal_a_dense_version(planted, window, step):
    x, df, cells, places = planted
    along = copynumber.windows(places, df.select("gene"), window, step)
    assert along.genes == [f"g{j:03d}" for j in range(210)] and [c[:3] for c in along.chromosomes] == [("chr1", 0, 70), ("chr2", 70, 70), ("chr3", 140, 70)]
    for reference, categories, of in (("condition", ["Normal"], [range(80)]), ("kind", ["a", "b"], [range(0, 80, 2), range(1, 80, 2)]), (None, (), [range(160)])):
        means = np.stack([x[list(o)].mean(0) for o in of])
        got = {r.cell_id: r.profile for r in copynumber.profiles(df, cells, along, reference, categories).collect()}
        want = dense(x, None, [(0, 70), (70, 70), (140, 70)], window, step, means.min(0), means.max(0))
        assert np.allclose([got[i] for i in range(160)], want, atol=1e-9) and len(got[0]) == len(along.named)


def test_planted_amplification_is_found(planted):
    x, df, cells, places = planted
    along = copynumber.windows(places, df.select("gene"), 20, 5)
    made = copynumber.profiles(df, cells, along, "condition", ["Normal"])
    scores = copynumber.burden(made)
    row = copynumber.contrast(scores, cells, "condition", ["Normal"]).first()
    assert row.n_reference == 80 and row.nonreference_mean_cnv > 2 * row.reference_mean_cnv
    groups = copynumber.group_burden(scores, cells, "kind")
    assert {r.grp: r.n_cells for r in groups.collect()} == {"a": 40, "b": 40, "t": 80}
    assert [r.grp for r in copynumber.suggested_reference(groups, least=40, top=5).orderBy("place").collect()][-1] == "t"
    assert [r.grp for r in copynumber.suggested_reference(groups, least=41).collect()] == ["t"] and copynumber.suggested_reference(groups, least=99).collect() == []
    found = copynumber.clusters(made, 0.3, k=5, near=15).join(cells, "cell_id").groupBy("cnv_cluster").agg(F.count_distinct("condition").alias("n"), F.count("*").alias("k")).collect()
    assert sum(r.k for r in found if r.n == 1) >= 150


def test_profiles_of_odd_tables(planted):
    x, df, cells, places = planted
    along = copynumber.windows(places, df.select("gene"))
    with pytest.raises(ValueError):
        copynumber.profiles(df, cells, along, "condition", ["None"])
    assert copynumber.profiles(df, cells.where("false"), along).collect() == []
    none = copynumber.windows(places.where("false"), df.select("gene"))
    assert none.named == [] and {r.cnv_score for r in copynumber.burden(copynumber.profiles(df, cells, none)).collect()} == {None}
    more = cells.union(cells.where("cell_id = 0")).union(cells.where("cell_id = 0").withColumn("cell_id", F.lit(None).cast("long")))
    assert copynumber.profiles(df.withColumns({"at": F.lit(1), "of": F.lit(2), "profile": F.lit(3)}), more, along).count() == 160
