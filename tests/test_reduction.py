"""Principal components of sparse counts against a dense decomposition."""

import numpy as np
import pytest

from cytoloom.operators import reduction


def dense(x, k):
    centred = x - x.mean(0)
    u, s, v = np.linalg.svd(centred, full_matrices=False)
    v = v[:k] * np.where(v[np.arange(k), np.abs(v[:k]).argmax(1)] < 0, -1, 1)[:, None]
    return v.T, centred @ v.T, s[:k] ** 2 / (len(x) - 1), (centred**2).sum() / (len(x) - 1)


def long_table(spark, x, parts=7):
    rows = [(int(i), f"g{j:03d}", float(x[i, j])) for i, j in zip(*np.nonzero(x))]
    cells = spark.createDataFrame([(i,) for i in range(len(x))], "cell_id long")
    genes = spark.createDataFrame([(f"g{j:03d}", j) for j in range(x.shape[1])], "gene string, place int")
    return spark.createDataFrame(rows, "cell_id long, gene string, v double").repartition(parts), cells, genes


@pytest.mark.parametrize("k", [1, 6])
def test_components_equal_a_dense_decomposition(spark, k):
    rng = np.random.default_rng(3)
    low = rng.gamma(1, 2, size=(300, 8)) @ rng.gamma(0.5, 1, size=(8, 90))
    x = np.log1p(rng.poisson(low * 0.2))
    x[17] = 0  # a cell without counts
    df, cells, genes = long_table(spark, x)
    model = reduction.components(df, genes, cells, k)
    load, score, variance, total = dense(x, k)
    assert model.settled and np.allclose(model.loadings, load, atol=1e-6) and np.allclose(model.variance, variance) and np.isclose(model.total, total)
    got = {r.cell_id: r.scores for r in reduction.scores(df, cells, model).collect()}
    assert np.allclose([got[i] for i in range(300)], score, atol=1e-6)
    assert abs(model.ratio.sum() - variance.sum() / total) < 1e-9


def test_components_take_only_given_genes_and_cells(spark):
    rng = np.random.default_rng(1)
    x = rng.poisson(1.0, size=(60, 20)).astype(float)
    df, cells, genes = long_table(spark, x)
    some, few = genes.where("place % 2 = 0"), cells.where("cell_id < 40")
    model = reduction.components(df, some.union(some), few.union(few), 50)
    load, _, variance, _ = dense(x[:40, ::2], 9)
    assert model.loadings.shape == (10, 9) and np.allclose(model.variance, variance, atol=1e-8) and np.allclose(model.loadings, load, atol=1e-6)


def test_components_of_odd_tables(spark):
    df, cells, genes = long_table(spark, np.ones((5, 3)))
    flat = reduction.components(df, genes, cells, 2)
    assert np.allclose(flat.variance, 0) and flat.ratio.tolist() == [0, 0]
    assert len(reduction.scores(df, cells, flat).collect()) == 5
    empty = reduction.components(df.where("false"), genes, cells.where("false"), 2)
    assert empty.loadings.shape == (3, 1) and empty.total == 0
    assert reduction.components(df, genes.where("false"), cells, 2).genes == []
    odd = df.selectExpr("cell_id", "gene", "v", "1 AS at", "2 AS row").union(spark.createDataFrame([(None, "g000", 5.0, 1, 2), (1, None, 5.0, 1, 2), (2, "g001", None, 1, 2)], "cell_id long, gene string, v double, at int, row int"))
    assert np.allclose(reduction.components(odd, genes, cells, 2).mean, 1)
    with pytest.raises(ValueError):
        reduction.packed(df, genes, most=2)
