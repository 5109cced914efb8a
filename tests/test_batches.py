"""Batch correction against a plain version with the same blocks, and the mix of batches it gives."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoloom.operators import batches, neighbours


def plain(z, batch, block, blocks, start, theta=2.0, sigma=0.1, penalty=1.0, rounds=8, turns=10, tolerance=1e-4):
    """One matrix, the assignments kept, a block after the other."""
    n, nb, k = len(z), batch.max() + 1, len(start)
    phi = np.eye(nb)[batch]
    share = phi.mean(0)

    def soft(c, y, w, at):
        r = np.exp(-2 * (1 - c[at] @ y.T) / sigma) * w.T[batch[at]]
        return r / r.sum(1, keepdims=True)

    now, y, w = z.copy(), start, [np.ones((k, nb))] * blocks
    before, history = None, []
    for _ in range(turns):
        c, last = batches.unit(now), None
        r = np.empty((n, k))
        for b in range(blocks):
            r[block == b] = soft(c, y, w[b], block == b)
        for _ in range(rounds):
            y = batches.unit(r.T @ c)
            for b in range(blocks):
                o = r[block != b].T @ phi[block != b]
                w[b] = ((np.outer(o.sum(1), share) + 1) / (o + 1)) ** theta
                r[block == b] = soft(c, y, w[b], block == b)
            o = r.T @ phi
            cost = (r * 2 * (1 - c @ y.T)).sum() + sigma * (r * np.log(r)).sum() + sigma * theta * (o * np.log((o + 1) / (np.outer(o.sum(1), share) + 1))).sum()
            if last is not None and abs(last - cost) <= tolerance * abs(last):
                break
            last = cost
        history.append(cost)
        now = z.copy()
        for i in range(k):
            moe = np.hstack([np.ones((n, 1)), phi])
            effect = np.linalg.solve(moe.T @ (moe * r[:, [i]]) + penalty * np.diag([0] + [1] * nb), moe.T @ (z * r[:, [i]]))
            effect[0] = 0
            now -= (moe @ effect) * r[:, [i]]
        if before is not None and abs(before - cost) <= tolerance * abs(before):
            break
        before = cost
    return now, history


@pytest.fixture(scope="module")
def shifted(spark):
    """Three kinds of cells in two batches, the second moved and unevenly mixed."""
    rng = np.random.default_rng(7)
    kind = rng.integers(3, size=240)
    batch = (rng.random(240) < np.array([0.3, 0.5, 0.6])[kind]).astype(int)
    z = 6 * np.eye(5)[kind] + rng.normal(size=(240, 5)) * 0.5 + np.outer(batch, [1.5, 1.0, -1.0, 2.0, 0.0])
    rows = [(i, v.tolist(), f"b{b}", str(k)) for i, (v, b, k) in enumerate(zip(z, batch, kind))]
    return z, batch, kind, spark.createDataFrame(rows, "vec_id long, embedding array<double>, batch string, kind string").repartition(5)


def test_equals_a_plain_version_and_mixes_batches(spark, shifted):
    z, batch, kind, df = shifted
    history, blocks, seed = [], 3, 0
    got = batches.corrected(df, "batch", blocks=blocks, turns=3, clusters=5, history=history)
    block = np.array([r[0] for r in spark.range(240).orderBy("id").select(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(blocks))).collect()])
    order = [r[0] for b in range(blocks) for r in spark.range(240).withColumn("b", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(blocks))).where(F.col("b") == b).orderBy(F.xxhash64("id", F.lit(seed + 1)), "id").collect()]
    start = batches.first_centers(batches.unit(z[order]), 5, seed)
    want, told = plain(z, batch, block, blocks, start, turns=3)
    rows = {r.id: r.corrected for r in got.collect()}
    assert np.allclose([rows[i] for i in range(240)], want, atol=1e-6) and np.allclose(history, told)
    mix = lambda v: neighbours.lisi(neighbours.knn(v, 20, "id", "v"), df.selectExpr("vec_id AS id", "batch AS label")).agg(F.avg("lisi")).first()[0]
    before, after = mix(df.selectExpr("vec_id AS id", "embedding AS v")), mix(got.selectExpr("id", "corrected AS v"))
    assert before < 1.2 and after > 1.6
    kept = neighbours.silhouettes(got.join(df.selectExpr("vec_id AS id", "kind"), "id").select("id", "corrected", "kind"), "kind", "id", "corrected").agg(F.avg("silhouette")).first()[0]
    assert kept > 0.5


def test_odd_tables(spark, shifted):
    _, _, _, df = shifted
    one = df.where("batch = 'b0'")
    assert {r.id: r.corrected for r in batches.corrected(one, "batch").collect()} == {r.vec_id: r.embedding for r in one.collect()}
    assert batches.corrected(df.where("false"), "batch").collect() == []
    more = df.selectExpr("vec_id", "embedding", "CASE WHEN batch = 'b0' THEN batch END AS batch", "1 AS b", "2 AS z", "3 AS id").union(
        spark.createDataFrame([(None, [1.0] * 5, "b0", 1, 2, 3), (900, None, "b0", 1, 2, 3), (901, [float("nan")] * 5, "b0", 1, 2, 3), (1, [1.0] * 5, "b0", 1, 2, 3)], "vec_id long, embedding array<double>, batch string, b int, z int, id int"))
    got = batches.corrected(more, "batch", turns=1, rounds=1, blocks=2)
    assert got.count() == 241 and got.where("id = 1").count() == 2


def test_ridge_takes_out_what_a_batch_adds():
    rng = np.random.default_rng(0)
    batch, z = np.repeat([0, 1], 50), rng.normal(size=(100, 2))
    z[50:] += [3, -2]
    phi = np.eye(2)[batch]
    effect = batches.ridge(phi.sum(0, keepdims=True), np.stack([phi.T @ z]), 1e-6)[0]
    assert np.allclose((z - effect[batch])[:50].mean(0), (z - effect[batch])[50:].mean(0), atol=1e-4)
