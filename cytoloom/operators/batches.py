"""Batch correction of an embedding: soft clusters that prefer mixed batches, and a ridge regression on the batch in each cluster."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoloom.functions.values import as_group
from cytoloom.operators.reduction import summed
from cytoloom.sources.scratch import Scratch

#: Batches at most, as sums of clusters by batches by dimensions go to the driver; rows of the sample that the first centers come from.
MOST_BATCHES, SAMPLE = 1000, 5000


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; zero rows stay."""
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


@dataclass
class Turn:
    """What the soft assignment of a block's rows depends on: centers (clusters by dimensions) and the weights of clusters by batches."""

    centers: np.ndarray
    weight: np.ndarray
    sigma: float

    def shares(self, z: np.ndarray, batch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of rows of length 1 the shares of the clusters, and the distances to their centers."""
        far = 2 * (1 - z @ self.centers.T)
        scale = -far / self.sigma
        r = np.exp(scale - scale.max(1, keepdims=True)) * self.weight.T[batch]
        return r / r.sum(1, keepdims=True), far

    def sums(self, z: np.ndarray, batch: np.ndarray, batches: int) -> np.ndarray:
        """Sums over rows: shares by cluster and batch, shares times rows, and the two terms of the objective, in one array."""
        k = len(self.centers)
        r, far = self.shares(z, batch)
        observed = np.zeros((k, batches))
        np.add.at(observed.T, batch, r)
        cost = np.array([(r * far).sum(), self.sigma * (r * np.log(np.maximum(r, 1e-300))).sum()])
        return np.concatenate([observed.ravel(), (r.T @ z).ravel(), cost])


def first_centers(z: np.ndarray, k: int, seed: int, rounds: int = 25) -> np.ndarray:
    """k-means of rows of length 1: centers far apart first, then moved to their rows' means."""
    rng = np.random.default_rng(seed)
    at = [int(rng.integers(len(z)))]
    far = np.full(len(z), np.inf)
    while len(at) < k:
        far = np.minimum(far, ((z - z[at[-1]]) ** 2).sum(1))
        total = far.sum()
        at.append(int(rng.choice(len(z), p=far / total)) if total > 0 else int(rng.integers(len(z))))
    centers = z[at]
    for _ in range(rounds):
        near = (z @ centers.T - (centers**2).sum(1) / 2).argmax(1)
        size = np.bincount(near, minlength=k)
        total = np.zeros_like(centers)
        np.add.at(total, near, z)
        centers = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centers)
    return unit(centers)


def ridge(observed: np.ndarray, total: np.ndarray, penalty: float) -> np.ndarray:
    """Of each cluster the effect of every batch (clusters by batches by dimensions): weighted ridge regression on the batch with a free
    intercept, which isn't part of the effect. observed: shares by cluster and batch; total: sums of shares times vectors by cluster and batch."""
    k, b = observed.shape
    out = np.zeros(total.shape)
    for i in range(k):
        a = np.zeros((b + 1, b + 1))
        a[0, 0] = observed[i].sum()
        a[0, 1:] = a[1:, 0] = observed[i]
        a[1:, 1:] = np.diag(observed[i] + penalty)
        if a[0, 0] > 1e-12:
            out[i] = np.linalg.solve(a, np.concatenate([total[i].sum(0, keepdims=True), total[i]]))[1:]
    return out


def _read(b: pa.RecordBatch, column: str) -> np.ndarray:
    return b.column(column).flatten().to_numpy().reshape(b.num_rows, -1)


def corrected(
    vectors: DataFrame, batch: str, key: str = "vec_id", vec: str = "embedding", clusters: int | None = None, theta: float = 2.0, sigma: float = 0.1, penalty: float = 1.0,
    blocks: int = 4, rounds: int = 8, turns: int = 10, tolerance: float = 1e-4, seed: int = 0, history: list[float] | None = None,
) -> DataFrame:
    """(id, corrected) of every vector: the embedding with the batches' effects taken out (Korsunsky 2019).

    Vectors of length 1 are softly assigned to clusters (by default one for 30, at most 100) with weights ((expected + 1) / (observed + 1)) **
    theta that favour clusters with few of a vector's batch; rows are dealt to `blocks` by a hash of their key, and a block's assignment
    follows from the centers and the other blocks' sums, so that assignments are never stored. After `rounds` at most, each cluster's batch
    effects come from a ridge regression, and the vectors are corrected by them as far as they belong to the cluster. This is repeated up to
    `turns` times or until the objective, which `history` gets, changes by less than `tolerance` of itself. First centers come from a hashed
    sample of about 5000 vectors. Sums of clusters by batches by dimensions are all that reaches the driver; a pass reads one block.

    Null batches are one batch; rows with a null key or a vector that isn't finite take no part; vectors must have one length. A key given
    several times gives as many rows. With fewer than two batches vectors stay as they are; more than 1000 batches raise."""
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession)
    rows = vectors.select(F.col(key).alias("id"), as_group(F.col(batch)).alias("of"), F.col(vec).cast("array<double>").alias("z"))
    whole = F.forall("z", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.coalesce(whole, F.lit(False)) & (F.size("z") > 0))
    names = sorted(r["of"] for r in rows.select("of").distinct().limit(MOST_BATCHES + 1).collect())
    if len(names) > MOST_BATCHES:
        raise ValueError(f"more than {MOST_BATCHES} batches")
    if len(names) < 2:
        return rows.select("id", F.col("z").alias("corrected"))
    place = F.broadcast(spark.createDataFrame([(n, i) for i, n in enumerate(names)], "of string, b int"))
    block = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(blocks)).cast("int")

    def stored(df: DataFrame) -> list[DataFrame]:
        """The rows of each block, in folders of their own, so that a pass over one reads no other."""
        path = f"{scratch.folder}/step/blocks-{scratch.made}"
        scratch.made += 1
        df.write.partitionBy("block").parquet(path)
        read = spark.read.parquet(path)
        return [read.where(F.col("block") == i).select("id", "b", "z", "now") for i in range(blocks)]

    kind = rows.schema["id"].dataType.simpleString()
    data = stored(rows.join(place, "of").select("id", "b", "z", F.col("z").alias("now"), block.alias("block")))
    size = _sizes(data)
    n, nb = sum(size.values()), len(names)
    share = np.array([size.get(i, 0) for i in range(nb)]) / n
    some = [r.now for d in data for r in d.where(F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, SAMPLE / n))).select("now").orderBy(F.xxhash64("id", F.lit(seed + 1)), "id").limit(2 * SAMPLE).collect()]
    k = max(1, min(100, round(n / 30))) if clusters is None else clusters
    some = unit(np.array(some if some else [r.now for r in data[0].unionByName(data[-1]).limit(1).collect()]))
    centers, dims = first_centers(some, min(k, len(some)), seed), some.shape[1]
    k = len(centers)

    def passed(df: DataFrame, turn: Turn) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        def of(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            out = np.zeros(k * nb + k * dims + 2)
            for b in batches:
                if b.num_rows:
                    out += turn.sums(unit(_read(b, "now")), b.column("b").to_numpy(), nb)
            return out

        got = summed(df, of)
        return got[: k * nb].reshape(k, nb), got[k * nb : -2].reshape(k, dims), got[-2:]

    used = [Turn(centers, np.ones((k, nb)), sigma)] * blocks
    told, before = [passed(d, t) for d, t in zip(data, used)], None
    for _ in range(turns):
        last = None
        for _ in range(rounds):
            centers = unit(sum(t[1] for t in told))
            for i, d in enumerate(data):
                others = sum(t[0] for j, t in enumerate(told) if j != i) + np.zeros((k, nb))
                weight = ((np.outer(others.sum(1), share) + 1) / (others + 1)) ** theta
                used[i] = Turn(centers, weight, sigma)
                told[i] = passed(d, used[i])
            observed = sum(t[0] for t in told)
            mixed = sigma * theta * (observed * np.log((observed + 1) / (np.outer(observed.sum(1), share) + 1))).sum()
            now = float(sum(t[2].sum() for t in told) + mixed)
            if last is not None and abs(last - now) <= tolerance * abs(last):
                break
            last = now
        if history is not None:
            history.append(now)

        def totals(batches: Iterator[pa.RecordBatch], turn: Turn) -> np.ndarray:
            out = np.zeros((nb, k, dims))
            for b in batches:
                of = b.column("b").to_numpy()
                r, z = turn.shares(unit(_read(b, "now")), of)[0] if b.num_rows else np.zeros((0, k)), _read(b, "z") if b.num_rows else np.zeros((0, dims))
                for j in np.unique(of):
                    out[j] += r[of == j].T @ z[of == j]
            return out.transpose(1, 0, 2).ravel()

        total = sum(summed(d, lambda batches, t=t: totals(batches, t)) for d, t in zip(data, used)).reshape(k, nb, dims)
        effect = ridge(observed, total, penalty)
        held = spark.sparkContext.broadcast(effect)

        def moved(batches: Iterator[pa.RecordBatch], turn: Turn) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    of = b.column("b").to_numpy()
                    r, z = turn.shares(unit(_read(b, "now")), of)[0], _read(b, "z").copy()
                    for j in np.unique(of):
                        z[of == j] -= r[of == j] @ held.value[:, j]
                    ends = np.arange(len(z) + 1, dtype=np.int32) * z.shape[1]
                    yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "b", "z")), pa.ListArray.from_arrays(ends, z.ravel())], names=["id", "b", "z", "now"])

        new = [d.mapInArrow(lambda batches, t=t: moved(batches, t), f"id {kind}, b int, z array<double>, now array<double>").withColumn("block", F.lit(i)) for i, (d, t) in enumerate(zip(data, used))]
        every = new[0]
        for more in new[1:]:
            every = every.unionByName(more)
        data = stored(every)
        told = [passed(d, t) for d, t in zip(data, used)]
        if before is not None and abs(before - now) <= tolerance * abs(before):
            break
        before = now
    out = data[0]
    for more in data[1:]:
        out = out.unionByName(more)
    out = scratch.table(out.select("id", F.col("now").alias("corrected")), keep=True)
    scratch.drop()
    return out


def _sizes(data: list[DataFrame]) -> dict[int, int]:
    out: dict[int, int] = {}
    for d in data:
        for r in d.groupBy("b").count().collect():
            out[r.b] = out.get(r.b, 0) + r["count"]
    return out
