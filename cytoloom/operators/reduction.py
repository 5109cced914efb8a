"""Principal components of sparse log-counts, never made dense: a block Krylov iteration whose products are sums over cells."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoloom.sources.scratch import Scratch

#: Genes at most: what the driver and a task hold is some panels of genes by components, however many cells there are.
MOST_GENES = 20_000
#: Columns of a panel beyond the components asked for; partial sums that one task adds up.
SPARE, FAN = 8, 64


@dataclass
class Components:
    """The leading principal components of cells by genes: `genes` in order, `loadings` (genes by components, each signed so that its largest
    is above 0), the genes' `mean`, each component's share `ratio` of all variance and whether the iteration has `settled`."""

    genes: list[str]
    loadings: np.ndarray
    mean: np.ndarray
    variance: np.ndarray
    total: float
    settled: bool

    @cached_property
    def ratio(self) -> np.ndarray:
        return self.variance / self.total if self.total > 0 else np.zeros(len(self.variance))


def named(genes: DataFrame, most: int = MOST_GENES) -> list[str]:
    """The genes by name."""
    names = [r[0] for r in genes.select("gene").where("gene IS NOT NULL").distinct().orderBy("gene").limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} genes; choose the variable ones first")
    return names


def packed(x: DataFrame, genes: DataFrame, most: int = MOST_GENES) -> tuple[DataFrame, list[str]]:
    """(cell_id, at, v): a row for each cell of x(cell_id, gene, v) that has one of the genes, with the genes' places and values; and the
    genes by name. A cell's row is no longer than the genes; repeated pairs of cell and gene are added up."""
    names = named(genes, most)
    place = F.broadcast(x.sparkSession.createDataFrame([(g, i) for i, g in enumerate(names)], "gene string, at int"))
    known = x.select("cell_id", "gene", F.col("v").cast("double").alias("v")).where("cell_id IS NOT NULL AND v IS NOT NULL")
    each = known.join(place, "gene").groupBy("cell_id", "at").agg(F.sum("v").alias("v"))
    rows = each.groupBy("cell_id").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("row"))
    return rows.select("cell_id", F.col("row.at").alias("at"), F.col("row.v").alias("v")), names


def _spread(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of packed rows: the row, the place and the value of each entry."""
    at, v = batch.column("at"), batch.column("v")
    return np.repeat(np.arange(batch.num_rows), np.diff(at.offsets.to_numpy())), at.flatten().to_numpy(), v.flatten().to_numpy()


def _projected(batch: pa.RecordBatch, panel: np.ndarray, step: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Row numbers, places and values of entries, some rows at a time, and these rows times the panel."""
    row, at, v = _spread(batch)
    cuts = np.searchsorted(row, np.arange(batch.num_rows + 1))
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(cuts, cuts[begin] + step, "right")) - 1)
        some = slice(cuts[begin], cuts[end])
        own = np.zeros((end - begin, panel.shape[1]))
        starts = cuts[begin:end] - cuts[begin]
        filled = np.flatnonzero(np.diff(cuts[begin : end + 1]))
        if len(filled):
            own[filled] = np.add.reduceat(panel[at[some]] * v[some, None], starts[filled], axis=0)
        yield row[some] - begin, at[some], v[some], own
        begin = end


def summed(rows: DataFrame, of: Callable[[Iterator[pa.RecordBatch]], np.ndarray]) -> np.ndarray:
    """The sum over all tasks of the array of doubles that each makes of its rows. Arrays are added by tasks, FAN at a time, until a single
    one reaches the driver."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([of(batches).astype("<f8").tobytes()], pa.binary())], names=["sum"])

    def added(key: tuple, told: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), "<f8") for x in told["sum"])
        return pa.table({"sum": pa.array([total.tobytes()], pa.binary())})

    parts, tasks = rows.mapInArrow(task, "sum binary"), max(1, rows.rdd.getNumPartitions())
    while tasks > 1:
        tasks = -(-tasks // FAN)
        parts = parts.groupBy((F.spark_partition_id() % tasks).alias("to")).applyInArrow(added, "sum binary")
    return np.frombuffer(parts.first()[0], "<f8")


def components(x: DataFrame, genes: DataFrame, cells: DataFrame, k: int = 50, tolerance: float = 1e-9, rounds: int = 40, seed: int = 0) -> Components:
    """The k leading principal components (at most genes - 1 and cells - 1, at least 1) of x(cell_id, gene, v), zeros left out, over the
    cells of `cells` (cell_id) and the genes of `genes` (gene), as `variable_genes` gives them.

    Rows aren't centred: with X'X q - n m (m'q) in place of the centred product, a pass over the cells turns a panel of genes by k + SPARE
    columns into the next one. The panels so far span the subspace (block Krylov, Musco & Musco 2015) whose best vectors are taken, until
    what these leave of their own products is under `tolerance` of the largest eigenvalue, or all genes are spanned. A pass sends one panel
    a task. Cells without a chosen gene count as zeros; null ids and values are left out; cells given twice count once. Without variance
    (no cells, one cell, constant genes) variances and loadings are 0."""
    scratch = Scratch(x.sparkSession)
    known = cells.select("cell_id").where("cell_id IS NOT NULL").distinct()
    rows, names = packed(x.join(known.hint("merge"), "cell_id", "left_semi"), genes)
    out = of_packed(scratch.table(rows), names, known.count(), k, tolerance, rounds, seed)
    scratch.drop()
    return out


def of_packed(rows: DataFrame, names: list[str], n: int, k: int, tolerance: float, rounds: int = 40, seed: int = 0) -> Components:
    """`components` of n cells by rows that are packed already, read once a pass."""
    spark, g = rows.sparkSession, len(names)
    k = max(1, min(k, g - 1, n - 1))
    if not g or n < 2:
        return Components(names, np.zeros((g, k)), np.zeros(g), np.zeros(k), 0.0, True)

    def moments(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros((2, g))
        for b in batches:
            _, at, v = _spread(b)
            out += np.stack([np.bincount(at, v, g), np.bincount(at, v * v, g)])
        return out.ravel()

    first, second = summed(rows, moments).reshape(2, g)
    mean = first / n
    total = float((second - n * mean**2).sum())

    def product(panel: np.ndarray) -> np.ndarray:
        held = spark.sparkContext.broadcast(panel)

        def partial(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            out = np.zeros(held.value.shape)
            for b in batches:
                for row, at, v, own in _projected(b, held.value):
                    order = np.argsort(at, kind="stable")
                    place, begin = np.unique(at[order], return_index=True)
                    if len(place):
                        out[place] += np.add.reduceat(own[row[order]] * v[order, None], begin, axis=0)
            return out.ravel()

        got = summed(rows, partial).reshape(panel.shape) - n * np.outer(mean, mean @ panel)
        held.destroy()
        return got

    width = min(g, k + SPARE)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(g, width)))[0]
    basis, image = np.empty((g, 0)), np.empty((g, 0))
    values, vectors, settled = np.zeros(k), np.zeros((g, k)), False
    for _ in range(rounds):
        w = product(q)
        basis, image = np.hstack([basis, q]), np.hstack([image, w])
        small = basis.T @ image
        theta, u = np.linalg.eigh((small + small.T) / 2)
        u, values = u[:, ::-1][:, :k], theta[::-1][:k]
        vectors = basis @ u
        left = np.linalg.norm(image @ u - vectors * values, axis=0)
        settled = basis.shape[1] == g or bool((left <= tolerance * max(values[0], 1e-300)).all())
        if settled:
            break
        for _ in range(2):  # twice, so that the new columns are orthogonal to rounding
            w = w - basis @ (basis.T @ w)
        q, r = np.linalg.qr(w)
        q = q[:, np.abs(np.diag(r)) > 1e-12 * max(values[0], 1e-300)][:, : g - basis.shape[1]]
        if not q.shape[1]:
            settled = True
            break
        q = np.linalg.qr(q - basis @ (basis.T @ q))[0]
    if values.shape[0] < k:
        values, vectors = np.pad(values, (0, k - len(values))), np.pad(vectors, ((0, 0), (0, k - vectors.shape[1])))
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(k)] < 0, -1.0, 1.0)
    return Components(names, vectors, mean, np.clip(values, 0, None) / (n - 1), max(total, 0.0) / (n - 1), settled)


def projected(rows: DataFrame, model: Components) -> DataFrame:
    """Packed rows with their scores in place of `at` and `v`: centred values times the loadings, other columns as they are."""
    held = rows.sparkSession.sparkContext.broadcast((model.loadings, model.mean @ model.loadings))
    kept = [c for c in rows.columns if c not in ("at", "v")]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load, shift = held.value
        for b in batches:
            own = np.concatenate([np.empty((0, load.shape[1])), *(p for *_, p in _projected(b, load))]) - shift
            ends = np.arange(len(own) + 1, dtype=np.int32) * load.shape[1]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.ListArray.from_arrays(ends, own.ravel())], names=[*kept, "scores"])

    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept]
    return rows.mapInArrow(project, ", ".join([*kinds, "scores array<double>"]))


def scores(x: DataFrame, cells: DataFrame, model: Components) -> DataFrame:
    """(cell_id, scores) of every cell: its centred values times the loadings; a cell without a chosen gene has that of a row of zeros.
    Repeated cells give one row, null ids none."""
    rows, _ = packed(x, x.sparkSession.createDataFrame([(g,) for g in model.genes], "gene string"))
    none = F.array(*[F.lit(-float(s)) for s in model.mean @ model.loadings])
    every = cells.select("cell_id").where("cell_id IS NOT NULL").distinct()
    return every.join(projected(rows, model).hint("merge"), "cell_id", "left").select("cell_id", F.coalesce("scores", none).alias("scores"))
