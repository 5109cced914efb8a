"""Copy-number profiles: expression against reference cells, smoothed along chromosomes, and what burden cells and groups carry."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoloom.functions.values import as_group, finite
from cytoloom.operators import evidence, graph, neighbours
from cytoloom.operators.reduction import MOST_GENES, packed
from cytoloom.sources.scratch import Scratch

#: Bytes of the dense block of cells by genes that a task has at a time.
BLOCK_BYTES = 1 << 25


@dataclass
class Windows:
    """Windows along the genome: genes in order, for each chromosome its first gene, number of genes and window width, and for each window its
    chromosome and first gene."""

    genes: list[str]
    chromosomes: list[tuple[str, int, int, int]]
    step: int

    @property
    def named(self) -> list[tuple[str, str]]:
        return [(name, self.genes[first + at]) for name, first, many, width in self.chromosomes for at in range(0, many - width + 1, self.step)]

    def smooth(self, x: np.ndarray) -> np.ndarray:
        """Weighted means of rows of genes in each window, the middle genes counting most (weights 1, 2, ... 2, 1)."""
        out = []
        for _, first, many, width in self.chromosomes:
            a = (width + 1) // 2
            part = x[:, first : first + many]
            for box in (a, width + 1 - a):  # two boxes one after the other make such weights
                total = np.cumsum(np.pad(part, ((0, 0), (1, 0))), axis=1)
                part = total[:, box:] - total[:, :-box]
            out.append(part[:, :: self.step] / (a * (width + 1 - a)))
        return np.concatenate(out, axis=1) if out else np.empty((len(x), 0))


def windows(positions: DataFrame, genes: DataFrame, window: int = 100, step: int = 10, exclude: Sequence[str] = ("chrX", "chrY")) -> Windows:
    """The windows of `window` genes, every `step` genes, of each chromosome; one of fewer genes has one window of all. positions: gene,
    chromosome, start; a gene with several places is at the first by name. Genes that `genes` (gene) lacks, without a place or on excluded
    chromosomes take no part. At most MOST_GENES genes, one row each, reach the driver."""
    known = positions.where("gene IS NOT NULL AND chromosome IS NOT NULL AND start IS NOT NULL").where(~F.col("chromosome").isin(*exclude))
    one = known.groupBy("gene").agg(F.min(F.struct("chromosome", "start")).alias("p")).join(genes.select("gene").distinct(), "gene", "left_semi")
    rows = one.orderBy("p.chromosome", "p.start", "gene").limit(MOST_GENES + 1).collect()
    if len(rows) > MOST_GENES:
        raise ValueError(f"more than {MOST_GENES} genes with places")
    found, at = [], 0
    for name in dict.fromkeys(r.p.chromosome for r in rows):
        many = sum(r.p.chromosome == name for r in rows)
        found.append((name, at, many, min(window, many)))
        at += many
    return Windows([r.gene for r in rows], found, step)


def reference_means(x: DataFrame, cells: DataFrame, genes: Sequence[str], reference: str | None, categories: Sequence[str]) -> np.ndarray:
    """The mean of each gene, zeros included, in each reference category that has cells (a row each), or over all cells without a reference."""
    given = reference is not None and len(categories) > 0
    known = cells.where("cell_id IS NOT NULL").select("cell_id", (as_group(F.col(reference)) if given else F.lit("all")).alias("of")).dropDuplicates(["cell_id"])
    known = known.where(F.col("of").isin(*map(str, categories))) if given else known
    size = {r["of"]: r["count"] for r in known.groupBy("of").count().collect()}
    if given and set(size) != set(map(str, categories)):
        raise ValueError(f"no cells of reference {sorted(set(map(str, categories)) - set(size))}")
    place, row = {g: i for i, g in enumerate(genes)}, {c: i for i, c in enumerate(sorted(size))}
    out = np.zeros((max(1, len(row)), len(genes)))
    if genes:
        few = x.sparkSession.createDataFrame([(g,) for g in genes], "gene string")
        for r in x.select("cell_id", "gene", "v").join(F.broadcast(few), "gene").join(known, "cell_id").groupBy("of", "gene").agg(F.sum("v").alias("s")).collect():
            out[row[r["of"]], place[r.gene]] = r.s / size[r["of"]]
    return out


def profiles(x: DataFrame, cells: DataFrame, along: Windows, reference: str | None = None, categories: Sequence[str] = (), clip: float = 3.0, noise: float = 1.5) -> DataFrame:
    """(cell_id, profile): a value for each window of every cell, 0 as the reference.

    x: cell_id, gene, v (log-normalised, zeros left out). Values between the lowest and highest mean of the reference categories are 0,
    others what they are beyond; these are cut off at `clip`, smoothed (see Windows), less the cell's median; what is under `noise` standard
    deviations of all cells' values is 0. Without a reference the mean of all cells stands for it: advice only. A missing category raises.
    Cells are taken from `cells`, once each; one without counts has zeros everywhere, null ids are left out. A task has some cells' genes as a
    dense block at a time; the driver sees sums."""
    spark, g = x.sparkSession, len(along.genes)
    means = reference_means(x, cells, along.genes, reference, categories)
    low, high = means.min(0), means.max(0)
    known = cells.select("cell_id").where("cell_id IS NOT NULL").distinct()
    rows, names = packed(x.join(known, "cell_id", "left_semi"), spark.createDataFrame([(n,) for n in along.genes], "gene string"))
    place = {n: i for i, n in enumerate(along.genes)}
    to = np.array([place[n] for n in names], dtype=np.int64)
    every = known.join(rows, "cell_id", "left").select("cell_id", F.coalesce("at", F.array().cast("array<int>")).alias("at"), F.coalesce("v", F.array().cast("array<double>")).alias("v"))

    def smoothed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = max(1, BLOCK_BYTES // (8 * max(1, g)))
        for whole in batches:
            for begin in range(0, whole.num_rows, most):
                b = whole.slice(begin, most)
                at, v = b.column("at"), b.column("v")
                dense = np.zeros((b.num_rows, g))
                dense[np.repeat(np.arange(b.num_rows), np.diff(at.offsets.to_numpy())), to[at.flatten().to_numpy()]] = v.flatten().to_numpy()
                centred = np.clip(np.where(dense > high, dense - high, np.where(dense < low, dense - low, 0.0)), -clip, clip)
                out = along.smooth(centred)
                out = out - np.median(out, axis=1, keepdims=True) if out.shape[1] else out
                ends = np.arange(len(out) + 1, dtype=np.int32) * out.shape[1]
                yield pa.RecordBatch.from_arrays([b.column("cell_id"), pa.ListArray.from_arrays(ends, out.ravel())], names=["cell_id", "profile"])

    kind = every.schema["cell_id"].dataType.simpleString()
    made = Scratch(spark).table(every.mapInArrow(smoothed, f"cell_id {kind}, profile array<double>"), keep=True)
    add = lambda of: F.sum(F.aggregate(F.transform("profile", of), F.lit(0.0), lambda s, y: s + y))
    told = made.agg(F.sum(F.size("profile")).alias("n"), add(lambda y: y).alias("s"), add(lambda y: y * y).alias("q")).first()
    least = noise * float(np.sqrt(max(0.0, told.q / told.n - (told.s / told.n) ** 2))) if told.n else 0.0
    return made.select("cell_id", F.transform("profile", lambda y: F.when(F.abs(y) < least, 0.0).otherwise(y)).alias("profile"))


def burden(made: DataFrame) -> DataFrame:
    """(cell_id, cnv_score): the mean of the profile's absolute values, null without windows."""
    total = F.aggregate(F.transform("profile", lambda y: F.abs(y)), F.lit(0.0), lambda s, y: s + y)
    return made.select("cell_id", F.try_divide(total, F.size("profile")).alias("cnv_score"))


def group_burden(scores: DataFrame, cells: DataFrame, group: str) -> DataFrame:
    """(grp, n_cells, mean_cnv_score) of each group of cells, scores that are missing not counting in the mean."""
    known = cells.select("cell_id", as_group(F.col(group)).alias("grp"))
    return known.join(scores, "cell_id", "left").groupBy("grp").agg(F.count("*").alias("n_cells"), F.avg(finite(F.col("cnv_score"))).alias("mean_cnv_score"))


def contrast(scores: DataFrame, cells: DataFrame, reference: str, categories: Sequence[str]) -> DataFrame:
    """One row: reference_mean_cnv, nonreference_mean_cnv (null without such cells) and n_reference."""
    own = as_group(F.col(reference)).isin(*map(str, categories))
    df = cells.select("cell_id", own.alias("own")).join(scores, "cell_id")
    mean = lambda c: F.avg(F.when(c, finite(F.col("cnv_score"))))
    return df.agg(mean(F.col("own")).alias("reference_mean_cnv"), mean(~F.col("own")).alias("nonreference_mean_cnv"), F.count_if("own").alias("n_reference"))


def suggested_reference(groups: DataFrame, least: int = 50, top: int = 3) -> DataFrame:
    """(place, grp): the `top` groups of `least` cells or more of the lowest mean burden, ties by name: likely normal cells, for a run
    without a reference. groups: see group_burden."""
    best = groups.where((F.col("n_cells") >= least) & F.col("mean_cnv_score").isNotNull()).orderBy("mean_cnv_score", "grp").limit(top)
    return best.agg(F.array_sort(F.collect_list(F.struct("mean_cnv_score", "grp"))).alias("g")).select(F.posexplode("g.grp").alias("place", "grp"))


def clusters(made: DataFrame, resolution: float = 1.0, k: int = 50, near: int = 15, seed: int = 0) -> DataFrame:
    """(cell_id, cnv_cluster): communities of cells by principal components of their profiles. cell_id must be a whole number."""
    width = made.agg(F.max(F.size("profile"))).first()[0] or 0
    reduced = evidence.principal_scores(made, max(1, min(k, width)), "cell_id", "profile")
    edges = graph.weights(neighbours.knn(reduced, near - 1, "id", "scores"))
    return graph.communities(edges, resolution, seed=seed).select(F.col("id").alias("cell_id"), F.col("community").alias("cnv_cluster"))
