"""Variable genes and gene-set scores over counts, and the small tables that choices between samples, labels and embeddings rest on."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytoloom.functions.values import as_group, finite, median


def smooth(x: np.ndarray, y: np.ndarray, span: float = 0.3, knots: int = 512) -> np.ndarray:
    """Local quadratic regression of y on x with tricube weights of the nearest `span` of points (Cleveland 1979), solved at up to `knots`
    quantiles of x and linear in between."""
    near = min(len(x), max(4, int(np.ceil(span * len(x)))))
    at = np.unique(np.quantile(x, np.linspace(0, 1, knots))) if len(x) > knots else np.unique(x)
    fit = np.empty(len(at))
    for i, centre in enumerate(at):
        far = np.abs(x - centre)
        reach = max(np.partition(far, near - 1)[near - 1], 1e-12)
        root = np.sqrt(np.clip(1 - (far / (reach * (1 + 1e-9))) ** 3, 0, None) ** 3)
        u = (x - centre) / reach
        fit[i] = np.linalg.lstsq(np.stack([root, root * u, root * u * u], axis=1), root * y, rcond=1e-10)[0][0]
    return np.interp(x, at, fit)


def variable_genes(counts: DataFrame, cells: DataFrame, top: int = 2000, batch: str | None = None) -> DataFrame:
    """(gene, place, median_rank, n_batches, score): the `top` genes whose counts vary most for their mean (Stuart et al. 2019).

    In each batch a gene's variance, with the zeros that counts leaves out, is compared with the one a smooth curve expects at its mean:
    counts are cut off at mean + sqrt(cells) standard deviations, and the rest is scaled by the expected deviation. Genes are ranked in each
    batch (ties by name, from 0); those under `top` somewhere are put in order by the median of such ranks and then by the number of batches
    they have one in; score is the mean over all batches, one without the gene counting 0. Null batches are one batch; a batch of one cell
    says nothing. The curve is fitted for one batch at a time, over a row for each gene."""
    cells = cells.select("cell_id", (as_group(F.col(batch)) if batch else F.lit("all")).alias("_batch"))
    size = cells.groupBy("_batch").agg(F.count("*").cast("double").alias("_n")).where("_n > 1")
    rows = counts.select("cell_id", "gene", F.col("cnt").cast("double").alias("cnt")).join(cells, "cell_id")
    stats = rows.groupBy("_batch", "gene").agg(F.sum("cnt").alias("s"), F.sum(F.col("cnt") * F.col("cnt")).alias("q")).join(F.broadcast(size), "_batch")
    mean = F.col("s") / F.col("_n")
    stats = stats.select("_batch", "gene", "_n", mean.alias("mean"), ((F.col("q") - F.col("_n") * mean * mean) / (F.col("_n") - 1)).alias("var")).where("mean > 0 AND var > 0")

    def expected(one: pd.DataFrame) -> pd.DataFrame:
        one["sd"] = np.sqrt(10 ** smooth(np.log10(one["mean"].to_numpy()), np.log10(one["var"].to_numpy())))
        return one[["_batch", "gene", "_n", "mean", "sd"]]

    told = stats.groupBy("_batch").applyInPandas(expected, "_batch string, gene string, _n double, mean double, sd double")
    cut = F.least(F.col("cnt"), F.col("mean") + F.sqrt("_n") * F.col("sd"))
    sums = rows.join(told, ["_batch", "gene"]).groupBy("_batch", "gene").agg(F.first("_n").alias("n"), F.first("mean").alias("m"), F.first("sd").alias("sd"), F.sum(cut).alias("s"), F.sum(cut * cut).alias("q"))
    score = (F.col("n") * F.col("m") * F.col("m") + F.col("q") - 2 * F.col("m") * F.col("s")) / ((F.col("n") - 1) * F.col("sd") * F.col("sd"))
    ranked = sums.select("_batch", "gene", score.alias("score")).withColumn("rank", F.row_number().over(Window.partitionBy("_batch").orderBy(F.desc("score"), "gene")) - 1)
    good = F.col("rank") < top
    each = ranked.groupBy("gene").agg(F.percentile(F.when(good, F.col("rank")), F.lit(0.5)).alias("median_rank"), F.count_if(good).alias("n_batches"), F.sum("score").alias("_s"))
    best = each.where("n_batches > 0").join(F.broadcast(size.agg(F.count("*").alias("_k")))).withColumn("score", F.col("_s") / F.col("_k")).orderBy("median_rank", F.desc("n_batches"), "gene").limit(top)
    place = F.row_number().over(Window.orderBy("median_rank", F.desc("n_batches"), "gene")) - 1
    return best.select("gene", place.alias("place"), "median_rank", "n_batches", "score")


def set_scores(x: DataFrame, cells: DataFrame, genes: Sequence[str], bins: int = 25) -> DataFrame:
    """(cell_id, score) of every cell: the mean of v over the genes less that over control genes (Tirosh et al. 2016), zeros included; x:
    cell_id, gene, v. Controls are, for each of the `bins` equal parts of genes by mean that holds one of the set, its first
    min(50, max(10, 5 * genes)) others by the md5 of their names. Genes that x doesn't have don't count; without any the score is null, and
    without controls their mean is 0."""
    total = x.groupBy("gene").agg(F.sum("v").alias("s"))
    part = total.select("gene", F.col("gene").isin(*genes).alias("own"), F.ntile(bins).over(Window.orderBy(F.round("s", 6), "gene")).alias("part"))
    held = part.groupBy("part").agg(F.max("own").alias("_any")).where("_any").select("part")
    size = min(50, max(10, 5 * len(set(genes))))
    others = part.where("NOT own").join(held, "part").withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy(F.md5(F.col("gene").cast("binary"))))).where(F.col("k") <= size)
    used = part.where("own").select("gene", "own").union(others.select("gene", "own"))
    many = used.agg(F.count_if("own").alias("_own"), F.count_if(~F.col("own")).alias("_other"))
    sums = x.join(used, "gene").groupBy("cell_id").agg(F.sum(F.when(F.col("own"), F.col("v"))).alias("_a"), F.sum(F.when(~F.col("own"), F.col("v"))).alias("_b"))
    mean = lambda s, n: F.try_divide(F.coalesce(s, F.lit(0.0)), F.col(n))
    return cells.select("cell_id").join(sums, "cell_id", "left").join(F.broadcast(many)).select("cell_id", (mean("_a", "_own") - F.coalesce(mean("_b", "_other"), F.lit(0.0))).alias("score"))


def doublet_rates(cells: DataFrame, sample: str, doublet: Column, score: str) -> DataFrame:
    """A row for each sample and one, of the null sample, for all: n_cells, n_scored and rate, the share of doublets among all cells of a
    sample and among the scored ones of all. A null `doublet` counts as none; the rate is null without cells that count."""
    hit = F.coalesce(doublet, F.lit(False)).cast("int")
    scored = finite(F.col(score)).isNotNull()
    rows = cells.select(as_group(F.col(sample)).alias("sample"), hit.alias("hit"), scored.alias("scored"))
    each = rows.groupBy("sample").agg(F.count("*").alias("n_cells"), F.count_if("scored").alias("n_scored"), F.avg("hit").alias("rate"))
    whole = rows.agg(F.lit(None).cast("string").alias("sample"), F.count("*").alias("n_cells"), F.count_if("scored").alias("n_scored"), F.avg(F.when(F.col("scored"), F.col("hit"))).alias("rate"))
    return each.union(whole)


def spread(table: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """A row for each metric: the least, median and most of its finite values over a table of samples; null without any."""
    long = table.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), finite(F.col(m).cast("double")).alias("v")) for m in metrics])).alias("x")).select("x.*")
    return long.groupBy("metric").agg(F.min("v").alias("low"), median(F.col("v")).alias("mid"), F.max("v").alias("high"))


def label_support(table: DataFrame) -> DataFrame:
    """For table(cluster, label, support): each label of two or more clusters with its least and most support and their difference. Null
    labels and supports don't count."""
    each = table.where("label IS NOT NULL").groupBy("label").agg(F.count_distinct("cluster").alias("n_clusters"), F.min("support").alias("support_min"), F.max("support").alias("support_max"))
    return each.where("n_clusters >= 2").withColumn("support_spread", F.round(F.col("support_max") - F.col("support_min"), 3))


def over_corrected(table: DataFrame) -> DataFrame:
    """The embeddings of table(embedding, batch_score, bio_score) that alone mix batches best and alone keep least of the biology; none where
    there is one row. The table has a row for each embedding, so one task ranks it; rows without both scores aren't ranked."""
    rows = table.where(finite(F.col("batch_score")).isNotNull() & finite(F.col("bio_score")).isNotNull())
    told = rows.agg(F.max("batch_score").alias("_top"), F.min("bio_score").alias("_low"), F.count("*").alias("_n"))
    met = rows.join(F.broadcast(told)).withColumns({"_best": F.col("batch_score") == F.col("_top"), "_worst": F.col("bio_score") == F.col("_low")})
    found = met.where("_n > 1").agg(F.count_if("_best").alias("b"), F.count_if("_worst").alias("w"), F.max(F.when(F.col("_best") & F.col("_worst"), F.col("embedding"))).alias("embedding"))
    return found.where("b = 1 AND w = 1 AND embedding IS NOT NULL").select("embedding")


def _chance(a: float, b: float, total: float) -> float:
    """The information, in nats, that two labels of a and b of `total` rows share by chance: over the hypergeometric distribution of the rows
    they have in common, up to 40 standard deviations from its mean, beyond which nothing is left."""
    mean, sd = a * b / total, np.sqrt(a * b / total * (1 - a / total) * (1 - b / total) + 1)
    low, high = max(0.0, a + b - total, np.floor(mean - 40 * sd)), min(a, b, np.ceil(mean + 40 * sd))
    k = np.arange(low, high + 1)
    step = np.log((a - k[:-1]) * (b - k[:-1])) - np.log((k[:-1] + 1) * (total - a - b + k[:-1] + 1))
    log = np.concatenate([[0.0], np.cumsum(step)])
    p = np.exp(log - log.max())
    k1 = np.maximum(k, 1)
    return float((p / p.sum() * k / total * np.log(total * k1 / (a * b))).sum())


def adjusted_mutual(table: DataFrame) -> DataFrame:
    """One row, ami: the adjusted mutual information (Vinh et al. 2010; mean of both entropies) of a confusion table ref, pred, n. 1 if both
    sides have one class or there is no row. The table has a row for a pair of labels; Spark counts the rows, the driver gets the pairs."""
    t = table.groupBy("ref", "pred").agg(F.sum("n").cast("double").alias("n")).where("n > 0").toPandas()
    a, b, total = t.groupby("ref", dropna=False)["n"].sum(), t.groupby("pred", dropna=False)["n"].sum(), float(t["n"].sum())
    value = 1.0
    if len(a) != 1 or len(b) != 1:
        if len(t):
            rows = t["n"] * total / (t.groupby("ref", dropna=False)["n"].transform("sum") * t.groupby("pred", dropna=False)["n"].transform("sum"))
            mutual = float((t["n"] / total * np.log(rows)).sum())
            entropy = sum(-float((s / total * np.log(s / total)).sum()) for s in (a, b)) / 2
            sizes, others = a.value_counts(), b.value_counts()  # labels of one size have one expectation
            chance = sum(_chance(x, y, total) * i * j for x, i in sizes.items() for y, j in others.items())
            value = (mutual - chance) / (entropy - chance) if abs(entropy - chance) > 1e-12 else 0.0
    return table.sparkSession.createDataFrame([(float(value),)], "ami double")
