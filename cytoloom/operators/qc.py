"""Quality control over a sparse count matrix: counts(cell_id, gene, cnt) without zeros, cells(cell_id, ...)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytoloom.functions.values import MAD_SCALE, as_group, finite, median, starts_with_any


def cell_metrics(cells: DataFrame, counts: DataFrame, families: Mapping[str, Sequence[str]]) -> DataFrame:
    """Adds total_counts, n_genes and pct_<family> to every cell. One shuffle of counts, pre-aggregated, on cell_id; a cell without
    counts gets 0, 0 and null."""
    sums = [F.sum(F.when(starts_with_any(F.col("gene"), p), F.col("cnt")).otherwise(0.0)).alias(f"_{k}") for k, p in families.items()]
    per = counts.groupBy("cell_id").agg(F.sum("cnt").alias("total_counts"), F.count_if(F.col("cnt") > 0).alias("n_genes"), *sums)
    df = cells.join(per, "cell_id", "left")
    pct = {f"pct_{k}": F.when(F.col("total_counts") > 0, 100 * F.col(f"_{k}") / F.col("total_counts")) for k in families}
    df = df.withColumns(pct).withColumns({"total_counts": F.coalesce("total_counts", F.lit(0.0)), "n_genes": F.coalesce("n_genes", F.lit(0))})
    return df.drop(*[f"_{k}" for k in families])


def gene_stats(counts: DataFrame, n_cells: DataFrame) -> DataFrame:
    """Per gene n_cells, mean and variance with the zeros that counts leaves out; n_cells: one row, one column n. The variance of one
    cell is null."""
    per = counts.groupBy("gene").agg(F.count_if(F.col("cnt") > 0).alias("n_cells"), F.sum("cnt").alias("s"), F.sum(F.col("cnt") * F.col("cnt")).alias("q"))
    n = F.col("n").cast("double")
    mean = F.col("s") / n
    return per.join(F.broadcast(n_cells)).select("gene", "n_cells", mean.alias("mean"), F.try_divide(F.col("q") - n * mean * mean, n - 1).alias("variance"))


def quantiles(df: DataFrame, metrics: Sequence[str], at: Sequence[float] = (0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0)) -> DataFrame:
    """A row for each metric: exact interpolated quantiles and the mean of its finite values."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), finite(F.col(m)).alias("value")) for m in metrics])).alias("x")).select("x.*")
    return long.groupBy("metric").agg(*[F.percentile("value", F.lit(q)).alias(f"q{round(100 * q):02d}") for q in at], F.avg("value").alias("mean"))


def mad_bounds(df: DataFrame, metric: str, by: str | None = None, n_mads: float = 5.0, log: bool = True) -> DataFrame:
    """Median and scaled median absolute deviation, with bounds n_mads from the median; on a log1p scale the bounds are turned back and
    the lower is at least 0. Per group of `by` if given."""
    v = finite(F.log1p(F.col(metric)) if log else F.col(metric))
    df = df.select(as_group(F.col(by)).alias("grp") if by else F.lit("all").alias("grp"), v.alias("v"))
    mid = df.groupBy("grp").agg(median(F.col("v")).alias("med"))
    mad = df.join(mid, "grp").groupBy("grp").agg(F.first("med").alias("med"), (median(F.abs(F.col("v") - F.col("med"))) * MAD_SCALE).alias("mad"))
    low, high = F.col("med") - n_mads * F.col("mad"), F.col("med") + n_mads * F.col("mad")
    back = (lambda c: F.expm1(c)) if log else (lambda c: c)
    return mad.select("grp", "med", "mad", F.greatest(back(low), F.lit(0.0)).alias("lower"), back(high).alias("upper"))


def keep_mask(min_genes: float = 200, max_pct_mt: float = 20.0, min_counts: float = 0, genes: str = "n_genes", mt: str = "pct_mt", total: str = "total_counts", score: str | None = None, max_score: float | None = None, doublet: str | None = None) -> Column:
    """Cells to keep. A cell without a doublet score is kept, one without a mitochondrial share isn't."""
    mask = (F.col(genes) >= min_genes) & (F.col(mt) <= max_pct_mt)
    if min_counts > 0:
        mask = mask & (F.col(total) >= min_counts)
    if score is not None and max_score is not None:
        mask = mask & (F.col(score).isNull() | (F.col(score) <= max_score))
    if doublet is not None:
        mask = mask & ~F.coalesce(F.col(doublet), F.lit(False))
    return F.coalesce(mask, F.lit(False))


def coexpressed(cells: DataFrame, counts: DataFrame, genes: Sequence[str], name: str = "mixed_lineage_flag") -> DataFrame:
    """Flags cells with counts of every one of the genes; the filter on genes reaches the scan."""
    hits = counts.where(F.col("gene").isin(*genes) & (F.col("cnt") > 0)).groupBy("cell_id").agg(F.count_distinct("gene").alias("_n"))
    return cells.join(hits, "cell_id", "left").withColumn(name, F.coalesce(F.col("_n") == len(set(genes)), F.lit(False))).drop("_n")


def common_genes(counts: DataFrame, min_cells: int) -> DataFrame:
    """counts of genes that at least min_cells cells have."""
    often = counts.where("cnt > 0").groupBy("gene").count().where(F.col("count") >= min_cells).select("gene")
    return counts.join(often, "gene", "left_semi")


def log_normalised(counts: DataFrame, target: float = 1e4) -> DataFrame:
    """Adds v = log1p(cnt / total of the cell * target); zeros stay left out, and cells of a total of 0 have 0."""
    total = counts.groupBy("cell_id").agg(F.sum("cnt").alias("_total"))
    return counts.join(total, "cell_id").withColumn("v", F.log1p(F.coalesce(F.try_divide("cnt", "_total"), F.lit(0.0)) * target)).drop("_total")


def sample_table(cells: DataFrame, sample: str, metrics: Sequence[str]) -> DataFrame:
    """Of each sample: cells, and the median of each metric's finite values (null without any)."""
    return cells.groupBy(as_group(F.col(sample)).alias("sample")).agg(F.count("*").alias("n_cells"), *[median(F.col(m)).alias(f"median_{m}") for m in metrics])
