"""One-against-the-rest marker statistics on sparse values: x(cell_id, gene, v) without zeros, groups(cell_id, grp)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _sizes(groups: DataFrame) -> DataFrame:
    """Cells of each group, and of all: as many rows as groups."""
    size = groups.groupBy("grp").agg(F.count("*").cast("double").alias("n_g"))
    return size.join(F.broadcast(size.agg(F.sum("n_g").alias("n"))))


def counted(x: DataFrame, groups: DataFrame) -> DataFrame:
    """gene, v, grp and c, the number of the group's cells that have the value: what both statistics below are made of."""
    return x.join(groups, "cell_id").groupBy("gene", "v", "grp").agg(F.count("*").cast("double").alias("c"))


def rank_sum(x: DataFrame | None, groups: DataFrame, many: DataFrame | None = None) -> DataFrame:
    """z of the rank-sum test, a row for each gene and group, without continuity or tie correction.

    Zeros are never made: they are one block of ties below all values. Equal values of a gene are counted by group before they are
    ranked, so a gene that all cells have costs as many rows in one task as it has different values. Values must be above 0. Where one
    group has all cells z is null. many: `counted` of x, where it is at hand; x isn't read then.
    """
    size = _sizes(groups)
    many = counted(x, groups) if many is None else many
    upto = F.sum("c").over(Window.partitionBy("gene").orderBy("v").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = many.withColumns({"upto": upto, "t": F.sum("c").over(Window.partitionBy("gene", "v"))})  # equal values together; one shuffle and sort by gene
    ranked = ranked.withColumn("r", F.col("upto") - (F.col("t") - 1) / 2)  # mean rank among values above 0
    own = ranked.groupBy("gene", "grp").agg(F.sum(F.col("c") * F.col("r")).alias("s"), F.sum("c").alias("k_g"))
    held = F.collect_list(F.when(F.col("grp").isNotNull(), F.struct("grp", F.struct("s", "k_g"))))
    whole = own.groupBy("gene").agg(F.sum("k_g").alias("k"), F.map_from_entries(held).alias("of")).join(F.broadcast(size))  # genes without a value in a group too
    df = whole.withColumn("x", F.try_element_at("of", F.col("grp"))).select("gene", "grp", "n", "n_g", "k", F.coalesce("x.s", F.lit(0.0)).alias("s"), F.coalesce("x.k_g", F.lit(0.0)).alias("k_g"))
    n, n_g, k, k_g = (F.col(c) for c in ("n", "n_g", "k", "k_g"))
    ranks = (n_g - k_g) * (n - k + 1) / 2 + F.col("s") + (n - k) * k_g
    return df.select("gene", "grp", F.try_divide(ranks - n_g * (n + 1) / 2, F.sqrt(n_g * (n - n_g) * (n + 1) / 12)).alias("z"))


def fractions_and_change(x: DataFrame | None, groups: DataFrame, epsilon: float = 1e-9, many: DataFrame | None = None) -> DataFrame:
    """Per gene and group: pct_in, pct_out (shares of cells with a value, in and out of the group), spec (their difference) and logfc,
    log2 of the ratio of the means turned back from log1p. Where one group has all cells, what compares it is null. many: as for `rank_sum`."""
    size = _sizes(groups)
    if many is None:
        own = x.join(groups, "cell_id").groupBy("gene", "grp").agg(F.sum("v").alias("s_g"), F.count_if(F.col("v") > 0).cast("double").alias("k_g"))
    else:
        own = many.groupBy("gene", "grp").agg(F.sum(F.col("v") * F.col("c")).alias("s_g"), F.sum(F.when(F.col("v") > 0, F.col("c")).otherwise(0.0)).alias("k_g"))
    whole = own.groupBy("gene").agg(F.sum("s_g").alias("s"), F.sum("k_g").alias("k")).join(F.broadcast(size))
    df = whole.join(own, ["gene", "grp"], "left").na.fill({"s_g": 0.0, "k_g": 0.0})
    rest = F.col("n") - F.col("n_g")
    p, q = F.col("k_g") / F.col("n_g"), F.try_divide(F.col("k") - F.col("k_g"), rest)
    change = F.log2(F.try_divide(F.expm1(F.col("s_g") / F.col("n_g")) + epsilon, F.expm1(F.try_divide(F.col("s") - F.col("s_g"), rest)) + epsilon))
    return df.select("gene", "grp", p.alias("pct_in"), q.alias("pct_out"), (p - q).alias("spec"), change.alias("logfc"))


def normal_p(z: Column) -> Column:
    """Two-sided normal tail; Spark has no erfc."""

    @F.pandas_udf("double")
    def tail(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None or v != v else math.erfc(abs(v) / math.sqrt(2)))

    return tail(z)


def bh(df: DataFrame, p: str, by: str) -> DataFrame:
    """Adds padj, Benjamini and Hochberg's adjusted p within each group of `by`; equal p have one value, a null or NaN p has none and
    doesn't count. Different values are counted before they are ranked, so a group costs one task no more than its different p."""
    v = F.when(~F.isnan(p), F.col(p))
    values = df.select(F.col(by).alias("_by"), v.alias("_p")).where("_p IS NOT NULL").groupBy("_by", "_p").agg(F.count("*").alias("_c"))
    w = Window.partitionBy("_by")
    upto = F.sum("_c").over(w.orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    values = values.withColumn("_r", upto).withColumn("_n", F.sum("_c").over(w))
    down = w.orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    values = values.withColumn("padj", F.least(F.lit(1.0), F.min(F.col("_p") * F.col("_n") / F.col("_r")).over(down)))
    return df.drop("padj").join(values.select("_by", "_p", "padj"), F.col(by).eqNullSafe(F.col("_by")) & (v == F.col("_p")), "left").drop("_by", "_p")


def top(df: DataFrame, by: str, score: str, n: int, tie: str = "gene") -> DataFrame:
    """The n highest of each group with their place, from 0; Spark limits the groups before it shuffles them."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.col(score).desc(), F.col(tie)))
    return df.withColumn("place", place - 1).where(F.col("place") < n)


def owners(df: DataFrame, score: str) -> DataFrame:
    """The group of the strongest score for each gene, ties to the smaller name."""
    best = F.row_number().over(Window.partitionBy("gene").orderBy(F.col(score).desc(), "grp"))
    return df.withColumn("_b", best).where("_b = 1").drop("_b")
