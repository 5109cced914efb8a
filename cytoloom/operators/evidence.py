"""Evidence about groups of cells: copy-number burden, embeddings, quotas, genomic windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cytoloom.functions.values import as_group, finite


def malignancy(cells: DataFrame, score: str, group: str, reference: str, category: str, quantile: float = 0.95) -> DataFrame:
    """Of each group: cells, mean score, its ratio to the reference cells' mean (null if that is missing or 0) and the share of cells
    above the reference's quantile. The reference statistics are one row."""
    v = finite(F.col(score))
    ref = cells.where(F.col(reference) == category).agg(F.avg(v).alias("ref_mean"), F.percentile(v, F.lit(quantile)).alias("ref_q"))
    df = cells.select(as_group(F.col(group)).alias("grp"), v.alias("v")).join(F.broadcast(ref))
    out = df.groupBy("grp").agg(F.count("*").alias("n_cells"), F.avg("v").alias("mean_score"), F.first("ref_mean").alias("m"), F.avg((F.col("v") > F.col("ref_q")).cast("double")).alias("share_above"))
    return out.select("grp", "n_cells", "mean_score", F.when(F.col("m") != 0, F.col("mean_score") / F.col("m")).alias("ratio"), "share_above")


def running_mean(x: DataFrame, by: list[str], order: list[str], value: str, half: int) -> DataFrame:
    """Adds the mean of a value over `half` rows before and after, within each of `by`, as a profile along the genome needs."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-half, half)
    return x.withColumn(f"{value}_mean", F.avg(value).over(w))


def quota(cells: DataFrame, label: str, key: str, total: int, seed: int = 0) -> DataFrame:
    """An exact stratified sample: of each label min(n, max(1, round(total * n / all))) rows, by the order of a hash of key and seed."""
    size = cells.groupBy(label).agg(F.count("*").alias("_n"))
    size = size.join(F.broadcast(size.agg(F.sum("_n").alias("_all"))))
    take = F.least(F.col("_n"), F.greatest(F.lit(1), F.floor(F.lit(total) * F.col("_n") / F.col("_all") + 0.5)))
    size = size.select(F.col(label).alias("_label"), take.alias("_take"))
    place = F.row_number().over(Window.partitionBy(label).orderBy(F.xxhash64(F.col(key), F.lit(seed)), key))
    return cells.withColumn("_p", place).join(size, F.col(label).eqNullSafe(F.col("_label"))).where("_p <= _take").drop("_p", "_label", "_take")


def centroids(vectors: DataFrame, label: str = "label", vec: str = "embedding") -> DataFrame:
    """Mean vector of each label: positions are summed apart, so that the sums combine before the shuffle."""
    each = vectors.select(label, F.posexplode(vec).alias("i", "x")).groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return each.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"))


def centroid_distances(vectors: DataFrame, label: str = "label", vec: str = "embedding") -> DataFrame:
    """Mean squared distance of each label's vectors to its centroid; labels are few, so centroids stay small and AQE broadcasts them."""
    c = centroids(vectors, label, vec).withColumnRenamed(label, "_label")
    df = vectors.join(c, F.col(label) == F.col("_label"))
    d = F.aggregate(F.zip_with(F.col(vec), F.col("centroid"), lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x)
    return df.withColumn("_d", d).groupBy(label).agg(F.count("*").alias("n"), F.avg("_d").alias("mean_sq_dist"))


def principal_scores(vectors: DataFrame, k: int, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """id and scores: the k leading principal components of centred vectors, each signed so that its largest loading is above 0. Only the
    covariance of the dimensions reaches the driver. Vectors must be finite and of one length; null ones take no part."""
    import numpy as np
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.where(F.col(key).isNotNull() & F.col(vec).isNotNull()).select(F.col(key).alias("id"), array_to_vector(F.col(vec).cast("array<double>")).alias("v"))
    model = PCA(k=k, inputCol="v", outputCol="p").fit(rows)
    load = model.pc.toArray()
    sign = np.sign(load[np.abs(load).argmax(0), np.arange(k)])
    raw = model.transform(rows).select("id", vector_to_array("p").alias("p"))
    mean = raw.agg(*[F.avg(F.col("p")[i]) for i in range(k)]).first()
    return raw.select("id", F.array(*[(F.col("p")[i] - F.lit(float(mean[i]))) * F.lit(float(sign[i])) for i in range(k)]).alias("scores"))
