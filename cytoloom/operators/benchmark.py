"""Which embedding keeps kinds of cells apart and mixes their batches: the metrics, their totals and the best."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoloom.functions.values import as_group
from cytoloom.operators import evidence, graph, labels, neighbours
from cytoloom.operators.labels import ARTIFACTS
from cytoloom.sources.scratch import Scratch

#: The share of bio conservation in the total; batch correction has the rest.
BIO = 0.6


def mutual(pairs: DataFrame) -> DataFrame:
    """One row, nmi: the mutual information of pairs(a, b, n), counts of two labellings, over the mean of their entropies; 1 where both have one
    label, null without rows."""
    cells = pairs.where("n > 0")
    total = cells.agg(F.sum("n").cast("double").alias("m"))
    entropy = lambda by: cells.groupBy(by).agg(F.sum("n").alias("k")).crossJoin(F.broadcast(total)).agg((-F.sum(F.col("k") / F.col("m") * F.ln(F.col("k") / F.col("m")))).alias("h"))
    joint = cells.crossJoin(F.broadcast(total)).agg((-F.sum(F.col("n") / F.col("m") * F.ln(F.col("n") / F.col("m")))).alias("j"))
    row = joint.crossJoin(entropy("a").select(F.col("h").alias("ha"))).crossJoin(entropy("b").select(F.col("h").alias("hb")))  # a row each
    mean = (F.col("ha") + F.col("hb")) / 2
    return row.select(F.when(F.col("j").isNotNull(), F.when(mean <= 1e-12, 1.0).otherwise((F.col("ha") + F.col("hb") - F.col("j")) / mean)).alias("nmi"))


def connectivity(near: DataFrame, names: DataFrame, scratch: Scratch) -> DataFrame:
    """(label, n, share): of each label the share of its vectors in the largest part that neighbours of the same label connect. near: id,
    neighbour; names: id, label."""
    nodes = scratch.table(names.select("id", F.xxhash64("label").alias("comm"), "label"))
    ends = near.select(F.col("id").alias("a"), F.col("neighbour").alias("b"))
    both = scratch.table(ends.union(ends.select(F.col("b"), F.col("a"))).distinct())
    parts = graph.split(nodes.select("id", "comm"), both, scratch).join(nodes.select("id", "label"), "id")
    each = parts.groupBy("label", "comm").agg(F.count("*").alias("k"))
    return each.groupBy("label").agg(F.sum("k").alias("n"), (F.max("k") / F.sum("k")).alias("share"))


def batch_variance(vectors: DataFrame, batch: str, vec: str = "embedding") -> DataFrame:
    """One row, explained: the share of all variance of the vectors that their batches explain. This is the regression of all principal
    components on the batch, weighted by their variances, as both sums don't change when the axes are turned."""
    each = vectors.where(F.col(vec).isNotNull()).select(as_group(F.col(batch)).alias("of"), F.posexplode(vec).alias("i", "x")).select("of", "i", F.col("x").cast("double").alias("x"))
    sums = each.groupBy("of", "i").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    by = sums.groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    mean = F.col("s") * F.col("s") / F.col("n")
    return by.agg(F.sum(F.col("b") - mean).alias("between"), F.sum(F.col("q") - mean).alias("all")).select(F.when(F.col("all") > 0, F.col("between") / F.col("all")).alias("explained"))


def kept_cells(names: DataFrame, least: int = 10, drop: Sequence[str] = ARTIFACTS) -> DataFrame:
    """names(id, label, batch) without artifacts' labels and labels of fewer than `least` cells."""
    rows = names.select("id", as_group(F.col("label")).alias("label"), as_group(F.col("batch")).alias("batch")).where(~F.col("label").isin(*drop))
    return rows.join(rows.groupBy("label").count().where(F.col("count") >= least).select("label"), "label", "left_semi")


def compare(embeddings: Mapping[str, DataFrame], names: DataFrame, before: str | None = None, subsample: int | None = 60_000, near: int = 15, least: int = 10, seed: int = 0) -> DataFrame:
    """A row for each embedding(id, v): its metrics, bio_conservation, batch_correction and total, and whether it is the best, that of the highest
    total (ties to the name). names: id, label, batch; labels mustn't come from one of the embeddings.

    Bio conservation is the mean of silhouette_label (rescaled to 0 to 1), nmi and ari of communities with the labels, and clisi (1: neighbours
    of one label alone); batch correction that of silhouette_batch (1 - |silhouette| within labels), ilisi (1: all batches around a vector),
    graph_connectivity (mean share over labels) and, where `before` names the embedding without correction, pcr_comparison (the share of
    its batch variance that is gone). total: 0.6 and 0.4 of these (Luecken 2022).

    Vectors count that are in names and all embeddings, less artifacts and labels of under `least` cells; of more than `subsample` an exact
    stratified sample is taken. Fewer than two embeddings, or no cells left, raise."""
    if len(embeddings) < 2:
        raise ValueError(f"two embeddings or more are needed, not {sorted(embeddings)}")
    spark = names.sparkSession
    scratch = Scratch(spark)
    known = kept_cells(names, least)
    for e in embeddings.values():
        known = known.join(e.where("v IS NOT NULL").select("id").distinct(), "id", "left_semi")
    known = scratch.table(known, keep=True)
    n = known.count()
    if not n:
        raise ValueError("no cells left after labels are filtered")
    if subsample is not None and n > subsample:
        known = scratch.table(evidence.quota(known, "label", "id", subsample, seed), keep=True)
    n_labels, n_batches = (known.select(c).distinct().count() for c in ("label", "batch"))
    out = []
    for name in sorted(embeddings):
        v = scratch.table(embeddings[name].select("id", "v").join(known, "id"), keep=True)
        around = scratch.table(neighbours.knn(v, near, "id", "v"), keep=True)
        mean = lambda df, c: df.agg(F.avg(c)).first()[0]
        by_label = mean(neighbours.silhouettes(v, "label", "id", "v"), "silhouette")
        # within labels: one label's batches at a time, as silhouettes compare what is in the table
        apart = []
        for r in known.select("label").distinct().orderBy("label").collect():
            own = scratch.table(v.where(F.col("label") == r.label), keep=True)
            if own.select("batch").distinct().count() > 1:
                apart.append(mean(neighbours.silhouettes(own, "batch", "id", "v").select((1 - F.abs("silhouette")).alias("s")), "s"))
        found = graph.communities(graph.weights(around), seed=seed)
        pairs = scratch.table(known.join(found, "id").groupBy(F.col("label").alias("a"), F.col("community").cast("string").alias("b")).agg(F.count("*").alias("n")))
        lisi = {c: mean(neighbours.lisi(around, known.select("id", F.col(c).alias("label"))), "lisi") for c in ("label", "batch")}
        metrics = {
            "silhouette_label": (by_label + 1) / 2, "nmi": mutual(pairs).first().nmi, "ari": labels.adjusted_rand(pairs.select(F.col("a").alias("ref"), F.col("b").alias("pred"), "n")).first().ari,
            "clisi": 1 - (lisi["label"] - 1) / max(1, n_labels - 1),
            "silhouette_batch": sum(apart) / len(apart) if apart else None, "ilisi": (lisi["batch"] - 1) / (n_batches - 1) if n_batches > 1 else None,
            "graph_connectivity": mean(connectivity(around, known, scratch), "share"), "explained": batch_variance(v, "batch", "v").first().explained,
        }
        out.append({"embedding": name, **metrics})
    base = next((r["explained"] for r in out if r["embedding"] == before), None)
    bio, batch = ("silhouette_label", "nmi", "ari", "clisi"), ("silhouette_batch", "ilisi", "graph_connectivity", "pcr_comparison")
    average = lambda r, of: (lambda x: sum(x) / len(x) if x else None)([r[c] for c in of if r[c] is not None])
    for r in out:
        explained = r.pop("explained")
        r["pcr_comparison"] = max(0.0, (base - explained) / base) if base and explained is not None else None
        r["bio_conservation"], r["batch_correction"] = average(r, bio), average(r, batch)
        r["total"] = BIO * r["bio_conservation"] + (1 - BIO) * r["batch_correction"]
    best = min(out, key=lambda r: (-r["total"], r["embedding"]))["embedding"]
    columns = [*bio, *batch, "bio_conservation", "batch_correction", "total"]
    rows = [(r["embedding"], *(None if r[c] is None else float(r[c]) for c in columns), r["embedding"] == best) for r in out]
    return spark.createDataFrame(rows, "embedding string, " + ", ".join(f"{c} double" for c in columns) + ", best boolean")
