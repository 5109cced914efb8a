"""Checks of given labels against the markers they claim, their composition and the verdicts of a review."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoloom.functions.values import as_group

# The statuses of a verdict.
STATUSES = ("confirmed", "suspect", "refuted")


def marker_checks(claims: DataFrame, stats: DataFrame, min_in: float = 0.25, min_change: float = 1.0, max_out: float = 0.5, min_spec: float = 0.1, max_p: float = 0.05) -> DataFrame:
    """Adds fails to claims(grp, gene): what each claimed marker misses, joined by ";", "absent" if stats has no such row, "" if it holds.
    stats: grp, gene, pct_in, pct_out, logfc, spec and, where given, padj."""
    p = F.col("padj") if "padj" in stats.columns else F.lit(0.0)
    s = stats.withColumns({"_here": F.lit(True), "_p": p}).select("grp", "gene", "pct_in", "pct_out", "logfc", "spec", "_here", "_p")
    rules = ((F.col("pct_in") < min_in, "pct"), (F.col("logfc") < min_change, "lfc"), (F.col("_p") >= max_p, "pvalue"), (F.col("pct_out") > max_out, "pct_out"), (F.col("spec") < min_spec, "spec"))
    fails = F.array_join(F.array_compact(F.array(*[F.when(c, n) for c, n in rules])), ";")
    return claims.select("grp", "gene").distinct().join(s, ["grp", "gene"], "left").select("grp", "gene", F.when(F.col("_here"), fails).otherwise(F.lit("absent")).alias("fails"))


def flags(checks: DataFrame, composition: DataFrame) -> DataFrame:
    """Support (the share of claimed markers that hold, null without claims) and flags of each group, joined by ";" in a fixed order.
    composition: grp, sample_share, batch_share, doublet_share, med_mt and, where calls were made, malignant; those that are null raise no flag.
    A group called malignant is flagged where there is no column cnv_burden, or where its burden isn't above cnv_baseline."""
    support = checks.groupBy("grp").agg(F.count("*").alias("n_claimed"), F.count_if(F.col("fails") == "").alias("n_held"))
    df = composition.join(support, "grp", "left").withColumn("support", F.try_divide("n_held", "n_claimed"))
    # The names of flags.
    named = ((F.col("support") < 0.5, "weak_marker_support"), (F.col("sample_share") >= 0.8, "single_patient_dominant"), (F.col("batch_share") >= 0.8, "batch_dominant"), (F.col("doublet_share") >= 0.5, "doublet_dominated"), (F.col("med_mt") > 25, "high_mt"))
    if "malignant" in composition.columns:
        called = F.col("malignant")
        named += ((called & (F.col("cnv_burden") <= F.col("cnv_baseline")), "malignant_low_cnv_burden"),) if "cnv_burden" in composition.columns else ((called, "malignant_without_cnv"),)
    told = F.array_join(F.array_compact(F.array(*[F.when(c, n) for c, n in named])), ";")
    return df.select("grp", F.coalesce("n_claimed", F.lit(0)).alias("n_claimed"), "support", told.alias("flags"))


def granularity(labels: DataFrame, support: DataFrame) -> DataFrame:
    """Of each label: its clusters, whether they are more than one (redundant), and the spread of their support. labels: grp, label;
    support: grp, support. Clusters without support count in the first alone."""
    out = labels.join(support.select("grp", "support"), "grp", "left").groupBy("label").agg(F.count_distinct("grp").alias("n_clusters"), (F.max("support") - F.min("support")).alias("spread"))
    return out.select("label", "n_clusters", (F.col("n_clusters") > 1).alias("redundant"), "spread")


def collapse_ratio(labels: DataFrame) -> DataFrame:
    """One row: clusters, labels, and clusters for each label; 0 without labels."""
    n = labels.agg(F.count_distinct("grp").alias("n_clusters"), F.count_distinct("label").alias("n_labels"))
    return n.withColumn("ratio", F.coalesce(F.try_divide("n_clusters", "n_labels"), F.lit(0.0)))


def apply_verdicts(cells: DataFrame, group: str, verdicts: DataFrame) -> DataFrame:
    """Adds audit_status and audit_review from verdicts(grp, status, review), a row for each group at most. Groups without a verdict are
    confirmed; review is by default whether they aren't. A status that isn't in STATUSES raises."""
    bad = F.raise_error(F.concat(F.lit("unknown status: "), F.coalesce("status", F.lit("null"))))
    v = verdicts.select(F.col("grp").alias("_g"), F.when(F.col("status").isin(*STATUSES), F.col("status")).otherwise(bad).alias("_s"), F.col("review").alias("_r"))
    status = F.coalesce("_s", F.lit("confirmed"))
    df = cells.join(v, as_group(F.col(group)) == F.col("_g"), "left")
    return df.withColumns({"audit_status": status, "audit_review": F.coalesce("_r", status != "confirmed")}).drop("_g", "_s", "_r")


def evidence_of_decisions(decisions: DataFrame, runs: DataFrame) -> DataFrame:
    """decisions(decision, hash) with the run(hash, run, at) that was first to write that hash; decisions without one stay, used false."""
    first = runs.where("hash IS NOT NULL").groupBy("hash").agg(F.min(F.struct("at", "run")).alias("_f"))
    return decisions.join(first, "hash", "left").select("decision", "hash", F.col("_f.run").alias("run"), F.col("_f").isNotNull().alias("used"))
