"""Rules that turn marker evidence into labels: panels, review packets, fine labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytoloom.functions.values import as_group, finite, non_blank

# Labels and states of the rules.
LOW_QUALITY, MIXED, UNKNOWN, UNASSIGNED = "Low_quality", "Mixed/Artifact", "Unknown", "Unassigned"


def group_quality(cells: DataFrame, group: str, mt: str | None = None, genes: str | None = None, doublet: str | None = None) -> DataFrame:
    """grp, n_cells, median %mt, median genes and doublet share of each group, null for what isn't given; cells without a group are "nan"."""
    none = F.lit(None).cast("double")
    mid = lambda c: F.percentile(finite(F.col(c)), F.lit(0.5)) if c else none
    share = F.avg(F.coalesce(F.col(doublet).cast("boolean"), F.lit(False)).cast("double")) if doublet else none
    return cells.groupBy(as_group(F.col(group)).alias("grp")).agg(F.count("*").alias("n_cells"), mid(mt).alias("med_mt"), mid(genes).alias("med_genes"), share.alias("doublet_share"))


def _artifact(max_mt: float, min_genes: float, max_doublets: float) -> tuple[Column, Column, Column]:
    """High %mt, few genes, many doublets; a measure that is missing says nothing."""
    no = F.lit(False)
    return F.coalesce(F.col("med_mt") > max_mt, no), F.coalesce(F.col("med_genes") < min_genes, no), F.coalesce(F.col("doublet_share") >= max_doublets, no)


def panel_hits(significant: DataFrame, panels: DataFrame, groups: DataFrame, min_markers: int = 3) -> DataFrame:
    """Of each group and panel: hits and negatives (the panel's genes and counter-genes among the group's significant ones), adj (their
    difference), whether it is a candidate by hits and by adj, and the panel's size. significant: grp, gene; panels: panel, gene,
    negative; groups: grp. Groups and panels are few, so every pair of them has a row."""
    size = panels.groupBy("panel").agg(F.count_if(~F.col("negative")).alias("size"))
    met = significant.select("grp", "gene").distinct().join(panels, "gene").groupBy("grp", "panel").agg(F.count_if(~F.col("negative")).alias("hits"), F.count_if("negative").alias("negatives"))
    every = groups.select("grp").distinct().join(F.broadcast(size)).join(met, ["grp", "panel"], "left").na.fill({"hits": 0, "negatives": 0})
    every = every.withColumn("adj", F.col("hits") - F.col("negatives"))
    return every.withColumns({"candidate": F.col("hits") >= min_markers, "adjusted": (F.col("hits") >= min_markers) & (F.col("adj") >= min_markers)})


def panel_labels(
    hits: DataFrame, quality: DataFrame, max_mt: float = 25.0, min_genes: float = 300.0, max_doublets: float = 0.5,
    immune: Sequence[str] = (), other: Sequence[str] = (), immune_least: float = 0.2, other_most: float = 0.5, penalty: float = 0.7,
) -> DataFrame:
    """One label a group: Low_quality by %mt or genes, Mixed/Artifact by doublets or by two adjusted candidates, else the best candidate
    by adj, hits and name (raw ones only without adjusted ones), else Unknown. confidence: hits over the panel's size, 3 places.

    Where quality has pan_share, the share of a group's cells with a pan-immune gene, and panels are named as `immune` or `other`, `consistent`
    says whether a label from a panel agrees with it: an immune one needs immune_least, another one may have up to other_most. One that
    doesn't is kept, its confidence times `penalty`, for review. consistent is null where nothing was compared."""
    rank = F.struct((-F.col("adj")).alias("adj"), (-F.col("hits")).alias("hits"), "panel")
    one = lambda c: F.min_by(F.struct("panel", "hits", "size"), F.when(c, rank))
    best = hits.groupBy("grp").agg(F.count_if("adjusted").alias("n_adjusted"), F.count_if("candidate").alias("n_candidates"), one(F.col("adjusted")).alias("a"), one(F.col("candidate")).alias("c"))
    mt, few, doublets = _artifact(max_mt, min_genes, max_doublets)
    pick = F.when(F.col("n_adjusted") > 0, F.col("a")).when(F.col("n_candidates") > 0, F.col("c"))
    df = quality.join(best, "grp", "left").withColumn("_p", pick)
    conflict = F.coalesce(F.col("n_adjusted") >= 2, F.lit(False))
    label = F.when(mt | few, LOW_QUALITY).when(doublets | conflict, MIXED).otherwise(F.coalesce("_p.panel", F.lit(UNKNOWN)))
    confidence = F.coalesce(F.round(F.try_divide("_p.hits", "_p.size"), 3), F.lit(0.0))
    share = F.col("pan_share") if "pan_share" in quality.columns and (immune or other) else F.lit(None).cast("double")
    odd = (label.isin(*immune) & (share < immune_least)) | (label.isin(*other) & (share > other_most))
    consistent = F.when(share.isNotNull() & F.col("_p.panel").isNotNull() & ~label.isin(LOW_QUALITY, MIXED), ~odd)
    bad = F.coalesce(~consistent, F.lit(False))
    confidence = F.when(bad, F.round(confidence * penalty, 3)).otherwise(confidence)
    return df.select("grp", label.alias("label"), confidence.alias("confidence"), conflict.alias("conflict"), (label.isin(LOW_QUALITY, MIXED) | bad).alias("review"), consistent.alias("consistent"))


def panel_order(owned: DataFrame, family: Column, score: str) -> DataFrame:
    """Places of a panel's genes, from 0: families stay together, then groups, then falling score. owned: grp, gene and score of the few
    genes that are shown."""
    return owned.withColumn("family", family).withColumn("place", F.row_number().over(Window.orderBy("family", "grp", F.desc(score), "gene")) - 1)


def evidence_packet(quality: DataFrame, markers: DataFrame, min_cells: int = 20, min_specific: int = 3, max_mt: float = 25.0, min_genes: float = 300.0, max_doublets: float = 0.5, single: DataFrame | None = None) -> DataFrame:
    """Status of each group for a reviewer: artifact_suspected, review or clean, and the risks behind that status, joined by commas.

    quality: see group_quality; markers: grp, gene, specific, the significant genes; single: grp of those with one source. A group without
    significant genes stays, with none."""
    n = markers.groupBy("grp").agg(F.count("*").alias("n_significant"), F.count_if("specific").alias("n_specific"))
    df = quality.join(n, "grp", "left").na.fill({"n_significant": 0, "n_specific": 0})
    df = df.join(single.select("grp").distinct().withColumn("_one", F.lit(True)), "grp", "left") if single is not None else df.withColumn("_one", F.lit(False))
    mt, few, doublets = _artifact(max_mt, min_genes, max_doublets)
    one, small, thin = F.coalesce("_one", F.lit(False)), F.col("n_cells") < min_cells, F.col("n_specific") < min_specific
    # The names of risks and statuses.
    artifact = ((doublets, "doublet_dominated"), (mt | few, "low_quality_qc"))
    weak = ((one, "single_source"), (small, "tiny_cluster"), (thin, "few_specific_markers"))
    told = lambda named: F.array_join(F.array_compact(F.array(*[F.when(c, n) for c, n in named])), ",")
    status = F.when(mt | few | doublets, "artifact_suspected").when(one | small | thin, "review").otherwise("clean")
    risks = F.when(mt | few | doublets, told(artifact)).otherwise(told(weak))
    return df.select("grp", "n_cells", "n_significant", "n_specific", status.alias("status"), risks.alias("risks"))


def apply_fine(subs: DataFrame, min_cells: int = 20, min_evidence: int = 1) -> DataFrame:
    """Final labels of sub-clusters. subs: sub, n_cells, label, facs, n_evidence, compartment (label, facs, compartment may be null) and, if
    wanted, requested (a review asked for).

    Without a label: Unassigned, for review; under min_cells: the compartment's unresolved label (merged), for review; with a label but under
    min_evidence: for review. The first two lose their FACS label, others show it before the fine one. reasons: why, joined by commas."""
    fine, facs = non_blank(F.col("label")), non_blank(F.col("facs"))
    bare, tiny = fine.isNull(), F.col("n_cells") < min_cells
    fallback = F.coalesce(F.concat_ws("_", non_blank(F.col("compartment")), F.lit("unresolved")), F.lit("unresolved"))
    label = F.when(bare, UNASSIGNED).when(tiny, fallback).otherwise(fine)
    kept = F.when(~bare & ~tiny, facs)
    thin, merged = ~bare & (F.coalesce("n_evidence", F.lit(0)) < min_evidence), ~bare & tiny
    asked = F.coalesce("requested", F.lit(False)) if "requested" in subs.columns else F.lit(False)
    # The names of reasons.
    named = ((bare, "not_labeled"), (merged, f"below_merge_min_cells(<{min_cells})"), (thin, "insufficient_evidence"))
    reasons = F.array_join(F.array_compact(F.array(*[F.when(c, n) for c, n in named])), ",")
    review = bare | merged | thin | asked
    return subs.select("sub", label.alias("fine_label"), kept.alias("facs_label"), F.coalesce(kept, label).alias("shown"), review.alias("review"), merged.alias("merged"), reasons.alias("reasons"))
