"""Label columns: votes, maps, finishing, merging, composition of groups, consistency."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cytoloom.functions.values import as_group, as_vote, finite, non_blank

# Labels that stand for artifacts; the reasons of a compartment plan stand in compartment_plan as they are to be given.
ARTIFACTS = ("Low_quality", "Doublet", "Doublet_Mixed", "Mixed/Artifact")


def majority_vote(df: DataFrame, keys: Sequence[str], out: str = "consensus", least: float = 0.5, ambiguous: str = "ambiguous") -> DataFrame:
    """Adds the label that most of the key columns give and its share of the valid votes; missing votes abstain. A tie, or a share
    not above `least`, is ambiguous. Within the row: no shuffle."""
    votes = F.array_compact(F.array(*[as_vote(F.col(k)) for k in keys]))
    df = df.withColumn("_v", votes)
    tally = F.transform(F.array_distinct("_v"), lambda x: F.struct(F.size(F.filter("_v", lambda y: y == x)).alias("n"), x.alias("label")))
    df = df.withColumn("_t", F.reverse(F.sort_array(tally)))
    share = F.when(F.size("_v") > 0, F.col("_t")[0]["n"] / F.size("_v")).otherwise(F.lit(0.0))
    alone = F.coalesce(F.try_element_at("_t", F.lit(2))["n"] < F.col("_t")[0]["n"], F.lit(True))
    won = (F.size("_v") > 0) & alone & (share > least)
    return df.withColumns({out: F.when(won, F.col("_t")[0]["label"]).otherwise(F.lit(ambiguous)), f"{out}_agreement": share}).drop("_v", "_t")


def pairwise_agreement(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """For each pair of label columns the rows where both voted and the share of them that agree; one pass over the rows."""
    pairs = [(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :]]
    each = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), as_vote(F.col(a)).alias("x"), as_vote(F.col(b)).alias("y")) for a, b in pairs]
    long = df.select(F.explode(F.array(*each)).alias("p")).select("p.*").groupBy("a", "b")
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    out = long.agg(F.count_if(both).alias("n"), F.count_if(both & (F.col("x") == F.col("y"))).alias("same"))
    return out.select("a", "b", "n", F.when(F.col("n") > 0, F.col("same") / F.col("n")).otherwise(F.lit(0.0)).alias("concordance"))


def apply_map(df: DataFrame, by: str, mapping: DataFrame, label: str, default: str = "Unassigned") -> DataFrame:
    """Adds `label` from mapping(grp, label): a row for each group, so the map is far smaller than the cells and AQE broadcasts it."""
    m = mapping.select(F.col("grp").alias("_grp"), F.col("label").alias("_label"))
    return df.join(m, as_group(F.col(by)) == F.col("_grp"), "left").withColumn(label, F.coalesce("_label", F.lit(default))).drop("_grp", "_label")


def apply_annotation(df: DataFrame, by: str, calls: DataFrame, label: str = "major_cell_type", default: str = "Unassigned") -> DataFrame:
    """Adds `label`, `label`_confidence, `label`_review_required and cell_state from calls(grp, label, confidence, review, state), a row for
    each group at most. Groups without a call, and null parts of one, get the default label, no confidence, no review and the state ""."""
    m = calls.select(F.col("grp").alias("_grp"), F.struct(*[F.col(c) for c in ("label", "confidence", "review", "state")]).alias("_call"))
    told = {label: F.coalesce("_call.label", F.lit(default)), f"{label}_confidence": finite(F.col("_call.confidence")), f"{label}_review_required": F.coalesce("_call.review", F.lit(False)), "cell_state": F.coalesce("_call.state", F.lit(""))}
    return df.join(m, as_group(F.col(by)) == F.col("_grp"), "left").withColumns(told).drop("_grp", "_call")


# The calls of malignancy.
CALLS = ("malignant", "non_malignant", "uncertain", "not_applicable")


def apply_malignancy(df: DataFrame, by: str, calls: DataFrame, key: str = "malignancy") -> DataFrame:
    """Adds `key`, cnv_status, `key`_review_required and `key`_confidence from calls(grp, label, review, confidence), a row for each group at
    most. Groups without a call are not_applicable; cnv_status is tumor for malignant ones and normal for all others. A malignant call is for
    review wherever the cells have no cnv_score column. A label that isn't in CALLS raises."""
    bad = F.raise_error(F.concat(F.lit("unknown call: "), F.coalesce("label", F.lit("null"))))
    m = calls.select(F.col("grp").alias("_grp"), F.when(F.col("label").isin(*CALLS), F.col("label")).otherwise(bad).alias("_label"), F.col("review").alias("_review"), F.col("confidence").alias("_confidence"))
    call = F.coalesce("_label", F.lit("not_applicable"))
    forced = F.lit("cnv_score" not in df.columns) & (call == "malignant")
    told = {key: call, "cnv_status": F.when(call == "malignant", "tumor").otherwise("normal"), f"{key}_review_required": F.coalesce("_review", F.lit(False)) | forced, f"{key}_confidence": finite(F.col("_confidence"))}
    return df.join(m, as_group(F.col(by)) == F.col("_grp"), "left").withColumns(told).drop("_grp", "_label", "_review", "_confidence")


def finalize(df: DataFrame, keys: Sequence[str], malignant: str = "malignancy", status: str = "cnv_status", out: str = "final_annotation", prefix: str = "Malignant", rename: Mapping[str, str] | None = None) -> DataFrame:
    """The first label of keys that isn't blank, with a prefix on cells whose `malignant` column says "malignant" or, where there is no such
    column, whose `status` says "tumor"; then renamed, prefix and all, where `rename` has the whole label."""
    label = F.coalesce(*[non_blank(F.col(k)) for k in keys], F.lit("Unassigned"))
    hit = F.col(malignant) == "malignant" if malignant in df.columns else F.col(status) == "tumor" if status in df.columns else F.lit(False)
    label = F.when(hit, F.concat_ws(" ", F.lit(prefix), label)).otherwise(label)
    for old, new in (rename or {}).items():
        label = F.when(label == old, F.lit(new)).otherwise(label)
    return df.withColumn(out, label)


def merge_first(cells: DataFrame, sources: Sequence[DataFrame], out: str = "fine", carry: str | None = None) -> DataFrame:
    """Labels of sources(cell_id, label) onto cells: the first source that has a cell wins; cells that none has keep `carry`."""
    every = [s.select("cell_id", "label", F.lit(i).alias("_i")) for i, s in enumerate(sources)]
    union = every[0]
    for s in every[1:]:
        union = union.unionByName(s)
    first = union.groupBy("cell_id").agg(F.min_by("label", F.struct("_i", "label")).alias("_label"))
    rest = F.col(carry) if carry else F.lit(None).cast("string")
    return cells.join(first, "cell_id", "left").withColumn(out, F.coalesce("_label", rest)).drop("_label")


def drop_artifacts(df: DataFrame, label: str, names: Sequence[str] = ARTIFACTS, major: str | None = None) -> DataFrame:
    """Leaves out cells whose label is an artifact's, or holds its name, or whose `major` label is one; null labels stay."""
    hit = F.coalesce(F.col(label).isin(*names), F.lit(False))
    if major is not None:
        hit = hit | F.coalesce(F.col(major).isin(*names), F.lit(False))
    for n in names:
        hit = hit | F.coalesce(F.contains(F.col(label), F.lit(n)), F.lit(False))
    return df.where(~hit)


def dominance(df: DataFrame, group: str, category: str) -> DataFrame:
    """Of each group: its rows, distinct categories, the top one (ties to the smaller name), its share, and the entropy of the
    categories, with base 2 and as a share of the entropy of as many equal ones as there are in all. Two aggregations, the first of
    which shrinks the rows to pairs."""
    pair = df.groupBy(as_group(F.col(group)).alias("grp"), as_group(F.col(category)).alias("cat")).agg(F.count("*").alias("c"))
    w = Window.partitionBy("grp")
    share = F.col("c") / F.sum("c").over(w)
    pair = pair.withColumn("p", share)
    total = pair.agg(F.count_distinct("cat").alias("n_all"))
    best = F.max_by("cat", F.struct(F.col("c"), -F.col("_o")))
    pair = pair.withColumn("_o", F.row_number().over(w.orderBy("cat")))
    h = -F.sum(F.col("p") * F.log(F.col("p")))
    out = pair.groupBy("grp").agg(F.sum("c").alias("n_cells"), F.count("*").alias("n_categories"), best.alias("top"), F.max("p").alias("top_share"), h.alias("_h"))
    out = out.join(F.broadcast(total))
    norm = F.when(F.col("n_all") > 1, F.col("_h") / F.log(F.col("n_all").cast("double"))).otherwise(F.lit(0.0))
    return out.withColumns({"entropy2": F.col("_h") / F.log(F.lit(2.0)), "entropy_norm": norm}).drop("_h", "n_all")


def compartment_plan(df: DataFrame, group: str, batch: str, sample: str, min_cells: int = 50, min_samples: int = 2, dominant: float = 0.8) -> DataFrame:
    """Which groups carry an analysis of their own: powered, why not or with what reservation, and whether one sample dominates."""
    b = dominance(df, group, batch).select("grp", "n_cells", F.col("n_categories").alias("n_batches"), F.col("entropy_norm").alias("batch_entropy"))
    s = dominance(df, group, sample).select("grp", F.col("n_categories").alias("n_samples"), "top_share")
    global_batches = df.agg(F.count_distinct(as_group(F.col(batch))).alias("n_global"))
    out = b.join(s, "grp").join(F.broadcast(global_batches))
    mixing = F.when((F.col("n_batches") == 1) & (F.col("n_global") > 1), "single_batch").when((F.col("batch_entropy") < 0.3) & (F.col("n_batches") > 1), "low_batch_mixing")
    reasons = F.array_join(F.array_compact(F.array(mixing, F.when(F.col("n_cells") < min_cells, f"below_min_cells(<{min_cells})"), F.when(F.col("n_samples") < min_samples, f"below_min_samples(<{min_samples})"))), ";")
    return out.select("grp", "n_cells", "n_batches", "n_samples", "batch_entropy", ((F.col("n_cells") >= min_cells) & (F.col("n_samples") >= min_samples)).alias("powered"), reasons.alias("reasons"), (F.round("top_share", 3) >= dominant).alias("single_patient_dominated"))


def collisions(markers: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """Pairs of groups with different labels whose marker sets overlap (Jaccard >= least). markers(grp, gene): a few per group, so
    pairs are as many as groups squared, not cells."""
    sets = markers.groupBy("grp").agg(F.collect_set("gene").alias("genes")).join(labels, "grp")
    a, b = (sets.select(*[F.col(c).alias(f"{c}_{k}") for c in ("grp", "genes", "label")]) for k in "ab")
    pairs = a.join(b, (F.col("grp_a") < F.col("grp_b")) & (F.col("label_a") != F.col("label_b")))
    jaccard = F.size(F.array_intersect("genes_a", "genes_b")) / F.size(F.array_union("genes_a", "genes_b"))
    return pairs.withColumn("jaccard", jaccard).where(F.col("jaccard") >= least).select("grp_a", "grp_b", "label_a", "label_b", "jaccard")


def confusion(df: DataFrame, ref: str, pred: str) -> DataFrame:
    both = df.where(F.col(ref).isNotNull() & F.col(pred).isNotNull())
    return both.groupBy(F.col(ref).cast("string").alias("ref"), F.col(pred).cast("string").alias("pred")).agg(F.count("*").alias("n"))


def class_scores(table: DataFrame) -> DataFrame:
    """Support, precision, recall and F1 of each class of the truth, from a confusion table."""
    p = table.groupBy(F.col("pred").alias("cls")).agg(F.sum("n").alias("n_pred"))
    r = table.groupBy(F.col("ref").alias("cls")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("ref") == F.col("pred"), F.col("n")).otherwise(0)).alias("hit"))
    df = r.join(p, "cls", "left")
    precision, recall = F.coalesce(F.col("hit") / F.col("n_pred"), F.lit(0.0)), F.col("hit") / F.col("support")
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))
    return df.select("cls", "support", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def adjusted_rand(table: DataFrame) -> DataFrame:
    """Adjusted Rand index of a confusion table, one row (Hubert and Arabie 1985); 1 if both sides have one class, or there is one row."""
    pairs = lambda c: c * (c - 1) / 2
    n = F.col("n").cast("double")
    cell = table.agg(F.sum(pairs(n)).alias("i"), F.sum(n).alias("total"))
    side = lambda c, name: table.groupBy(c).agg(F.sum("n").cast("double").alias("s")).agg(F.sum(pairs(F.col("s"))).alias(name))
    df = cell.join(F.broadcast(side("ref", "a"))).join(F.broadcast(side("pred", "b")))
    expected, most = F.try_divide(F.col("a") * F.col("b"), pairs(F.col("total"))), (F.col("a") + F.col("b")) / 2
    return df.select(F.coalesce(F.try_divide(F.col("i") - expected, most - expected), F.lit(1.0)).alias("ari"))


def reference_scores(df: DataFrame, ref: str, pred: str, mapping: Mapping[str, str] | None = None) -> DataFrame:
    """One row: how predicted labels agree with reference ones. Rows where either is null don't count. Predictions are mapped, and matched
    to the reference's classes whatever their case (the smallest spelling stands for all); what matches none becomes UNMATCHED::label,
    which is wrong in accuracy and macro_f1 and left out in those of matched rows. F1 is averaged over the reference's classes; without
    rows the scores are null."""
    both = df.select(F.col(ref).cast("string").alias("r"), F.col(pred).cast("string").alias("p")).where("r IS NOT NULL AND p IS NOT NULL")
    mapped = F.col("p")
    for old, new in (mapping or {}).items():
        mapped = F.when(F.col("p") == old, F.lit(new)).otherwise(mapped)
    pairs = both.groupBy("r", mapped.alias("p")).agg(F.count("*").alias("n"))  # as many rows as pairs of labels from here on
    names = pairs.groupBy(F.lower("r").alias("key")).agg(F.min("r").alias("name"))
    known = pairs.join(names, F.lower("r") == F.col("key")).select(F.col("name").alias("ref"), "p", "n")
    table = known.join(names, F.lower("p") == F.col("key"), "left").groupBy("ref", F.coalesce("name", F.concat(F.lit("UNMATCHED::"), F.col("p"))).alias("pred")).agg(F.sum("n").alias("n"))
    matched = table.where(~F.col("pred").startswith("UNMATCHED::"))

    def scores(t: DataFrame, end: str) -> DataFrame:
        hit = F.sum(F.when(F.col("ref") == F.col("pred"), F.col("n")).otherwise(0))
        return t.agg(F.coalesce(F.sum("n"), F.lit(0)).alias(f"n{end}"), F.try_divide(hit, F.sum("n")).alias(f"accuracy{end}")).join(F.broadcast(class_scores(t).agg(F.avg("f1").alias(f"macro_f1{end}"))))

    return scores(table, "").join(F.broadcast(scores(matched, "_matched")))
