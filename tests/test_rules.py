"""The rules for labels, reviews and calls, with the values the fixtures expect."""

import pytest

from cytoloom.operators import annotation, audit, labels


def test_rule_set(spark):
    """A group for each rule: background, epithelial, T/NK with the pan-immune gene, both panels, high %mt, T/NK without the gene, doublets."""
    panels = {"Epithelial": ["EPCAM", "KRT8", "KRT18", "KRT19"], "T_NK": ["CD3D", "CD3E", "CD2", "TRAC"]}
    genes = spark.createDataFrame([(p, g, False) for p, own in panels.items() for g in own], "panel string, gene string, negative boolean")
    both = panels["Epithelial"] + panels["T_NK"]
    found = {"1": panels["Epithelial"], "2": panels["T_NK"], "3": both, "4": panels["Epithelial"], "5": panels["T_NK"], "6": panels["T_NK"]}
    sig = spark.createDataFrame([(k, g) for k, own in found.items() for g in own], "grp string, gene string")
    rows = [(str(k), 50, 40.0 if k == 4 else 5.0, 1000.0, 0.9 if k == 6 else 0.0, {1: 0.0, 2: 0.9, 5: 0.05}.get(k, 0.3)) for k in range(7)]
    quality = spark.createDataFrame(rows, "grp string, n_cells long, med_mt double, med_genes double, doublet_share double, pan_share double")
    got = annotation.panel_labels(annotation.panel_hits(sig, genes, quality), quality, immune=["T_NK"], other=["Epithelial"])
    assert {r.grp: (r.label, r.confidence, r.conflict, r.review, r.consistent) for r in got.collect()} == {
        "0": ("Unknown", 0.0, False, False, None), "1": ("Epithelial", 1.0, False, False, True), "2": ("T_NK", 1.0, False, False, True), "3": ("Mixed/Artifact", 1.0, True, True, None),
        "4": ("Low_quality", 1.0, False, True, None), "5": ("T_NK", 0.7, False, True, False), "6": ("Mixed/Artifact", 1.0, False, True, None),
    }


def test_packets(spark):
    rows = [("a", 100, 30.0, 900.0, 0.0), ("b", 100, 5.0, 299.0, 0.7), ("c", 19, 5.0, 900.0, 0.0), ("d", 20, 5.0, 300.0, 0.0), ("e", 500, None, None, None)]
    quality = spark.createDataFrame(rows, "grp string, n_cells long, med_mt double, med_genes double, doublet_share double")
    markers = spark.createDataFrame([(g, f"g{i}", True) for g in "abde" for i in range(3)], "grp string, gene string, specific boolean")
    got = annotation.evidence_packet(quality, markers, single=spark.createDataFrame([("c",), ("a",), ("e",)], "grp string"))
    assert {r.grp: (r.status, r.risks) for r in got.collect()} == {
        "a": ("artifact_suspected", "low_quality_qc"), "b": ("artifact_suspected", "doublet_dominated,low_quality_qc"), "c": ("review", "single_source,tiny_cluster,few_specific_markers"),
        "d": ("clean", ""), "e": ("review", "single_source"),
    }


def test_fine_labels(spark):
    rows = [("1", 50, "Naive", "CD4 naive", 1, "T", False), ("2", 50, None, "x", 1, "T", False), ("3", 19, "Rare", "y", 0, "T", False), ("4", 50, "Memory", None, 0, None, False), ("5", 50, "Memory", None, 2, None, True), ("6", 5, "Rare", None, 1, None, None)]
    subs = spark.createDataFrame(rows, "sub string, n_cells long, label string, facs string, n_evidence int, compartment string, requested boolean")
    assert {r["sub"]: (r.fine_label, r.shown, r.review, r.merged, r.reasons) for r in annotation.apply_fine(subs).collect()} == {
        "1": ("Naive", "CD4 naive", False, False, ""), "2": ("Unassigned", "Unassigned", True, False, "not_labeled"), "3": ("T_unresolved", "T_unresolved", True, True, "below_merge_min_cells(<20),insufficient_evidence"),
        "4": ("Memory", "Memory", True, False, "insufficient_evidence"), "5": ("Memory", "Memory", True, False, ""), "6": ("unresolved", "unresolved", True, True, "below_merge_min_cells(<20)"),
    }


def test_malignancy_calls(spark):
    cells = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None)], "cell_id long, grp string")
    calls = spark.createDataFrame([("a", "malignant", None, 0.9), ("b", "non_malignant", True, None), ("nan", "malignant", False, float("nan"))], "grp string, label string, review boolean, confidence double")
    read = lambda df: [(r.malignancy, r.cnv_status, r.malignancy_review_required, r.malignancy_confidence) for r in df.orderBy("cell_id").collect()]
    got = read(labels.apply_malignancy(cells, "grp", calls))
    assert got == [("malignant", "tumor", True, 0.9), ("non_malignant", "normal", True, None), ("not_applicable", "normal", False, None), ("malignant", "tumor", True, None)]
    scored = read(labels.apply_malignancy(cells.selectExpr("*", "0.1 AS cnv_score"), "grp", calls))
    assert [r[2] for r in scored] == [False, True, False, False]
    with pytest.raises(Exception, match="unknown call: tumor"):
        labels.apply_malignancy(cells, "grp", spark.createDataFrame([("a", "tumor", None, 0.9)], calls.schema)).collect()


def test_annotation_with_confidence_and_state(spark):
    cells = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "cell_id long, grp string")
    calls = spark.createDataFrame([("a", "T", 0.5, True, "cycling"), ("nan", "B", None, None, None)], "grp string, label string, confidence double, review boolean, state string")
    got = [tuple(r)[2:] for r in labels.apply_annotation(cells, "grp", calls).orderBy("cell_id").collect()]
    assert got == [("T", 0.5, True, "cycling"), ("Unassigned", None, False, ""), ("B", None, False, "")]


def test_malignancy_flags(spark):
    checks = spark.createDataFrame([("1", "g", "")], "grp string, gene string, fails string")
    rows = [("1", 0.1, 0.1, 0.0, 1.0, True, 0.2), ("2", 0.1, 0.1, 0.0, 1.0, True, 0.6), ("3", 0.1, 0.1, 0.0, 1.0, False, 0.1), ("4", 0.9, 0.1, 0.0, 1.0, True, None)]
    df = spark.createDataFrame(rows, "grp string, sample_share double, batch_share double, doublet_share double, med_mt double, malignant boolean, cnv_burden double")
    read = lambda c: {r.grp: r.flags for r in audit.flags(checks, c).collect()}
    assert read(df.selectExpr("*", "0.3 AS cnv_baseline")) == {"1": "malignant_low_cnv_burden", "2": "", "3": "", "4": "single_patient_dominant"}
    assert read(df.drop("cnv_burden")) == {"1": "malignant_without_cnv", "2": "malignant_without_cnv", "3": "", "4": "single_patient_dominant;malignant_without_cnv"}
