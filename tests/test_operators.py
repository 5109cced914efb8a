"""Planted effects and exact values on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoloom.operators import annotation, audit, evidence, labels, markers, neighbours, qc
from cytoloom.sources import metadata


def test_votes(spark):
    rows = [("T", "T", "T", "T", 1), ("T", "T", "B", "T", 2 / 3), ("T", "B", "C", "ambiguous", 1 / 3), ("T", "T", None, "T", 1), (None, "nan", "", "ambiguous", 0), ("T", "B", None, "ambiguous", 0.5), (None, None, "B", "B", 1)]
    df = spark.createDataFrame([(*r[:4], float(r[4])) for r in rows], "a string, b string, c string, want string, share double")
    got = labels.majority_vote(df, ["a", "b", "c"]).collect()
    assert all(r.consensus == r.want and abs(r.consensus_agreement - r.share) < 1e-12 for r in got)


def test_reference_scores(spark):
    """Two classes in three spellings; one prediction under a map's name, two that match nothing."""
    rows = [("Red", "red"), ("RED", "blue"), ("blue", "navy"), ("blue", "Blue"), ("blue", "plum"), ("red", "plum"), (None, "red"), ("red", None)]
    df = spark.createDataFrame(rows, "truth string, said string")
    r = labels.reference_scores(df, "truth", "said", {"navy": "BLUE"}).first()
    # truth: 3 red, 3 blue; hits: 1 red, 2 blue; predicted red 1, blue 3
    assert (r.n, r.n_matched) == (6, 4) and abs(r.accuracy - 0.5) < 1e-12 and abs(r.accuracy_matched - 0.75) < 1e-12
    assert abs(r.macro_f1 - (2 * 1 / 4 + 2 * 2 / 6) / 2) < 1e-12 and abs(r.macro_f1_matched - (2 * 1 / 3 + 2 * 2 / 5) / 2) < 1e-12
    none = labels.reference_scores(df.limit(0), "truth", "said").first()
    assert none.n == 0 and none.accuracy is None


def test_adjusted_p_of_missing_values(spark):
    rows = [("a", 0.01), ("a", 0.02), ("a", None), ("a", float("nan")), ("b", 0.5), ("b", 0.5), (None, 0.2)]
    got = [(r.grp, r.p, r.padj) for r in markers.bh(spark.createDataFrame(rows, "grp string, p double"), "p", "grp").collect()]
    assert sorted(x[2] for x in got if x[0] == "a" and x[2] is not None) == [0.02, 0.02] and sum(x[2] is None for x in got) == 2
    assert [x[2] for x in got if x[0] == "b"] == [0.5, 0.5] and [x[2] for x in got if x[0] is None] == [0.2]


def test_one_group_one_cell_one_row(spark):
    x = spark.createDataFrame([(1, "g", 2.0), (2, "g", 3.0)], "cell_id long, gene string, v double")
    g = spark.createDataFrame([(1, "a"), (2, "a")], "cell_id long, grp string")
    assert markers.rank_sum(x, g).first().z is None
    r = markers.fractions_and_change(x, g).first()
    assert r.pct_in == 1 and r.pct_out is None and r.logfc is None
    counts = spark.createDataFrame([(1, "g", 0.0), (2, "g", 4.0)], "cell_id long, gene string, cnt double")
    assert qc.gene_stats(counts, spark.createDataFrame([(1,)], "n long")).first().variance is None
    assert [round(r.v, 6) for r in qc.log_normalised(counts).orderBy("cell_id").collect()] == [0.0, round(float(np.log1p(1e4)), 6)]
    assert labels.adjusted_rand(labels.confusion(spark.createDataFrame([("a", "b")], "r string, p string"), "r", "p")).first().ari == 1
    z = markers.normal_p(F.col("z"))
    got = [r[0] for r in spark.createDataFrame([(1.959963984540054,), (None,), (0.0,)], "z double").select(z).collect()]
    assert abs(got[0] - 0.05) < 1e-12 and got[1:] == [None, 1.0]


def test_panel_cascade(spark):
    """One group for each rule of the cascade."""
    panels = spark.createDataFrame([("T", g, False) for g in ("t1", "t2", "t3", "t4")] + [("B", g, False) for g in ("b1", "b2", "b3")] + [("B", "t1", True), ("B", "t2", True)], "panel string, gene string, negative boolean")
    found = {"t": ["t1", "t2", "t3"], "b": ["b1", "b2"], "both": ["t1", "t3", "b1", "b2", "b3"], "raw": ["b1", "b2", "t1"], "none": ["t1"], "mt": ["t1", "t2"], "few": ["b1", "b2"], "dbl": ["t1", "t2"]}
    sig = spark.createDataFrame([(k, g) for k, v in found.items() for g in v], "grp string, gene string")
    quality = spark.createDataFrame([(k, 100, 30.0 if k == "mt" else None if k == "t" else 5.0, 50.0 if k == "few" else 900.0, 0.6 if k == "dbl" else 0.0) for k in [*found, "empty"]], "grp string, n_cells long, med_mt double, med_genes double, doublet_share double")
    hits = annotation.panel_hits(sig, panels, quality, min_markers=2)
    assert hits.count() == 18
    got = {r.grp: (r.label, r.confidence, r.conflict, r.review) for r in annotation.panel_labels(hits, quality).collect()}
    assert got == {
        "t": ("T", 0.75, False, False), "b": ("B", 0.667, False, False), "both": ("Mixed/Artifact", 1.0, True, True), "raw": ("B", 0.667, False, False), "none": ("Unknown", 0.0, False, False),
        "mt": ("Low_quality", 0.5, False, True), "few": ("Low_quality", 0.667, False, True), "dbl": ("Mixed/Artifact", 0.5, False, True), "empty": ("Unknown", 0.0, False, False),
    }


def test_verdicts(spark):
    c = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "cell_id int, grp string")
    v = lambda status: spark.createDataFrame([("a", status, None), ("nan", "suspect", False)], "grp string, status string, review boolean")
    assert [(r.audit_status, r.audit_review) for r in audit.apply_verdicts(c, "grp", v("refuted")).orderBy("cell_id").collect()] == [("refuted", True), ("confirmed", False), ("suspect", False)]
    with pytest.raises(Exception, match="unknown status: odd"):
        audit.apply_verdicts(c, "grp", v("odd")).collect()


def test_neighbours_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 7)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(30, 4)).round(1)
    rows = [(i, v.tolist(), "ab"[i % 2] if i < 29 else "c") for i, v in enumerate(x)] + [(30, None, "a"), (31, [1.0, None, 2.0, 3.0], "a"), (32, [float("nan")] * 4, "b")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    got = neighbours.knn(df, 3).toPandas()
    for i, part in got.groupby("id"):
        order = [j for j in np.lexsort((np.arange(30), (d[i] ** 2).round(9))) if j != i][:3]
        assert part.sort_values("place").neighbour.tolist() == order
    lab = np.array([r[2] for r in rows[:30]])
    for r in neighbours.silhouettes(df).collect():
        own = (lab == r.label) & (np.arange(30) != r.id)
        want = 0.0
        if own.any():
            a, b = d[r.id][own].mean(), min(d[r.id][lab == o].mean() for o in set(lab) - {r.label})
            want = (b - a) / max(a, b)
        assert abs(r.silhouette - want) < 1e-9
    assert neighbours.knn(df.limit(0), 3).count() == 0 and neighbours.silhouettes(df.limit(0)).count() == 0


def test_principal_scores_equal_svd(spark):
    x = np.random.default_rng(1).normal(size=(50, 6)) * [5, 4, 3, 2, 1, 1] + 7
    got = evidence.principal_scores(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), 3).orderBy("id").collect()
    c = x - x.mean(0)
    load = np.linalg.svd(c, full_matrices=False)[2][:3].T
    load *= np.sign(load[np.abs(load).argmax(0), np.arange(3)])
    assert np.abs(np.array([r.scores for r in got]) - c @ load).max() < 1e-8


def test_rank_sum_equals_dense(spark):
    rng = np.random.default_rng(0)
    dense = rng.poisson(0.7, (40, 6)).astype(float)
    dense[:, 5] = 0
    dense[3, 5] = 2
    x = spark.createDataFrame([(i, f"g{j}", float(dense[i, j])) for i in range(40) for j in range(6) if dense[i, j]], "cell_id long, gene string, v double")
    g = spark.createDataFrame([(i, "ab"[i % 3 == 0]) for i in range(40)], "cell_id long, grp string")
    got = {(r.gene, r.grp): r.z for r in markers.rank_sum(x, g).collect()}
    assert len(got) == 12
    for j in range(6):
        v = dense[:, j]
        rank = np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
        own = np.array([i % 3 == 0 for i in range(40)])
        n, n_g = 40, own.sum()
        assert abs(got[f"g{j}", "b"] - (rank[own].sum() - n_g * (n + 1) / 2) / np.sqrt(n_g * (n - n_g) * (n + 1) / 12)) < 1e-9


def test_empty_cells_stay(spark):
    cells = spark.createDataFrame([(1,), (2,)], "cell_id long")
    counts = spark.createDataFrame([(1, "MT-A", 2.0), (1, "B", 6.0)], "cell_id long, gene string, cnt double")
    got = {r.cell_id: r for r in qc.cell_metrics(cells, counts, {"mt": ["mt-"]}).collect()}
    assert got[1].pct_mt == 25 and got[2].total_counts == 0 and got[2].pct_mt is None


def test_positions(spark, tmp_path):
    gtf = tmp_path / "a.gtf"
    gtf.write_text("#x\n" + "".join(f'chr1\ts\tgene\t{10 * i}\t{10 * i + 5}\t.\t+\t.\tgene_name "{g}"; gene_type "protein_coding";\n' for i, g in enumerate(["KRT8", "CD79A", "NKX2-1", "LYZ", "SNORD3"])))
    genes = spark.createDataFrame([(g,) for g in "KRT8 CD79A NKX2-1 LYZ LYZ-2 SNORD3 QQQ-4 NOWHERE".split()], "gene string")
    got = {r.gene: r.match for r in metadata.locate(genes, metadata.read_gtf(spark, str(gtf))).collect()}
    assert got == {"KRT8": "exact", "CD79A": "exact", "NKX2-1": "exact", "LYZ": "exact", "SNORD3": "exact", "LYZ-2": "base", "QQQ-4": None, "NOWHERE": None}


def test_matrix_market(spark, tmp_path):
    (tmp_path / "m.mtx").write_text("%%MatrixMarket\n%\n2 2 3\n1 1 5\n2 1 1\n2 2 4\n")
    (tmp_path / "b.tsv").write_text("AAC\nAAG\n")
    (tmp_path / "f.tsv").write_text("E1\tMT-A\nE2\tB\n")
    got = {(r.cell_id, r.gene): r.cnt for r in metadata.read_matrix_market(spark, *(str(tmp_path / n) for n in ("m.mtx", "b.tsv", "f.tsv")), "s").collect()}
    assert got == {("s_AAC", "MT-A"): 5, ("s_AAC", "B"): 1, ("s_AAG", "B"): 4}


def test_nearest_in_large_blocks_with_copies_and_far_from_the_origin():
    """One product of matrices a block: equal to distances from differences, copies by their ids, at a fraction of the time."""
    rng = np.random.default_rng(3)
    x = 1e4 + np.concatenate([rng.normal(size=(1500, 5)), np.repeat(rng.normal(size=(1, 5)), 500, 0), rng.normal(size=(1, 5)) + 1e-6 * rng.normal(size=(100, 5))])
    ids = rng.permutation(len(x)) * 7
    i, found, d = neighbours._nearest(x, ids, x, ids, 6)
    at = {v: j for j, v in enumerate(ids.tolist())}
    for r in [*range(0, 1500, 50), *range(1500, 2000, 25), *range(2000, 2100, 5)]:
        far = ((x - x[r]) ** 2).sum(1)
        far[r] = np.inf
        want = np.lexsort((ids, far))[:6]
        assert found[i == r].tolist() == ids[want].tolist() and d[i == r].tolist() == far[want].tolist() and r not in [at[v] for v in found[i == r]]
    of = np.arange(len(x)) % 3
    got = neighbours._sums(x, x, of)
    want = np.stack([np.sqrt(((x[r] - x) ** 2).sum(1)) @ np.eye(3)[of] for r in range(len(x))])
    assert np.abs(got - want).max() < 1e-9 * want.max()


@pytest.mark.parametrize("n,most", [(2000, 8), (40_000, 64)])
def test_blocks_by_rows(spark, n, most):
    """Small tables are dealt to several tasks; the times that a row is sent don't grow with a table of the next size."""
    rows = spark.range(n).selectExpr("id", "array(cast(id as double)) AS v")
    parts = neighbours._meet(rows, "id long", lambda a, b, x, y: a.select(["id"]).slice(0, 1)).count()
    assert 1 < parts <= most
