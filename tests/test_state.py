"""States, symbols, coverage, fingerprints and comparisons of runs."""

import pytest
from pyspark.sql import functions as F

from cytoloom.operators import state


@pytest.mark.parametrize("values,want", [([1.0, 2.0, 0.0], "raw_counts"), ([1.0, 2.5], "normalized"), ([1.0, -2.0], "normalized"), ([None], "normalized"), ([float("nan")], "normalized"), ([], "unknown")])
def test_value_state(spark, values, want):
    assert state.value_state(spark.createDataFrame([(v,) for v in values], "v double")).first().state == want


@pytest.mark.parametrize("genes,want", [(["EPCAM", "MT-ND1"], "human"), (["Epcam", "mt-Nd1"], "mouse"), (["A", "B", "C", "d"], "human"), (["Aa", "Bb", "Cc", "Dd", "EE"], "mouse"), (["Aa", "BB"], "unknown"), (["mt-A", "MT-B", "x", "Y"], "unknown"), (["ENSG00000141510", "ENSMUSG00000059552.8"], "unknown"), ([], "unknown"), ([None, "123"], "mouse")])
def test_organism(spark, genes, want):
    row = state.organism(spark.createDataFrame([(g,) for g in genes], "gene string")).first()
    assert row.organism == want and row.n_genes == len(genes) and row.mito_prefix == ("mt-" if want == "mouse" else "MT-")


def test_symbols(spark):
    rows = [("ENSG00000000001", "A", "x"), ("ENSG00000000002", "A", "x"), ("ENSG00000000003", None, "x"), ("ENSG00000000004", "nan", "x"), ("ENSG00000000005", "B", "x")]
    genes = spark.createDataFrame(rows, "gene string, feature_name string, other string")
    got, how = state.symbols(genes)
    assert how == "feature_name" and {r.gene_ids[-1]: r.gene for r in got.collect()} == {"1": "A", "2": "A-1", "3": "ENSG00000000003", "4": "ENSG00000000004", "5": "B"}
    assert state.symbols(genes.drop("feature_name"))[1] == "ensembl_but_no_symbol_column"
    same, how = state.symbols(genes.withColumn("gene", F.col("other")))
    assert how == "not_ensembl" and {r.gene for r in same.collect()} == {"x"} == {r.gene_ids for r in same.collect()}


def test_coverage(spark):
    coding = spark.createDataFrame([(g,) for g in "ABCDE"] + [(None,), ("A",)], "gene string")
    read = lambda have: tuple(state.coverage(spark.createDataFrame(have, "symbol string, chromosome string"), coding).first())
    assert read([(g, "chr1") for g in "ABCDX"] + [("E", None)]) == (4, 5, 0.8, True, "ok")
    assert read([(g, "chr1") for g in "ABC"]) == (3, 5, 0.6, True, "verify") and read([("A", "chr1")]) == (1, 5, 0.2, False, "mismatch")
    assert tuple(state.coverage(spark.createDataFrame([("A", "chr1")], "symbol string, chromosome string"), coding.where("false")).first()) == (0, 0, 0.0, False, "mismatch")


def test_fingerprint(spark):
    rows = [(i, f"t{i % 3}", [i, None], None if i % 2 else 0.5) for i in range(50)]
    df = spark.createDataFrame(rows, "a long, b string, c array<long>, d double")
    one = state.fingerprint(df).first()
    assert one == state.fingerprint(df.orderBy(F.desc("a")).repartition(7).select("d", "c", "b", "a")).first() and one.n == 50
    for other in (df.where("a > 0"), df.union(df.limit(1)), df.withColumn("d", F.coalesce("d", F.lit(0.0))), df.withColumn("a", F.when(F.col("a") == 3, 4).otherwise(F.col("a"))), df.withColumn("b", F.concat("b", F.lit("|")))):
        assert state.fingerprint(other).first() != one
    assert state.fingerprint(df.where("false")).first().n == 0


def test_comparison_of_summaries(spark):
    read = lambda a, b, grade: {r.path: r.change for r in state.compared(state.flattened(spark, a), state.flattened(spark, b), grade).collect()}
    a, b = {"n_clusters": 12, "silhouette": 0.50}, {"n_clusters": 13, "silhouette": 0.51}
    assert read(a, b, "B") == {} and read(a, b, "A") == {"n_clusters": "value", "silhouette": "value"} == read(a, b, "C")
    nested = lambda t, s: {"label_distribution": {"T": t, "B": s}, "names": ["x", "y"], "ok": True, "none": None}
    assert read(nested(100, 50), nested(102, 51), "B") == {} and read(nested(100, 50), nested(100, 80), "B") == {"label_distribution.B": "value"}
    assert read(nested(1, 1), nested(1, 1) | {"names": ["x"], "ok": 1, "new": 3}, "B") == {"names": "size", "ok": "kind", "new": "added"}
    assert read({"n_clusters": [1, 5]}, {"n_clusters": [2, 7]}, "B") == {"n_clusters[1]": "value"} and read({"a": 1, "s": "x"}, {"s": "y"}, "odd") == {"a": "missing", "s": "value"}
