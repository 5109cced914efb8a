"""What a table of counts is: its state, organism and symbols; and whether two tables, or two summaries, are the same."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoloom.operators import profiles

# Columns that hold symbols, in order; tolerances of the grades (relative, and of numbers of clusters); their keys.
SYMBOL_COLUMNS = ("feature_name", "gene_symbols", "gene_symbol", "gene_name", "gene_names", "Symbol", "symbol", "symbols", "SYMBOL", "hgnc_symbol", "mgi_symbol")
GRADES = {"A": (0.0, 0), "B": (0.05, 1), "C": (0.0, 0)}
CLUSTER_KEYS = ("n_clusters", "n_leiden", "leiden_n")


def value_state(x: DataFrame, value: str = "v") -> DataFrame:
    """One row, state: raw_counts if all values are whole and none is below 0, else normalized, over every value; unknown without rows. Zeros
    that a long table leaves out are whole; null and NaN values aren't."""
    v = F.col(value).cast("double")
    whole = F.coalesce((F.abs(v - F.round(v)) <= 1e-8 + 1e-5 * F.abs(F.round(v))) & (v >= 0) & ~F.isnan(v), F.lit(False))
    return x.agg(F.bool_and(whole).alias("w")).select(F.when(F.col("w").isNull(), "unknown").when(F.col("w"), "raw_counts").otherwise("normalized").alias("state"))


def organism(genes: DataFrame, name: str = "gene") -> DataFrame:
    """One row: organism, n_genes, share_upper (3 places) and mito_prefix, from how names are written. Ensembl ids tell nothing; mt- alone is
    mouse, MT- alone human; else 0.7 and more names in capitals are human, up to 0.2 mouse, others unknown, as are no genes. Null names have
    no capitals."""
    g = F.coalesce(F.col(name), F.lit(""))
    capital = (F.upper(g) == g) & (F.lower(g) != g)
    told = genes.agg(
        F.count("*").alias("n_genes"), F.coalesce(F.avg(capital.cast("int")), F.lit(0.0)).alias("u"), F.coalesce(F.bool_or(F.startswith(g, F.lit("mt-"))), F.lit(False)).alias("low"),
        F.coalesce(F.bool_or(F.startswith(g, F.lit("MT-"))), F.lit(False)).alias("high"), F.coalesce(F.avg(g.rlike(profiles.ENSEMBL).cast("int")) >= 0.5, F.lit(False)).alias("ids"),
    )
    kind = F.when(F.col("ids") | (F.col("n_genes") == 0), "unknown").when(F.col("low") & ~F.col("high"), "mouse").when(F.col("high") & ~F.col("low"), "human").when(F.col("u") >= 0.7, "human").when(F.col("u") <= 0.2, "mouse").otherwise("unknown")
    share = F.when(F.col("ids"), 1.0).otherwise(F.round("u", 3))
    return told.select(kind.alias("organism"), "n_genes", share.alias("share_upper"), F.when(kind == "mouse", "mt-").otherwise("MT-").alias("mito_prefix"))


def symbols(genes: DataFrame, name: str = "gene", least: float = 0.5) -> tuple[DataFrame, str]:
    """genes with gene_ids, the names as they were, and, where these are Ensembl ids and a column of SYMBOL_COLUMNS has symbols for `least` of
    them, symbols as names, made unique in the order of the ids; a gene without one keeps its id. And what was done: the column's name,
    `not_ensembl` or `ensembl_but_no_symbol_column`. A column gene_ids that is there stays."""
    kept = genes if "gene_ids" in genes.columns else genes.withColumn("gene_ids", F.col(name))
    if not profiles.id_share(genes, name, 0.5).first().by_id:
        return kept, "not_ensembl"
    good = lambda c: F.coalesce((F.length(F.col(c).cast("string")) > 0) & (F.upper(F.col(c).cast("string")) != "NAN"), F.lit(False))
    there = [c for c in SYMBOL_COLUMNS if c in genes.columns]
    shares = genes.agg(*[F.avg(good(c).cast("int")).alias(f"s{i}") for i, c in enumerate(there)]).first() if there else ()
    chosen = next((c for c, s in zip(there, shares) if s is not None and s >= least), None)
    if chosen is None:
        return kept, "ensembl_but_no_symbol_column"
    named = kept.withColumn("symbol_or_id", F.when(good(chosen), F.col(chosen).cast("string")).otherwise(F.col(name)))
    made = profiles.unique_names(named, "symbol_or_id", "gene_ids")
    return made.withColumn(name, F.col("unique_name")).drop("symbol_or_id", "unique_name"), chosen


def coverage(positions: DataFrame, coding: DataFrame, fail: float = 0.6, warn: float = 0.8) -> DataFrame:
    """One row: covered, total, coverage (4 places), gate_pass and verdict (ok, verify, mismatch): how many protein-coding genes have a place.
    positions: symbol (the base name of a made-unique one), chromosome; coding: gene. Without coding genes the coverage is 0."""
    have = positions.where("chromosome IS NOT NULL").select(F.col("symbol").alias("gene")).distinct().withColumn("here", F.lit(1))
    all_ = coding.select("gene").where("gene IS NOT NULL").distinct().join(have, "gene", "left").agg(F.count("here").alias("covered"), F.count("*").alias("total"))
    share = F.coalesce(F.try_divide("covered", "total"), F.lit(0.0))
    verdict = F.when(share < fail, "mismatch").when(share < warn, "verify").otherwise("ok")
    return all_.select("covered", "total", F.round(share, 4).alias("coverage"), (share >= fail).alias("gate_pass"), verdict.alias("verdict"))


def fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row, n and fingerprint: the number of rows and the sums of four parts of their md5s, so that neither order nor partitions matter
    but every value, null and repeat does. Columns are taken by name; arrays, maps and structs as JSON."""
    names = sorted(df.columns if columns is None else columns)
    text = lambda c, t: F.to_json(F.struct(F.col(f"`{c}`"))) if t.startswith(("array", "map", "struct")) else F.col(f"`{c}`").cast("string")
    types = dict(df.dtypes)
    parts = [F.coalesce(F.concat(F.lit("="), F.length(text(c, types[c])).cast("string"), F.lit(":"), text(c, types[c])), F.lit("-")) for c in names]
    digest = F.md5(F.encode(F.concat_ws("|", *parts), "UTF-8"))
    piece = lambda i: F.sum(F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("decimal(20,0)"))
    sums = [F.coalesce(piece(i), F.lit(0)).cast("string") for i in range(4)]
    return df.select(digest.alias("digest")).agg(F.count("*").alias("n"), F.concat_ws("-", *sums).alias("fingerprint"))


def flattened(spark: SparkSession, summary: Mapping[str, Any]) -> DataFrame:
    """(path, key, number, text, size): a row for each leaf of a run's summary, and for each list one with its size; a leaf of a list has its
    list's key. A summary is a few hundred values that a run has reported."""
    rows: list[tuple] = []

    def walk(path: str, key: str, v: Any) -> None:
        if isinstance(v, Mapping):
            for k in v:
                walk(f"{path}.{k}" if path else str(k), str(k), v[k])
        elif isinstance(v, (list, tuple)):
            rows.append((path, key, None, None, len(v)))
            for i, x in enumerate(v):
                walk(f"{path}[{i}]", key, x)
        elif isinstance(v, (int, float)) and not isinstance(v, bool):
            rows.append((path, key, float(v), None, None))
        else:
            rows.append((path, key, None, repr(v), None))

    walk("", "", summary)
    return spark.createDataFrame(rows, "path string, key string, number double, text string, size int")


def compared(old: DataFrame, new: DataFrame, grade: str = "B") -> DataFrame:
    """(path, change) of what differs between two flattened summaries: `missing`, `added`, `kind`, `size` or `value`. Numbers may differ by the
    grade's share of the old one, numbers of clusters by its whole number; an unknown grade is B. Where a list's size differs its leaves don't
    count."""
    share, clusters = GRADES.get(grade, GRADES["B"])
    a, b = old.select("path", "key", F.struct("number", "text", "size").alias("a")), new.select("path", F.col("key").alias("new_key"), F.struct("number", "text", "size").alias("b"))
    kind = lambda c: F.when(F.col(f"{c}.number").isNotNull(), 1).when(F.col(f"{c}.size").isNotNull(), 2).otherwise(3)
    step = F.abs(F.col("a.number") - F.col("b.number"))
    far = F.when(F.col("key").isin(*CLUSTER_KEYS), step > clusters).otherwise(step / F.greatest(F.abs("a.number"), F.lit(1e-12)) > share)
    change = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "added").when(kind("a") != kind("b"), "kind").when(F.col("a.size") != F.col("b.size"), "size").when(far | (F.col("a.text") != F.col("b.text")), "value")
    found = a.join(b, "path", "full").withColumn("change", change).where("change IS NOT NULL").select("path", "change")
    sized = found.where("change = 'size'").select(F.col("path").alias("list"))
    return found.join(F.broadcast(sized), F.startswith("path", F.concat("list", F.lit("["))), "left_anti")
