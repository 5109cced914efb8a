"""Metadata rules as columns: conditions, inclusion, derivation, harmonised spellings; and readers of sparse matrices and annotations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def condition(df: DataFrame, rule: Mapping) -> Column:
    """{"column", "op", "value"}: eq, ne, eq_ci, ne_ci, in, not_in, in_ci, notna. A column that is absent meets nothing; missing is ""."""
    if rule["column"] not in df.columns:
        return F.lit(False)
    x, op, v = F.coalesce(F.col(rule["column"]).cast("string"), F.lit("")), rule["op"], rule.get("value")
    low = lambda values: [str(s).lower() for s in values]
    ops = {
        "eq": lambda: x == str(v), "ne": lambda: x != str(v), "eq_ci": lambda: F.lower(x) == str(v).lower(), "ne_ci": lambda: F.lower(x) != str(v).lower(),
        "in": lambda: x.isin(*map(str, v)), "not_in": lambda: ~x.isin(*map(str, v)), "in_ci": lambda: F.lower(x).isin(*low(v)), "notna": lambda: x != "",
    }
    if op not in ops:
        raise ValueError(f"unknown operation {op!r}; known: {', '.join(ops)}")
    return ops[op]()


def select_rows(df: DataFrame, include: Sequence[Mapping] = (), exclude: Sequence[Mapping] = ()) -> DataFrame:
    """Rows that meet all of include and none of exclude."""
    keep = reduce(and_, [condition(df, r) for r in include], F.lit(True))
    return df.where(keep & ~reduce(or_, [condition(df, r) for r in exclude], F.lit(False)))


def derive_case(df: DataFrame, name: str, cases: Sequence[tuple[Mapping, str]], default: str | None = None) -> DataFrame:
    """A column by cases; where several hold, the last one wins."""
    out = F.lit(default).cast("string")
    for rule, value in cases:
        out = F.when(condition(df, rule), F.lit(value)).otherwise(out)
    return df.withColumn(name, out)


def derive(df: DataFrame, name: str, rule: Mapping) -> DataFrame:
    """A column by one rule: {"kind": "alias", "column"}, {"kind": "const", "value"}, {"kind": "relabel", "column", "map", "default"} (without
    a default the value stays), {"kind": "isin_flag", "column", "values"}, {"kind": "case", "cases", "default"}. An absent column gives null, and
    no flag."""
    kind = rule["kind"]
    if kind == "case":
        return derive_case(df, name, rule["cases"], rule.get("default"))
    x = F.col(rule["column"]).cast("string") if rule.get("column") in df.columns else F.lit(None).cast("string")
    if kind == "alias":
        out = x
    elif kind == "const":
        out = F.lit(rule["value"])
    elif kind == "relabel":
        out = F.lit(rule["default"]) if "default" in rule else x
        for old, new in rule["map"].items():
            out = F.when(x == old, F.lit(new)).otherwise(out)
    elif kind == "isin_flag":
        out = F.coalesce(x.isin(*rule["values"]), F.lit(False))
    else:
        raise ValueError(f"unknown kind {kind!r}; known: alias, const, relabel, isin_flag, case")
    return df.withColumn(name, out)


def normalised(text: Column) -> Column:
    """Lower case, runs of anything but letters and digits as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), "[^0-9a-z]+", " "))


def harmonise(df: DataFrame, field: str, batch: str, overrides: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Replaces a field by its batch's override(batch, raw, value), else by its synonym(raw, value), else keeps it; <field>__raw stays. Of raw
    spellings that are one in normal form the smallest counts."""
    n = normalised(F.coalesce(F.col(field), F.lit("")))
    first = F.min_by("value", F.struct("raw", "value"))
    o = overrides.groupBy(F.col("batch").alias("_ob"), normalised(F.col("raw")).alias("_or")).agg(first.alias("_ov"))
    s = synonyms.groupBy(normalised(F.col("raw")).alias("_sr")).agg(first.alias("_sv"))
    df = df.withColumns({f"{field}__raw": F.col(field), "_n": n})
    df = df.join(o, (F.col(batch) == F.col("_ob")) & (F.col("_n") == F.col("_or")), "left").join(s, F.col("_n") == F.col("_sr"), "left")
    return df.withColumn(field, F.coalesce("_ov", "_sv", f"{field}__raw")).drop("_ob", "_or", "_ov", "_sr", "_sv", "_n")


def resolve_symbols(wanted: DataFrame, genes: DataFrame) -> DataFrame:
    """(symbol, gene, gene_idx): each wanted symbol's gene whatever its case; of several the first by gene_idx."""
    first = genes.groupBy(F.upper("gene").alias("_u")).agg(F.min(F.struct("gene_idx", "gene")).alias("_g"))
    return wanted.join(first, F.upper("symbol") == F.col("_u")).select("symbol", F.col("_g.gene").alias("gene"), F.col("_g.gene_idx").alias("gene_idx"))


def read_matrix_market(spark: SparkSession, matrix: str, barcodes: str, features: str, sample: str) -> DataFrame:
    """counts(cell_id, gene, cnt) of a MatrixMarket folder, gzip or not: genes by rows, cells by columns, numbered from 1. The two name
    files are numbered by their line's place; the size line is the first that isn't a comment."""

    def lines(path: str) -> DataFrame:
        rows = spark.read.text(path).withColumn("_m", F.monotonically_increasing_id())
        return rows.withColumn("i", F.row_number().over(Window.orderBy("_m"))).select("i", F.split("value", "\t").alias("f"))  # names: as many as genes or barcodes of one sample

    parts = F.split(F.trim("value"), r"\s+")
    body = spark.read.text(matrix).where(~F.col("value").startswith("%")).withColumn("_m", F.monotonically_increasing_id())
    size = body.agg(F.min("_m").alias("_first"))
    cells = body.join(F.broadcast(size)).where("_m > _first").select(parts[0].cast("int").alias("g"), parts[1].cast("int").alias("c"), parts[2].cast("double").alias("cnt"))
    g = lines(features).select(F.col("i").alias("g"), F.when(F.size("f") > 1, F.col("f")[1]).otherwise(F.col("f")[0]).alias("gene"))
    c = lines(barcodes).select(F.col("i").alias("c"), F.concat_ws("_", F.lit(sample), F.col("f")[0]).alias("cell_id"))
    return cells.join(g, "g").join(c, "c").groupBy("cell_id", "gene").agg(F.sum("cnt").alias("cnt")).where("cnt != 0")


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    """Genes of an annotation file: gene, gene_type, chromosome, start, end; the first by place for a name given twice."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("#")).where(f[2] == "gene")
    attr = lambda k: F.regexp_extract(f[8], rf'{k} "([^"]*)"', 1)
    df = rows.select(attr("gene_name").alias("gene"), attr("gene_type").alias("gene_type"), f[0].alias("chromosome"), f[3].cast("long").alias("start"), f[4].cast("long").alias("end")).where("gene != ''")
    return df.groupBy("gene").agg(F.min(F.struct("chromosome", "start", "end", "gene_type")).alias("x")).select("gene", "x.gene_type", "x.chromosome", "x.start", "x.end")


def locate(genes: DataFrame, positions: DataFrame) -> DataFrame:
    """Adds chromosome, start, end to genes: by the whole name, else, for those alone, by the name without a last -number."""
    p = positions.select(F.col("gene").alias("_p"), "chromosome", "start", "end")
    one = genes.join(p, F.col("gene") == F.col("_p"), "left").drop("_p").withColumn("base", F.when(F.col("chromosome").isNull(), F.nullif(F.regexp_extract("gene", r"^(.+)-[0-9]+$", 1), F.lit(""))))
    q = positions.select(F.col("gene").alias("_q"), F.col("chromosome").alias("_c"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    two = one.join(q, F.col("base") == F.col("_q"), "left")
    return two.select(*[F.col(c) for c in genes.columns], F.coalesce("chromosome", "_c").alias("chromosome"), F.coalesce("start", "_s").alias("start"), F.coalesce("end", "_e").alias("end"), F.when(F.col("_q").isNotNull(), "base").when(F.col("chromosome").isNotNull(), "exact").alias("match"))
