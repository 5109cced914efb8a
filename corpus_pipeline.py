"""From raw documents to packed sequences: each stage is one operator of the llm subpackage, over all that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoloom.llm import language_id, mixing, order_minhash, packing, secret_scan
from cytoloom.llm.queries import DOMAIN_WEIGHTS, TOKENIZER, domains, table
from cytoloom.llm.shared import shared_folder


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a determined language: those without a letter (null and empty ones too) and those between two languages go."""
    told = language_id.identify(docs, language_id.train(docs), lead=0.02)
    return told.where(f"lang_pred <> '{language_id.UNDETERMINED}' AND NOT ambiguous").select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near copies, that of the smallest doc_id."""
    return order_minhash.keep_one(docs, order_minhash.classes(docs))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document, its secrets replaced by a mark and n_chars counted anew."""
    clean = secret_scan.redact(secret_scan.scan(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*[F.col(f"`{c}`") for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents by their rates; the clean domain's tokens don't fall."""
    mixed = mixing.mix(docs, mixing.train(docs, domains(table(spark, sf_dir, "labels"))), DOMAIN_WEIGHTS, keep=("quality1_toxic0",))
    return mixed.where("copies > 0").select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).drop("_copy")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, with their ids."""
    return packing.pack(docs.select("doc_id", "text"), TOKENIZER)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixture", mixture), ("packed", packed)]
#: Classifiers and sketches can't be said in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; what each returns is written as Parquet in the shared folder and read again."""
    folder = shared_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
