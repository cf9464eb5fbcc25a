"""The registered queries of this subpackage: one thin ``opN_<name>`` for each operator, over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refrain.llm import fingerprints, licenses, lines, mixing, packing, repeats, secrets, simhash, toxicity, vectors
from refrain.sources.tables import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.sizes(table(spark, sf_dir, "documents"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: a directory for each source and language in it; short documents that state a licence are the licence files."""
    return licenses.scan(licenses.as_files(table(spark, sf_dir, "documents"))).select("doc_id", "path", "own_license", "own_score", "license", "inherited_from")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, how many of them repeat an earlier line exactly or nearly, and a digest of what is left."""
    return lines.dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_exact", "n_near", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


def op7_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.strip(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mixing, op2_licenses, op3_secrets, op4_packing, op5_simhash, op6_lines, op7_vectors, op8_fingerprints, op9_repeats, op10_toxicity)}


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": mixing.SQL, "op2_licenses": licenses.SQL, "op3_secrets": secrets.SQL}
