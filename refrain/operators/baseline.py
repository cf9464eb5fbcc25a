"""Baselines: multisets of accepted clones' fingerprints, and what is new beside them."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def pair_hash(a: str, b: str) -> Column:
    """32 hex digits of two snippets, whichever comes first."""
    return F.md5(F.concat(F.least(a, b), F.char(F.lit(0)), F.greatest(a, b)))


def snippet(values: str, pos: Column, tokens: Column) -> Column:
    return F.array_join(F.slice(values, (pos + 1).cast("int"), tokens.cast("int")), " ")


def fingerprints(found: DataFrame, arrays: DataFrame) -> DataFrame:
    """Clones with a fingerprint of their two snippets."""
    at = arrays.select(F.col("source_id").alias("_s"), "values")
    out = found
    for side in "ab":
        out = out.join(at, F.col(f"{side}_id") == F.col("_s")).withColumn(f"_{side}", snippet("values", F.col(f"{side}_pos"), F.col("tokens"))).drop("_s", "values")
    return out.withColumn("fingerprint", pair_hash("_a", "_b")).drop("_a", "_b")


def build(marked: DataFrame) -> DataFrame:
    return marked.groupBy("fingerprint").agg(F.count("*").alias("n"))


def mark_new(marked: DataFrame, baseline: DataFrame) -> DataFrame:
    """is_new: past the first n of a fingerprint in the clones' order, n being what the baseline accepts."""
    by = Window.partitionBy("fingerprint").orderBy("a_id", "a_pos", "b_id", "b_pos")
    return marked.withColumn("_k", F.row_number().over(by)).join(baseline, "fingerprint", "left").withColumn("is_new", F.col("_k") > F.coalesce("n", F.lit(0))).drop("_k", "n")


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row: added, removed, total, with multiplicity."""
    both = old.select("fingerprint", F.col("n").alias("o")).join(new.select("fingerprint", F.col("n").alias("w")), "fingerprint", "full").fillna(0)
    return both.agg(F.coalesce(F.sum(F.greatest(F.col("w") - F.col("o"), F.lit(0))), F.lit(0)).alias("added"), F.coalesce(F.sum(F.greatest(F.col("o") - F.col("w"), F.lit(0))), F.lit(0)).alias("removed"), F.coalesce(F.sum("w"), F.lit(0)).alias("total"))


VERSION = 1


def save(baseline: DataFrame, path: str) -> None:
    """A JSON file of sorted fingerprints, one a line, that reviews and merges well; accepted clones are few enough to be reviewed."""
    found = {r.fingerprint: r.n for r in baseline.orderBy("fingerprint").toLocalIterator()}
    with open(path, "w") as f:
        json.dump({"version": VERSION, "fingerprints": found}, f, indent=1, sort_keys=True)


def load(spark: SparkSession, path: str) -> DataFrame:
    """(fingerprint, n) of such a file; a later version is refused."""
    if not os.path.exists(path):
        raise FileNotFoundError(f"no baseline at {path}: update it first")
    with open(path) as f:
        raw = json.load(f)
    if raw.get("version", 0) > VERSION:
        raise ValueError(f"{path}: version {raw['version']} is newer than {VERSION}")
    return spark.createDataFrame(sorted(raw["fingerprints"].items()), "fingerprint string, n long")
