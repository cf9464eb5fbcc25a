"""Checks of snippets against a stored index of windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refrain.operators import detect


def write_index(arrays: DataFrame, k: int, path: str) -> None:
    """First occurrences of all windows as Parquet, in the runs that they are shuffled in, sorted by key in each file so that a probe's row groups are pruned by their statistics."""
    detect.firsts(detect.windows(arrays, k)).write.mode("overwrite").parquet(path)


def _each(runs: DataFrame) -> DataFrame:
    """Runs of first occurrences as (pool, whash, first)."""
    return detect.each_window(runs).select("pool", "whash", F.struct("source_id", "pos", "n").alias("first"))


def _of_probe(runs: DataFrame, probe: DataFrame) -> DataFrame:
    """Runs of a key that the probe has."""
    return runs.join(probe.select("key").distinct(), "key", "left_semi").select(*runs.columns)


def index_of(arrays: DataFrame, k: int, probe: DataFrame | None = None) -> DataFrame:
    """(pool, whash, first): the first occurrence of each window; with ``probe`` (arrays of snippets) only of windows that it has, so that no others are shuffled."""
    found = detect.windows(arrays, k)
    if probe is None:
        return _each(detect.firsts(found))
    asked = detect.windows(probe, k)
    return _each(detect.firsts(_of_probe(found, asked))).join(detect.each_window(asked).select("pool", "whash").distinct(), ["pool", "whash"], "left_semi")


def check(snippets: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """Runs (snippet_id, pos, source_id, source_pos, tokens) of the snippets' windows that the index holds, be it a stored one or one of windows."""
    probe = detect.windows(snippets, k)
    if "key" in index.columns:
        index = _each(_of_probe(index, probe))
    found = detect.each_window(probe).join(index, ["pool", "whash"]).select("pool", F.col("source_id"), "pos", F.lit(1).alias("c"), "first")
    made = detect.islands(found, k)
    return made.select(F.col("b_id").alias("snippet_id"), F.col("b_pos").alias("pos"), F.col("a_id").alias("source_id"), F.col("a_pos").alias("source_pos"), "tokens")


def coverage(runs: DataFrame, snippets: DataFrame) -> DataFrame:
    """(snippet_id, tokens, covered, percentage): distinct tokens of each snippet that any run covers."""
    each = runs.select("snippet_id", F.explode(F.sequence(F.col("pos").cast("long"), F.col("pos") + F.col("tokens") - 1)).alias("p")).groupBy("snippet_id").agg(F.count_distinct("p").alias("covered"))
    whole = snippets.select(F.col("source_id").alias("snippet_id"), F.size("values").cast("long").alias("tokens"))
    covered = F.coalesce("covered", F.lit(0))
    return whole.join(each, "snippet_id", "left").select("snippet_id", "tokens", covered.alias("covered"), F.when(F.col("tokens") > 0, covered * 100.0 / F.col("tokens")).otherwise(F.lit(0.0)).alias("percentage"))


def line_coverage(runs: DataFrame, snippets: DataFrame) -> DataFrame:
    """(snippet_id, lines, covered, percentage): distinct lines of each snippet that any run touches; lines is the last token's line."""
    own = snippets.select(F.col("source_id").alias("snippet_id"), "lines")
    last = F.get("lines", (F.col("pos") + F.col("tokens") - 1).cast("int"))
    each = runs.join(own, "snippet_id").select("snippet_id", F.explode(F.sequence(F.get("lines", F.col("pos").cast("int")), last)).alias("line"))
    made = each.groupBy("snippet_id").agg(F.count_distinct("line").alias("covered"))
    whole = own.select("snippet_id", F.coalesce(F.array_max("lines"), F.lit(0)).cast("long").alias("lines"))
    covered = F.coalesce("covered", F.lit(0))
    return whole.join(made, "snippet_id", "left").select("snippet_id", "lines", covered.alias("covered"), F.when(F.col("lines") > 0, covered * 100.0 / F.col("lines")).otherwise(F.lit(0.0)).alias("percentage"))
