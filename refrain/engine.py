"""From options to clones, statistics, reports and an exit code; and a resident engine that answers checks of snippets.

Extension points are plain functions: ``mode`` may be a predicate on token columns,
``hash_function`` maps an array of token values to what windows are made of, validators
are conditions on clones (all must hold), hooks map clones to clones, subscribers get
what a run observed, reporters get clones and statistics.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from refrain.operators import baseline, code, detect, snippets, stats
from refrain.reports import writers
from refrain.sources import files, formats
from refrain.functions.scalars import clean_id, parent_dir
from refrain.sources.options import Options
from refrain.sources.stores import get_store


@dataclass
class Extensions:
    mode: Callable[[], Column] | None = None
    hash_function: Callable[[Column], Column] | None = None
    validators: list[Callable[[], Column]] = field(default_factory=list)
    hooks: list[Callable[[DataFrame], DataFrame]] = field(default_factory=list)
    subscribers: list[Callable[[str, dict], None]] = field(default_factory=list)
    reporters: list[Callable[[DataFrame, DataFrame], None]] = field(default_factory=list)


@dataclass
class Result:
    clones: DataFrame
    statistics: DataFrame
    arrays: DataFrame
    sources: DataFrame | None = None
    observation: Observation | None = None

    def observed(self) -> dict:
        """What passed the first action over the clones; waits for it."""
        return self.observation.get if self.observation else {}

    def summary(self, by: str = "tokens", top: int = 10) -> tuple[DataFrame, DataFrame]:
        """The first files and folders; a file's sections count together."""
        whole = lambda df: df.withColumn("path", clean_id(F.col("source_id").cast("string")))
        sizes = whole(stats.source_sizes(self.arrays)).groupBy("path").agg(F.max("lines").alias("lines"), F.sum("tokens").alias("tokens"))
        points = whole(stats.complexity(self.arrays)).groupBy("path").agg((F.sum("complexity") - F.count("*") + 1).alias("complexity"))
        own = self.sources.select(F.col("source_id").cast("string").alias("path"), F.col("bytes").cast("long").alias("bytes"))
        files_of = sizes.join(points, "path").join(own, "path").withColumn("folder", parent_dir(F.col("path")))
        return stats.summary(files_of, self.clones, by, top)

    def exit_code(self, options: Options, allowed_new: int | None = None) -> int:
        """The options' code if anything repeats, 1 past the threshold or the allowed new clones, else 0."""
        if options.threshold is not None and writers.exceeds(self.statistics, options.threshold):
            return 1
        if allowed_new is not None and "is_new" in self.clones.columns and self.clones.where("is_new").count() > allowed_new:
            return 1
        return options.exit_code if options.exit_code and self.clones.limit(1).count() else 0


def token_arrays(sources: DataFrame, options: Options, extensions: Extensions | None = None) -> DataFrame:
    """(source_id, pool, values, lines) of all sections of all sources; a section of another format than its file is ``id:format``."""
    extensions = extensions or Extensions()
    typed = any({"javascript", "jsx"} & set(g) and {"typescript", "tsx"} & set(g) for g in options.cross_formats)
    said = {"ignore_case": options.ignore_case, "ignore_pattern": options.ignore_pattern, "erase": typed}
    if extensions.mode:
        each = code.tokens(sources, "strict", **said).where(extensions.mode())
        made = each.groupBy("source_id", "format").agg(F.array_sort(F.collect_list(F.struct("offset", "pos", "value", "line"))).alias("x"))
        made = made.select("source_id", "format", F.col("x.value").alias("values"), F.col("x.line").alias("lines"))
    else:
        made = code.arrays(sources, options.mode, **said)
    own = sources.select(F.col("source_id").alias("_s"), F.col("format").alias("_f"))
    named = made.join(own, F.col("source_id") == F.col("_s")).select(F.when(F.col("format") == F.col("_f"), F.col("source_id")).otherwise(F.concat_ws(":", "source_id", "format")).alias("source_id"), "format", "values", "lines")
    if extensions.hash_function:
        named = named.withColumn("values", extensions.hash_function(F.col("values")))
    return files.pooled(named, options.cross_formats).where(F.size("values") >= options.min_tokens).select("source_id", "pool", "values", "lines")


def run(spark: SparkSession, options: Options, sources: DataFrame | None = None, extensions: Extensions | None = None, accepted: DataFrame | None = None) -> Result:
    """Clones and statistics of the options' paths, or of ``sources`` (source_id, root, format, content, bytes).

    ``accepted`` is a baseline (fingerprint, n): clones past it are marked is_new.
    """
    extensions, began = extensions or Extensions(), time.perf_counter()
    sources = files.scan(spark, options) if sources is None else sources
    arrays = token_arrays(sources, options, extensions)
    homes = None
    if options.skip_local or options.skip_isolated:
        homes = arrays.select("source_id", F.regexp_replace("source_id", ":[a-z0-9+-]+$", "").alias("_file")).join(sources.select(F.col("source_id").alias("_s"), "root"), F.col("_file") == F.col("_s"))
        homes = homes.select("source_id", "root", F.regexp_extract("_file", "^([^/]*)/", 1).alias("folder"))

    def allowed(runs: DataFrame) -> DataFrame:
        runs = runs.where(detect.min_lines(options.min_lines))
        if homes is not None:
            runs = detect.with_attribute(detect.with_attribute(runs, homes, "root"), homes, "folder")
        if options.skip_local:
            runs = runs.where(detect.skip_local("root"))
        return runs.where(detect.skip_isolated(options.skip_isolated)) if options.skip_isolated else runs

    windows = detect.windows(arrays, options.min_tokens)
    primary = allowed(detect.with_lines(detect.islands(detect.hits(windows), options.min_tokens), arrays))
    more = detect.secondary(detect.secondary_candidates(windows, options.min_tokens), primary, arrays, options.min_tokens, allowed)
    found = primary.select(*more.columns).unionByName(more)
    found = detect.dedup(found)
    if homes is not None:
        found = detect.with_attribute(detect.with_attribute(found, homes, "root"), homes, "folder")
    for validator in extensions.validators:
        found = found.where(validator())
    for hook in extensions.hooks:
        found = found.transform(hook)
    if accepted is not None:
        found = baseline.mark_new(baseline.fingerprints(found, arrays), accepted)
    statistics = stats.statistics(stats.source_sizes(arrays), found)
    observation = Observation() if extensions.subscribers else None
    if observation:
        found = found.observe(observation, F.count("*").alias("clones"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    result = Result(found, statistics, arrays, sources, observation)
    for tell in extensions.subscribers:
        tell("planned", {"seconds": time.perf_counter() - began})
    for report in extensions.reporters:
        report(result.clones, result.statistics)
    return result


def baseline_from(spark: SparkSession, options: Options, sources: DataFrame | None = None) -> DataFrame:
    """A baseline of another snapshot (a tree checked out at a reference, or its ``sources``), by the same options."""
    before = run(spark, options, sources)
    return baseline.build(baseline.fingerprints(before.clones, before.arrays))


class Listed(list):
    """The first rows of an answer, and how many there are in all (``total``)."""

    def __init__(self, rows: DataFrame, order: list, limit: int):
        super().__init__(r.asDict() for r in rows.orderBy(*order).limit(limit).collect())
        self.total = len(self) if len(self) < limit else rows.count()


class Engine:
    """A resident index: built once, asked for snippets, files and statistics, built anew by recheck()."""

    def __init__(self, spark: SparkSession, options: Options, sources: DataFrame | None = None):
        self.spark, self.options, self.sources = spark, options, sources
        self.scanning = False
        self.recheck()

    def recheck(self) -> dict:
        """Scans anew and replaces the index; refused while another scan runs."""
        if self.scanning:
            raise RuntimeError("a scan is running")
        self.scanning = True
        try:
            self.result = run(self.spark, self.options, self.sources)
            self.index = get_store(self.options.store, self.options.store_namespace)(snippets.index_of(self.result.arrays, self.options.min_tokens), self.options.store_path)
        finally:
            self.scanning = False
        return self.health()

    def check_duplication(self, text: str, fmt: str, limit: int = 50) -> Listed:
        """Passages of a snippet that the index holds, longest first, and how many there are."""
        name = formats.resolve_format(fmt)
        if name is None:
            raise ValueError(f"unknown format {fmt!r}")
        own = token_arrays(files.snippet(self.spark, text, name), self.options)
        runs = snippets.check(own, self.index, self.options.min_tokens)
        lined = own.select(F.col("source_id").alias("snippet_id"), "lines")
        out = runs.join(lined, "snippet_id").select("source_id", "tokens", F.get("lines", "pos").alias("start"), F.get("lines", (F.col("pos") + F.col("tokens") - 1).cast("int")).alias("end"))
        return Listed(out, [F.desc("tokens"), "source_id", "start"], limit)

    def get_file_clones(self, path: str, limit: int = 50) -> Listed:
        """Clones that touch a file or one of its sections, in order, and how many there are."""
        of = lambda x: (F.col(x) == path) | F.col(x).startswith(f"{path}:")
        return Listed(self.result.clones.where(of("a_id") | of("b_id")), ["a_id", "a_start", "b_id", "b_start"], limit)

    def get_statistics(self) -> list[dict]:
        return [r.asDict() for r in self.result.statistics.collect()]

    def check_directory(self, path: str) -> list[dict]:
        """Statistics of a directory by the same options, beside the index."""
        return [r.asDict() for r in run(self.spark, replace(self.options, paths=[path])).statistics.collect()]

    def health(self) -> dict:
        return {"status": "scanning" if self.scanning else "ready"}

    def close(self) -> None:
        if self.index is not None:
            self.index.unpersist()
        self.index = self.result = None


def overlay(over: DataFrame, base: DataFrame) -> DataFrame:
    """An index that reads ``over`` first and ``base`` for windows that it lacks."""
    return over.unionByName(base.join(over, ["pool", "whash"], "left_anti"))
