"""Sources from files: scanned, filtered by what is known of them before they are read, decoded, and told apart by format."""

from __future__ import annotations

import os
import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refrain.functions.scalars import relative_to
from refrain.sources import formats
from refrain.sources.options import Options, parse_size
from refrain.sources.paths import gitignore_rules, glob_regex, ignored


def gitignore(spark: SparkSession, root: str, excludes: str | None = None) -> list[tuple[str, bool, bool]]:
    """Rules of the ignore files of a tree, wherever Spark can read it; a later rule decides over an earlier one.

    First those of ``excludes`` (a file of the user's own), then the repository's own
    exclude file, then the ignore files of the root and of the folders below it, each for
    what lies under its folder.
    """
    jvm = spark.sparkContext._jvm
    at = lambda path: jvm.org.apache.hadoop.fs.Path(path)
    base = root.rstrip("/")
    store = at(base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def text(path) -> str:
        stream = store.open(path)
        try:
            return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    rules: list[tuple[str, bool, bool]] = []
    for path in filter(None, (excludes, f"{base}/.git/info/exclude")):
        if store.exists(at(path)):
            rules += gitignore_rules(text(at(path)))
    found, whole = [], store.makeQualified(at(base)).toUri().getPath().rstrip("/")
    listed = store.listFiles(at(base), True) if store.exists(at(base)) and store.getFileStatus(at(base)).isDirectory() else None
    while listed is not None and listed.hasNext():
        path = listed.next().getPath()
        folder = path.getParent().toUri().getPath().removeprefix(whole).strip("/")
        if path.getName() == ".gitignore" and ".git" not in folder.split("/"):
            found.append((folder, path))
    for folder, path in sorted(found, key=lambda x: (x[0].count("/") + bool(x[0]), x[0])):  # parents first
        rules += gitignore_rules(text(path), folder)
    return rules


def walk(spark: SparkSession, root: str, options: Options, rules: list[tuple[str, bool, bool]] = ()) -> DataFrame:
    """(source_id, root, format, content, bytes) of one root's files. Sizes and paths are tested before contents are read.

    Invalid UTF-8 drops a file, or is replaced sign by sign if options say lossy.
    """
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    found = read.load(root).where(F.col("length") <= parse_size(options.max_size))
    path = F.regexp_replace("path", r"^file:/+", "/")
    if not options.follow_links:
        found = found.where(~path.isin(links(root)))
    found = found.withColumn("_inner", relative_to(path, root)).withColumn("source_id", path if options.absolute else F.col("_inner"))
    if options.pattern:
        found = found.where(F.col("source_id").rlike(glob_regex(options.pattern)))
    for glob in options.ignore:
        found = found.where(~F.col("source_id").rlike(glob_regex(glob)))
    if rules:
        found = found.where(~ignored(F.col("_inner"), list(rules)))
    decode = F.make_valid_utf8 if options.lossy else F.try_validate_utf8
    found = found.withColumn("content", decode(F.col("content").cast("string"))).where("content is not null")
    found = found.withColumn("format", formats.detect(F.col("source_id"), F.col("content"), options.formats_exts, options.formats_names)).where("format is not null")
    if options.formats:
        found = found.where(F.col("format").isin(options.formats))
    lines = F.size(F.split("content", "\n", -1)) - F.when(F.col("content").endswith("\n"), 1).otherwise(0)
    found = found.where(lines >= options.min_lines)
    if options.max_lines:
        found = found.where(lines <= options.max_lines)
    return found.select("source_id", F.lit(root).alias("root"), "format", "content", F.col("length").alias("bytes"))


def links(root: str) -> list[str]:
    """Symbolic links among the files of a local tree; stores without links have none."""
    local = re.sub("^file:/+", "/", root)
    return [path for folder, _, names in os.walk(local) for name in names if os.path.islink(path := os.path.join(folder, name))] if os.path.isdir(local) else []


def scan(spark: SparkSession, options: Options, rules: list[tuple[str, bool, bool]] = ()) -> DataFrame:
    own = lambda root: [*(gitignore(spark, root, options.excludes_file) if options.gitignore else ()), *rules]
    return reduce(DataFrame.unionByName, [walk(spark, p, options, own(p)) for p in options.paths])


def snippet(spark: SparkSession, code: str, fmt: str) -> DataFrame:
    """One source of a string."""
    return spark.createDataFrame([("snippet", fmt, code, len(code.encode()))], "source_id string, format string, content string, bytes long")


def pooled(sources: DataFrame, groups: list[list[str]]) -> DataFrame:
    """``pool``: the format, or the group of formats that share one."""
    out = F.col("format")
    for group in groups:
        out = F.when(F.col("format").isin(group), F.lit("+".join(sorted(group)))).otherwise(out)
    return sources.withColumn("pool", out)


def parse_blame(porcelain: DataFrame) -> DataFrame:
    """(source_id, line, sha, author, ts) of line-porcelain texts (source_id, porcelain)."""
    entry = r"(?m)^([0-9a-f]{40}) \d+ (\d+)[^\n]*\nauthor ([^\n]*)\n(?:[a-z-]+[^\n]*\n)*?author-time (\d+)"
    part = lambda i: F.regexp_extract_all("porcelain", F.lit(entry), F.lit(i))
    each = porcelain.select("source_id", F.explode(F.arrays_zip(part(1).alias("sha"), part(2).alias("line"), part(3).alias("author"), part(4).alias("ts"))).alias("e"))
    return each.select("source_id", F.col("e.line").cast("int").alias("line"), "e.sha", "e.author", F.col("e.ts").cast("long").alias("ts"))
