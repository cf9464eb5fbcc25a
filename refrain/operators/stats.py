"""Statistics, profiles and gates over sources and clones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tokens that count as decisions.
DECISIONS = ["if", "elif", "elsif", "elseif", "unless", "for", "foreach", "while", "until", "case", "cond", "when", "catch", "rescue", "except", "andalso", "orelse", "&&", "||", "and", "or", "?", "??"]


def source_sizes(arrays: DataFrame) -> DataFrame:
    """(pool, source_id, lines, tokens): lines is the line of the last token."""
    return arrays.select("pool", "source_id", F.coalesce(F.array_max("lines"), F.lit(0)).cast("long").alias("lines"), F.size("values").cast("long").alias("tokens"))


def percentage(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part * 100.0 / whole).otherwise(F.lit(0.0))


def percentage_rounded(part: Column, whole: Column) -> Column:
    """Two decimals, half up."""
    return F.when(whole > 0, F.floor(part * 10000.0 / whole + 0.5) / 100).otherwise(F.lit(0.0))


def statistics(sizes: DataFrame, lined: DataFrame) -> DataFrame:
    """Per pool and in total (pool ``*``): sources, lines, tokens, clones, duplicated_lines, duplicated_tokens, percentage, percentage_tokens; of clones with is_new also new_clones and new_duplicated_lines."""
    of = sizes.groupBy("pool").agg(F.count("*").alias("sources"), F.sum("lines").alias("lines"), F.sum("tokens").alias("tokens"))
    new = [F.count_if("is_new").alias("new_clones"), F.sum(F.when(F.col("is_new"), F.col("a_end") - F.col("a_start")).otherwise(0)).cast("long").alias("new_duplicated_lines")] if "is_new" in lined.columns else []
    made = lined.groupBy("pool").agg(F.count("*").alias("clones"), F.sum(F.col("a_end") - F.col("a_start")).cast("long").alias("duplicated_lines"), F.sum("tokens").cast("long").alias("duplicated_tokens"), *new)
    per = of.join(made, "pool", "left").fillna(0)
    names = ["sources", "lines", "tokens", "clones", "duplicated_lines", "duplicated_tokens", *(["new_clones", "new_duplicated_lines"] if new else [])]
    total = per.rollup("pool").agg(*[F.sum(n).cast("long").alias(n) for n in names], F.grouping("pool").alias("_all"))
    return total.select(F.when(F.col("_all") == 1, "*").otherwise(F.col("pool")).alias("pool"), *names, percentage(F.col("duplicated_lines"), F.col("lines")).alias("percentage"), percentage(F.col("duplicated_tokens"), F.col("tokens")).alias("percentage_tokens"))


def source_duplication(lined: DataFrame) -> DataFrame:
    """(source_id, clones, duplicated_lines): both sides count for their source."""
    side = lambda x: F.struct(F.col(f"{x}_id").alias("source_id"), (F.col(f"{x}_end") - F.col(f"{x}_start")).alias("lines"))
    return lined.select(F.explode(F.array(side("a"), side("b"))).alias("s")).groupBy("s.source_id").agg(F.count("*").alias("clones"), F.sum("s.lines").cast("long").alias("duplicated_lines"))


def complexity(arrays: DataFrame) -> DataFrame:
    """(source_id, complexity): one more than the source's decision words, in either case."""
    words = F.array(*[F.lit(w) for w in DECISIONS])
    return arrays.select("pool", "source_id", (F.size(F.filter("values", lambda v: F.array_contains(words, F.lower(v)))) + 1).cast("long").alias("complexity"))


def interval_union(spans: DataFrame, key: str) -> DataFrame:
    """(key, start, end) of maximal unions of closed intervals; adjacent ones are one."""
    from pyspark.sql import Window

    by = Window.partitionBy(key).orderBy("start", "end")
    before = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_new", (before.isNull() | (F.col("start") > before + 1)).cast("int")).withColumn("_g", F.sum("_new").over(by))
    return marked.groupBy(key, "_g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_g")


def statistics_levels(sizes: DataFrame, lined: DataFrame) -> DataFrame:
    """(level, pool, source_id, sources, lines, tokens, clones, duplicated_lines, duplicated_tokens, percentage, percentage_tokens) of all, each pool and each source.

    A clone counts once in its pool and in all, and on both sides for its sources; percentages are rounded half up to two decimals.
    """
    side = lambda x, whole: F.struct(F.col(f"{x}_id").alias("source_id"), (F.col(f"{x}_end") - F.col(f"{x}_start")).cast("long").alias("n"), F.lit(whole).alias("once"))
    each = lined.select("pool", "tokens", F.explode(F.array(side("a", 1), side("b", 0))).alias("s")).select("pool", "s.*", "tokens")
    per = each.groupBy("pool", "source_id").agg(F.count("*").alias("c"), F.sum("n").alias("n"), F.sum("tokens").alias("t"), F.sum("once").alias("c1"), F.sum(F.col("n") * F.col("once")).alias("n1"), F.sum(F.col("tokens") * F.col("once")).alias("t1"))
    every = sizes.join(per, ["pool", "source_id"], "left").fillna(0)
    sums = {n: F.sum(n) for n in ("lines", "tokens", "c", "n", "t", "c1", "n1", "t1")}
    out = every.groupingSets([[], ["pool"], ["pool", "source_id"]], "pool", "source_id").agg(F.grouping_id().alias("g"), F.count("*").alias("sources"), *[f.cast("long").alias(f"_{n}") for n, f in sums.items()])
    own = lambda x: F.when(F.col("g") == 0, F.col(f"_{x}")).otherwise(F.col(f"_{x}1"))
    out = out.select(F.when(F.col("g") == 0, "source").when(F.col("g") == 1, "pool").otherwise("total").alias("level"), "pool", "source_id", "sources", F.col("_lines").alias("lines"), F.col("_tokens").alias("tokens"), own("c").alias("clones"), own("n").alias("duplicated_lines"), own("t").alias("duplicated_tokens"))
    return out.withColumns({"percentage": percentage_rounded(F.col("duplicated_lines"), F.col("lines")), "percentage_tokens": percentage_rounded(F.col("duplicated_tokens"), F.col("tokens"))})


def summary(files: DataFrame, lined: DataFrame, by: str = "tokens", top: int = 10) -> tuple[DataFrame, DataFrame]:
    """The first files and folders of ``files`` (path, folder, lines, tokens, bytes, complexity) by a metric, with their duplicated lines (both sides count)."""
    made = source_duplication(lined).select(F.regexp_replace(F.col("source_id").cast("string"), r"(?<=..):[a-z0-9+-]+$", "").alias("path"), "duplicated_lines").groupBy("path").agg(F.sum("duplicated_lines").alias("duplicated_lines"))
    whole = files.withColumn("path", F.col("path").cast("string")).join(made, "path", "left").fillna(0, ["duplicated_lines"])
    metric = {"size": "bytes"}.get(by, by)
    folders = whole.groupBy("folder").agg(F.count("*").alias("files"), *[F.sum(c).alias(c) for c in ("lines", "tokens", "bytes", "complexity", "duplicated_lines")])
    return whole.orderBy(F.desc(metric), "path").limit(top), folders.orderBy(F.desc(metric), "folder").limit(top)
