"""Clones and statistics as report rows, made by the engine: a row is a line of a report, and any text sink writes it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refrain.functions import scalars


def _side(x: str) -> Column:
    return F.struct(F.col(f"{x}_id").cast("string").alias("name"), F.col(f"{x}_start").alias("start"), F.col(f"{x}_end").alias("end"))


def with_fragments(lined: DataFrame, sources: DataFrame) -> DataFrame:
    """Clones with a_fragment and b_fragment: the whole lines of each side, from ``sources`` (source_id, content); a section's lines are its file's."""
    out = lined
    text = sources.select(F.col("source_id").cast("string").alias("_s"), F.split("content", "\n", -1).alias("_l"))
    for side in "ab":
        lines = F.slice("_l", F.col(f"{side}_start").cast("int"), (F.col(f"{side}_end") - F.col(f"{side}_start") + 1).cast("int"))
        out = out.join(text, scalars.clean_id(F.col(f"{side}_id").cast("string")) == F.col("_s"), "left").withColumn(f"{side}_fragment", F.array_join(lines, "\n")).drop("_s", "_l")
    return out


def _given(lined: DataFrame, name: str) -> Column:
    return F.col(name) if name in lined.columns else F.lit(None).cast("string")


def json_duplicates(lined: DataFrame) -> DataFrame:
    """One JSON object a clone; lines are the first side's span, both ends counted. Fragments and is_new are told where the clones have them."""
    more = [F.col(c).alias(n) for c, n in (("a_fragment", "fragment"), ("is_new", "isNew"), ("a_author", "firstAuthor"), ("b_author", "secondAuthor")) if c in lined.columns]
    return lined.select(F.to_json(F.struct(F.col("pool").alias("format"), (F.col("a_end") - F.col("a_start") + 1).alias("lines"), "tokens", _side("a").alias("firstFile"), _side("b").alias("secondFile"), *more)).alias("value"))


def sarif_results(lined: DataFrame, cutoff: int = 200) -> DataFrame:
    place = lambda x: F.struct(F.struct(F.struct(F.col(f"{x}_id").cast("string").alias("uri")).alias("artifactLocation"), F.struct(F.col(f"{x}_start").alias("startLine"), F.col(f"{x}_end").alias("endLine")).alias("region")).alias("physicalLocation"))
    message = F.format_string("Repeats lines %d-%d of %s (%d tokens)", F.col("a_start"), F.col("a_end"), F.col("a_id").cast("string"), F.col("tokens"))
    prints = [F.struct(F.col("fingerprint").alias("clone")).alias("partialFingerprints")] if "fingerprint" in lined.columns else []
    new = F.col("is_new") if "is_new" in lined.columns else None
    whole = F.struct(F.lit("repeated-passage").alias("ruleId"), scalars.severity(F.col("tokens"), cutoff, new=new).alias("level"), *prints, F.struct(message.alias("text")).alias("message"), F.array(place("b")).alias("locations"), F.array(place("a")).alias("relatedLocations"))
    return lined.select("pool", F.col("b_id").alias("source_id"), F.to_json(whole).alias("result"))


def files_of(lined: DataFrame) -> DataFrame:
    """The distinct files of the clones' sides, in order."""
    each = lined.select(F.explode(F.array(F.col("a_id").cast("string"), F.col("b_id").cast("string"))).alias("id"))
    return each.select(scalars.clean_id(F.col("id")).alias("value")).distinct().orderBy("value")


def xml_duplications(lined: DataFrame) -> DataFrame:
    """``<duplication>`` elements; lines are the span without its last line."""
    code = lambda x: F.coalesce(F.concat(F.lit("<codefragment>"), scalars.cdata(_given(lined, f"{x}_fragment")), F.lit("</codefragment>")), F.lit(""))
    file = lambda x: F.concat(F.format_string('<file path="%s" line="%d">', scalars.xml_escape(F.col(f"{x}_id").cast("string")), F.col(f"{x}_start")), code(x), F.lit("</file>"))
    return lined.select(F.concat(F.format_string('<duplication lines="%d" tokens="%d">', F.col("a_end") - F.col("a_start"), F.col("tokens")), file("a"), file("b"), code("a"), F.lit("</duplication>")).alias("value"))


def csv_rows(stats: DataFrame) -> DataFrame:
    """Seven columns a format; the total is named ``Total:``."""
    return stats.select(F.when(F.col("pool") == "*", "Total:").otherwise(F.col("pool")).alias("Format"), F.col("sources").alias("Files analyzed"), F.col("lines").alias("Total lines"), F.col("tokens").alias("Total tokens"), F.col("clones").alias("Clones found"), F.col("duplicated_lines").alias("Duplicated lines"), F.col("duplicated_tokens").alias("Duplicated tokens"))


def markdown_rows(stats: DataFrame) -> DataFrame:
    share = lambda n, p: F.format_string("%d (%.2f%%)", F.col(n), F.col(p))
    own = csv_rows(stats.withColumn("duplicated_lines", share("duplicated_lines", "percentage")).withColumn("duplicated_tokens", share("duplicated_tokens", "percentage_tokens")))
    return own.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[F.col(f"`{c}`").cast("string") for c in own.columns]), F.lit(" |")).alias("value"))


def metric_lines(stats: DataFrame) -> DataFrame:
    names = ["sources", "lines", "tokens", "clones", "duplicated_lines", "duplicated_tokens", "percentage", "percentage_tokens", "new_clones", "new_duplicated_lines"]
    each = stats.select("pool", *[(F.col(n) if n in stats.columns else F.lit(0)).cast("double").alias(n) for n in names]).unpivot("pool", names, "metric", "v")
    label = F.when(F.col("pool") == "*", F.lit("")).otherwise(F.concat(F.lit('{format="'), scalars.label_escape(F.col("pool")), F.lit('"}')))
    return each.select(F.concat(F.lit("duplication_"), "metric", label, F.lit(" "), F.col("v").cast("string")).alias("value"))


def compact_lines(lined: DataFrame) -> DataFrame:
    """A line a clone, short enough for a prompt."""
    return lined.select(F.format_string("%s:%d-%d ~ %s:%d-%d (%d)", F.col("a_id").cast("string"), F.col("a_start"), F.col("a_end"), F.col("b_id").cast("string"), F.col("b_start"), F.col("b_end"), F.col("tokens")).alias("value"))


def warning_lines(lined: DataFrame) -> DataFrame:
    """Lines that an editor reads as warnings."""
    at = [F.col("a_id").cast("string"), F.col("a_start"), F.col("a_end") - F.col("a_start"), F.col("a_start"), F.col("a_end"), F.col("b_id").cast("string"), F.col("b_start"), F.col("b_end")]
    return lined.select(F.format_string("%s:%d:1: warning: %d lines (%d-%d) repeated in %s (%d-%d)", *at).alias("value"))
