"""Typed tokens of texts with positions, with built-in functions only.

A token is a number, a word or one other sign; in strict mode also a run of white space.
Positions count the tokens that the mode keeps, lines count from 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Explicit classes only, so that other engines' regular expressions read it alike.
NUMBER, NAME, SIGN, BLANK = r"[0-9][0-9.]*", r"[\p{L}\p{N}_]+", r"[^\p{L}\p{N}_\x09-\x0D\x20]", r"[\x09-\x0D\x20]+"
TOKEN = f"{NUMBER}|{NAME}|{SIGN}"
STRICT = f"{TOKEN}|{BLANK}"
COMMENT = r"(#|//)[^\n]*"
KINDS = {"literal": 1, "identifier": 2, "punctuation": 3, "whitespace": 4}


def kept_text(content: Column, mode: str = "mild", ignore_case: bool = False) -> Column:
    """The text that is tokenised: without line comments in weak mode, lower-cased if cases don't count."""
    content = F.coalesce(content, F.lit(""))
    if mode == "weak":
        content = F.regexp_replace(content, COMMENT, "")
    return F.lower(content) if ignore_case else content


def token_arrays(sources: DataFrame, mode: str = "mild", ignore_case: bool = False) -> DataFrame:
    """``sources`` (source_id, pool, content) as (source_id, pool, values array, lines array): one row a source, nothing is shuffled."""
    rx = F.lit(STRICT if mode == "strict" else TOKEN)
    lines = F.split(kept_text(F.col("content"), mode, ignore_case), "\n", -1)
    each = F.flatten(F.transform(lines, lambda line, i: F.transform(F.regexp_extract_all(line, rx, F.lit(0)), lambda v: F.struct(v.alias("value"), (i + 1).alias("line")))))
    return sources.select("source_id", "pool", each.alias("_t")).select("source_id", "pool", F.col("_t.value").alias("values"), F.col("_t.line").alias("lines"))


def kind(value: str = "value") -> Column:
    v = F.col(value)
    return F.when(v.rlike(r"^[0-9]"), "literal").when(v.rlike(r"^[\p{L}\p{N}_]"), "identifier").when(v.rlike(r"^[\x09-\x0D\x20]"), "whitespace").otherwise("punctuation")


def tokens(sources: DataFrame, mode: str = "mild", ignore_case: bool = False) -> DataFrame:
    """(source_id, pool, pos, line, value, kind)."""
    arrays = token_arrays(sources, mode, ignore_case)
    return arrays.select("source_id", "pool", F.posexplode(F.arrays_zip("values", "lines")).alias("pos", "t")).select("source_id", "pool", "pos", F.col("t.lines").alias("line"), F.col("t.values").alias("value")).withColumn("kind", kind())
