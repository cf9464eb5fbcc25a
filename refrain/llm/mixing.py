"""Mixing sources to target weights.

Tokens are summed per source; each source's target is its share of all tokens by weight,
at most ``cap`` times what it has, with the excess reshared among the others by weight.
The repetition rate is target over size: each document is emitted floor(rate) times, plus
one Bernoulli copy with the fraction as its probability, seeded by a hash of its id, source and text.

Only per-source sums pass through one task. They are written, so that their join with the
documents is a broadcast if their size on disk allows it, and otherwise a join that
adaptive execution splits where one source holds many rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refrain.llm.common import materialise

WORDS = r"[^\x20\x09-\x0D]+"


def size_of(text: str = "text") -> Column:
    """Words of a text, maximal runs of anything but ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: DataFrame | None = None, cap: int = 3) -> DataFrame:
    """(source, source_size, target, rate) from ``sizes`` (source, size).

    ``weights`` (source, weight) sets the shares; without it sources in code point order,
    null last, weigh 1, 2, 3, repeating.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    if weights is None:
        per = per.withColumn("weight", (F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1) % 3 + 1)
    else:
        per = per.join(weights.select(F.col("source").alias("_s"), "weight"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    # a source stops at its cap if even with all that stop before it, its share is above
    per = per.withColumn("_r", F.col("source_size") * cap / F.col("weight")).withColumn("_all", F.sum("source_size").over(everything)).withColumn("_w", F.sum("weight").over(everything))
    order = Window.orderBy("_r", F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_c", F.coalesce(F.sum(F.col("source_size") * cap).over(order), F.lit(0))).withColumn("_cw", F.coalesce(F.sum("weight").over(order), F.lit(0)))
    per = per.withColumn("_stops", F.col("_r") < (F.col("_all") - F.col("_c")).cast("double") / (F.col("_w") - F.col("_cw")))
    left = (F.col("_all") - F.sum(F.when(F.col("_stops"), F.col("source_size") * cap).otherwise(0)).over(everything)).cast("double")
    rest = F.sum(F.when(F.col("_stops"), 0).otherwise(F.col("weight"))).over(everything)
    target = F.when(F.col("_stops"), (F.col("source_size") * cap).cast("double")).otherwise(F.col("weight") * (left / rest))
    return per.withColumn("target", target).select("source", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"))


def copies(rate: Column, key: Column) -> Column:
    """floor(rate), plus one where the draw of ``key`` in [0, 1) is below the fraction."""
    draw = F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def draw_key(seed: str) -> Column:
    """What a document draws by: its id, source and text, so that documents without an id, or that share one, draw apart."""
    told = [F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("source", F.lit("")), F.md5(F.coalesce("text", F.lit("")))]
    return F.concat_ws(":", *told, F.lit(seed))


def plan(docs: DataFrame, weights: DataFrame | None = None, cap: int = 3, seed: str = "mix", by_id: bool = False) -> DataFrame:
    """(row, doc_id, size, source_size, target, copies) of every row of ``docs`` (columns doc_id, source, text); row holds all its columns, whatever their names.

    A null text has size 0; rows of a null source form a source; documents draw by id,
    source and text, so only rows equal in all three draw alike. With ``by_id``, those whose
    id no other row has draw by it alone, whatever was cut from their texts before. A source without words gets no copies. An empty
    table gives no rows. With ``weights``, rows of sources that it doesn't name are left out.
    """
    sized = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", F.col("source").alias("_source"), size_of().alias("size"), draw_key(seed).alias("_key"))
    aims = materialise(targets(sized.select(F.col("_source").alias("source"), "size"), weights, cap), "targets")
    if by_id:
        shared = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
        sized = sized.join(materialise(shared.select(F.col("doc_id").alias("_shared")), "shared"), F.col("doc_id") == F.col("_shared"), "left")
        lone = F.col("doc_id").isNotNull() & F.col("_shared").isNull()
        sized = sized.withColumn("_key", F.when(lone, F.concat_ws(":", F.col("doc_id").cast("string"), F.lit(seed))).otherwise(F.col("_key")))
    joined = sized.join(aims, F.col("_source").eqNullSafe(F.col("source")))
    return joined.select("row", "doc_id", "size", "source_size", "target", copies(F.col("rate"), F.col("_key")).alias("copies"))


def sizes(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) of every document."""
    return plan(docs.select("doc_id", "source", "text"), **options).select(F.col("doc_id").cast("long").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: each row of ``docs`` as many times as it is taken."""
    taken = plan(docs, **options).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
      concat_ws(':', coalesce(doc_id::VARCHAR, ''), coalesce(source, ''), md5(coalesce(text, '')), 'mix') AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
r AS (SELECT *, (source_size * 3)::DOUBLE / weight AS r FROM w),
c AS (SELECT *, sum(source_size) OVER () AS a, sum(weight) OVER () AS aw,
        coalesce(sum(source_size * 3) OVER o, 0) AS c, coalesce(sum(weight) OVER o, 0) AS cw
      FROM r WINDOW o AS (ORDER BY r, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT *, r < (a - c)::DOUBLE / (aw - cw)::DOUBLE AS stops FROM c),
t AS (SELECT source, source_size, CASE WHEN stops THEN (source_size * 3)::DOUBLE ELSE weight * (
        (a - sum(CASE WHEN stops THEN source_size * 3 ELSE 0 END) OVER ())::DOUBLE / (sum(CASE WHEN stops THEN 0 ELSE weight END) OVER ())::DOUBLE) END AS target FROM k),
p AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM t),
n AS (SELECT d.doc_id, d.size, p.source_size, p.target, (floor(rate) + CASE WHEN
        ('0x' || substr(md5(key), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM n
"""
