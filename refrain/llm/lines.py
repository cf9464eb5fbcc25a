"""Line dedup by a segment-partition edit join, with DataFrame functions only.

Of all lines of at least ``min_chars`` code points, in the order of (doc_id, line number),
a line goes if an earlier line is equal or within ``max_edits`` edits.

Equal lines are one class, found by 128 bits of hash. Each class cuts its line into
max_edits + 1 even segments. Whatever the edits, one segment of the shorter line survives
whole in the longer, at a place that the lengths bound; so each class is indexed by its
segments, keyed by length, number and content, and probes the indexes of its own and
the next shorter lengths with the few substrings that can match (multi-match-aware
windows). Classes that share a key are verified by Spark's levenshtein with a
threshold, which fills a band of 2 * max_edits + 1 diagonals and stops beyond it. One
earlier partner is enough, so all joins are semi joins: a key that many classes share
makes no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refrain.llm.common import let, materialise


def _start(i: int, n: int, d: int) -> str:
    """0-based start of the i-th of n even segments of a line d characters shorter than ``len``; the longer segments come last."""
    return f"cast((len - {d}) div {n} * {i} + greatest(0, {i - n} + (len - {d}) % {n}) as int)"


def _index(max_edits: int) -> list[Column]:
    n, out = max_edits + 1, []
    for i in range(n):
        at, end = _start(i, n, 0), _start(i + 1, n, 0)
        out.append(F.expr(f"hash(len, {i}, substring(line, {at} + 1, {end} - {at}))"))
    return out


def _probes(max_edits: int) -> list[Column]:
    """Keys of the substrings that may equal segment i of a line d characters shorter."""
    n, out = max_edits + 1, []
    for d in range(max_edits + 1):
        for i in range(n):
            at, end = _start(i, n, d), _start(i + 1, n, d)
            for shift in range(max(-i, d - (max_edits - i)), min(i, d + (max_edits - i)) + 1):
                inside = f"{at} + {shift} >= 0 and {end} + {shift} <= len"
                out.append(F.expr(f"if({inside}, hash(len - {d}, {i}, substring(line, {at} + {shift} + 1, {end} - {at})), null)"))
    return out


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """Every line that takes part: where it is, two hashes and its length."""
    return (
        docs.select("doc_id", F.xxhash64("text").alias("th"), F.split("text", "\n", -1).alias("lines"))  # before lines are dealt out, or each would hash the text anew
        .select("doc_id", "th", F.posexplode_outer("lines").alias("pos", "line"))
        .withColumn("len", F.length("line"))
        .where(F.col("len") >= min_chars)
        .select("doc_id", "th", "pos", "line", "len", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("h2"))
    )


def classes(docs: DataFrame, min_chars: int, max_edits: int) -> DataFrame:
    """One row for each distinct line: its hashes, first place, how often it stands, and its keys."""
    seen = _lines(docs, min_chars)
    keys = F.array(*_index(max_edits), *_probes(max_edits))  # 32 bits each do: what shares a key is verified
    first = F.min(F.struct("doc_id", "th", "pos", keys.alias("keys")))
    return seen.groupBy("h", "h2").agg(first.alias("f"), F.count("*").alias("n")).select("h", "h2", "n", "f.*")


def near(docs: DataFrame, known: DataFrame, max_edits: int) -> DataFrame:
    """(h, h2) of the classes that are within max_edits edits of a class that stands earlier."""
    n = max_edits + 1
    index = known.select("h", F.explode(F.slice("keys", 1, n)).alias("k"))
    probe = known.select("h", F.explode(F.filter(F.slice("keys", n + 1, 10_000), lambda k: k.isNotNull())).alias("k"))

    def meets(x: DataFrame, y: DataFrame, on) -> DataFrame:
        x, y = x.alias("x"), y.alias("y")
        return x.join(y, (F.col("x.k") == F.col("y.k")) & on, "left_semi")

    # keys that meet another class: semi joins, so that a key which many classes share makes no pairs
    other = F.col("x.h") != F.col("y.h")
    live = meets(index, probe, other).withColumn("own", F.lit(True)).union(meets(probe, index, other).withColumn("own", F.lit(False)))
    live = materialise(live, "keys")  # in one query, so that both joins read the same shuffles
    index, probe = live.where("own").drop("own"), live.where("not own").drop("own")
    wanted = index.select("h").union(probe.select("h")).distinct()
    where = materialise(known.join(wanted, "h", "left_semi").select("h", "h2", "doc_id", "th", "pos"), "where")
    where = where.groupBy(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).agg(F.collect_list(F.struct("h", "h2", "pos")).alias("want"))
    texts = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    read = lambda lines: F.transform("want", lambda x: F.struct(x["h"].alias("h"), x["h2"].alias("h2"), x["pos"].alias("pos"), F.get(lines, x["pos"]).alias("line")))
    told = texts.join(where, texts["doc_id"].eqNullSafe(where["_id"]) & (texts["th"] == where["_th"])).select("doc_id", "th", F.explode_outer(let(F.split("text", "\n", -1), read)).alias("x"))
    told = materialise(told.select("x.h", "x.h2", F.struct("doc_id", "th", "x.pos").alias("at"), "x.line"), "told")
    index, probe = materialise(index.join(told, "h"), "index"), materialise(probe.join(told, "h"), "probe")
    earlier = (F.col("y.at") < F.col("x.at")) & (F.levenshtein("x.line", "y.line", max_edits) >= 0)
    return meets(index, probe, earlier).select("h", "h2").union(meets(probe, index, earlier).select("h", "h2")).distinct()


def dedup(docs: DataFrame, min_chars: int = 20, max_edits: int = 2) -> DataFrame:
    """``docs`` (columns doc_id, text; all columns stay) without the lines that repeat an earlier one, and with n_lines, n_exact, n_near.

    n_exact counts lines removed as equal to an earlier line, n_near the others removed. A
    null text stays null with counts of 0; an empty one is one empty line; a text of which
    every line goes is empty. Columns that were named so before are replaced. Lines shorter than ``min_chars`` always stay. Null ids come
    first in the order; rows of equal ids are ordered by a hash of their texts, and rows
    equal in both lose lines alike. An empty table gives no rows.
    """
    known = materialise(classes(docs, min_chars, max_edits), "lines")
    close = materialise(near(docs, known, max_edits).withColumn("near", F.lit(True)), "near")
    at = known.select("h", "h2", "n", F.struct("doc_id", "th", "pos").alias("first")).join(close, ["h", "h2"], "left").where("n > 1 or near").select("h", "h2", "first", F.coalesce("near", F.lit(False)).alias("near"))
    at = materialise(at, "repeats")
    gone = (
        _lines(docs, min_chars)
        .select("h", "h2", F.struct("doc_id", "th", "pos").alias("at"))
        .join(at, ["h", "h2"])
        .where("near or at != first")
        .select("at.*", (F.col("at") == F.col("first")).alias("near"))
        .groupBy("doc_id", "th")
        .agg(F.collect_list("pos").alias("_gone"), F.count_if("near").alias("n_near"))
    )
    gone = materialise(gone.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "_gone", F.col("n_near").alias("_near")), "gone")
    whole = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", F.xxhash64("text").alias("h"), "text").join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_th")), "left")
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("_gone", i)), "\n")
    counts = {
        "n_lines": F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)),
        "n_exact": F.coalesce(F.size("_gone"), F.lit(0)) - F.coalesce("_near", F.lit(0)),
        "n_near": F.coalesce("_near", F.lit(0)),
    }
    stays = [F.when(F.col("_gone").isNull(), F.col("text")).otherwise(kept).alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in counts]
    return whole.select(*stays, *[n.cast("long").alias(c) for c, n in counts.items()])
