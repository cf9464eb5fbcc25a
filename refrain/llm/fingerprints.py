"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash of the last seven bytes triggers chunk boundaries wherever it is -1 modulo
the block size, so that boundaries follow content. Each chunk gives one of 64 letters.
A fingerprint is ``size:letters:letters``, for a block size and its double; the size is
the smallest (3 * 2^k) that would give at most 64 chunks on average, halved while it gives fewer
than 32. Fingerprints are compared where they share a block size: by the edit distance
of their letters, and only if they have a run of letters in common.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
WINDOW, LETTERS, LEAST, RUN = 7, 64, 3, 5
#: Bytes that are hashed at a time.
CHUNK = 1 << 20


def rolling(data: np.ndarray) -> np.ndarray:
    """For each byte, a 32-bit hash of it and the six before it (fewer at the start): their sum, their sum by weight, and shifted exclusive or."""
    x = np.concatenate([np.zeros(WINDOW - 1, np.uint32), data.astype(np.uint32)])
    n = len(data)
    total, weighted, mixed = (np.zeros(n, np.uint32) for _ in range(3))
    for age in range(WINDOW):
        part = x[WINDOW - 1 - age : WINDOW - 1 - age + n]
        total += part
        weighted += part * np.uint32(WINDOW - age)
        mixed ^= part << np.uint32(5 * age)
    return total + weighted + mixed


def triggers(data: bytes, size: int) -> np.ndarray:
    """Places after which a chunk ends."""
    array, found = np.frombuffer(data, np.uint8), []
    for at in range(0, len(array), CHUNK):
        back = min(at, WINDOW - 1)
        h = rolling(array[at - back : at + CHUNK])[back:]
        found.append(np.flatnonzero(h % np.uint32(size) == size - 1) + at + 1)
    return np.concatenate(found) if found else np.array([], int)


def letters(data: bytes, ends: np.ndarray) -> str:
    """One letter for each chunk; chunks past the last letter share it."""
    bounds = [0, *ends[: LETTERS - 1].tolist()]
    if bounds[-1] < len(data):
        bounds.append(len(data))
    return "".join([ALPHABET[zlib.crc32(data[s:e]) >> 26] for s, e in zip(bounds, bounds[1:], strict=False)])


def fingerprint(data: bytes) -> str:
    size = LEAST
    while size * LETTERS < len(data):
        size *= 2
    ends = triggers(data, size)
    while size > LEAST and len(ends) + 1 < LETTERS // 2:
        size //= 2
        ends = triggers(data, size)
    return f"{size}:{letters(data, ends)}:{letters(data, triggers(data, 2 * size))}"


def edit_distance(x: str, y: str) -> int:
    """Insertions, deletions and substitutions, a column of the table at a time in one integer's bits."""
    if not x or not y:
        return len(x) + len(y)
    where: dict[str, int] = {}
    for i, c in enumerate(x):
        where[c] = where.get(c, 0) | 1 << i
    ones, last, score = (1 << len(x)) - 1, 1 << len(x) - 1, len(x)
    plus, minus = ones, 0
    for c in y:
        eq = where.get(c, 0)
        level = ((((eq & plus) + plus) ^ plus) | eq) | minus
        up, down = minus | ~(level | plus) & ones, plus & level
        score += bool(up & last) - bool(down & last)
        up, down = up << 1 | 1, down << 1
        plus, minus = (down | ~(level | up)) & ones, up & level & ones
    return score


def likeness(x: str, y: str) -> float:
    """0 to 1; 1 for equal fingerprints, 0 where no block size or no run of letters is shared."""
    if x == y:
        return 1.0
    (m, a, aa), (n, b, bb) = ((int(s), p, q) for s, p, q in (f.split(":") for f in (x, y)))
    pairs = [(a, b), (aa, bb)] if m == n else [(a, bb)] if m == 2 * n else [(aa, b)] if n == 2 * m else []
    best = 0.0
    for p, q in pairs:
        run = max(1, min(RUN, min(len(p), len(q)) // 2))
        grams = {p[i : i + run] for i in range(len(p) - run + 1)}
        if any(q[i : i + run] in grams for i in range(len(q) - run + 1)):
            best = max(best, 1 - edit_distance(p, q) / max(len(p), len(q)))
    return best


def places(cuts: np.ndarray, finer: np.ndarray, doc_id: np.ndarray, th: np.ndarray) -> np.ndarray:
    """How many of the sorted pairs (cuts, finer) are at most each row's (doc_id, th)."""
    low, high = np.searchsorted(cuts, doc_id, "left"), np.searchsorted(cuts, doc_id, "right")
    for at in np.unique(low[high > low]).tolist():  # ids that cuts name
        own = np.flatnonzero((low == at) & (high > at))
        low[own] = at + np.searchsorted(finer[at : high[own[0]]], th[own], "right")
    return low


def with_next(docs: DataFrame, rows: int = 2_000, most: int = 65_536) -> DataFrame:
    """(part, doc_id, text, only_next) such that rows sorted by (part, key) stand before their next document, whatever part it is in.

    Documents are dealt to parts of about ``rows`` rows, ``most`` parts at most, at bounds
    taken from a hash sample of about 20 distinct pairs of id and text's hash a part, so
    that an id of many texts, or none, is split too; each part also gets the first document
    of the part after it (the last: the first of all), marked ``only_next``. Only that
    sample and each part's first id pass the driver, so ``most`` bounds both.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = base.select("doc_id", F.xxhash64("text").alias("th"))
    n = docs.count()
    parts, some, finer, none = max(1, min(most, n // rows)), *[np.array([], np.int64)] * 3
    if parts > 1:
        share = min(1.0, 20 * parts / n)
        picked = keyed.where(F.pmod(F.xxhash64("doc_id", "th"), F.lit(1_000_003)) < math.ceil(share * 1_000_003)).distinct().toArrow()
        picked = picked.sort_by([("doc_id", "ascending"), ("th", "ascending")])
        picked = picked.take(np.unique(np.linspace(0, len(picked), parts + 1)[1:-1].astype(np.int64))) if len(picked) else picked
        known = picked.filter(pc.is_valid(picked["doc_id"]))  # nulls come last
        some, finer = known["doc_id"].to_numpy(), known["th"].to_numpy()
        none = picked["th"].to_numpy()[len(some) :]

    @F.pandas_udf("int")
    def number(null: pd.Series, doc_id: pd.Series, th: pd.Series) -> pd.Series:
        null, th = null.to_numpy(), th.to_numpy()
        last = len(some) + np.searchsorted(none, th, "right")
        return pd.Series(np.where(null, last, places(some, finer, doc_id.to_numpy(), th)).astype(np.int32))

    part = number(F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0).cast("long")), F.xxhash64("text")) if parts > 1 else F.lit(0)
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    firsts = base.select("doc_id", F.xxhash64("text").alias("th"), part.alias("part")).groupBy("part").agg(F.min(key).alias("first")).select("part", F.col("first.doc_id").alias("f_id"), F.col("first.th").alias("f_th"))
    firsts = sorted(firsts.collect(), key=lambda f: f.part)  # one row for each part
    dealt = base.withColumn("part", part).withColumn("th", F.xxhash64("text"))
    if not firsts:
        return dealt.withColumn("only_next", F.lit(False))
    before = {f.part: firsts[i - 1].part for i, f in enumerate(firsts)}
    told = docs.sparkSession.createDataFrame([(f.f_id, f.f_th, before[f.part]) for f in firsts], "f_id long, f_th long, to int")
    # of rows that are equal in id and text, one goes ahead
    ahead = base.withColumn("th", F.xxhash64("text")).join(F.broadcast(told), F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("th") == F.col("f_th")))
    ahead = ahead.select(F.col("to").alias("part"), "doc_id", "th", "text").dropDuplicates(["part"]).select("doc_id", "text", "part", "th", F.lit(True).alias("only_next"))
    return dealt.withColumn("only_next", F.lit(False)).unionByName(ahead)


def edits(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next) of every row of ``docs`` (doc_id, text; others are ignored).

    The edited text has its last half of code points replaced by as many, or all, of the
    next document's first. Documents follow one another by doc_id, equal ids by a hash of
    their texts, null ids last; after the last comes the first, so a single document
    follows itself. A null text counts as empty. An empty table gives no rows. ``edited`` is
    UTF-8 as binary.
    """
    names = ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches):
        mine = None  # part, doc_id, text, fingerprint of the row before
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for part, doc_id, text, ahead in zip(*batch.columns, strict=True):
                part, text = part.as_py(), text.as_py()
                if mine is not None and mine[0] == part:
                    own = mine[2]
                    half = len(own) // 2
                    edited = (own[: len(own) - half] + text[:half]).encode("utf-8", "surrogatepass")
                    nearby = fingerprint(text.encode("utf-8", "surrogatepass"))
                    changed = fingerprint(edited)
                    row = mine[1], len(own), edited, mine[3], changed, likeness(mine[3], changed), likeness(mine[3], nearby)
                    for column, x in zip(out, row, strict=True):
                        column.append(x)
                    mine = None if ahead.as_py() else (part, doc_id.as_py(), text, nearby)
                elif not ahead.as_py():
                    mine = part, doc_id.as_py(), text, fingerprint(text.encode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=names)

    lined = with_next(docs).repartition("part").sortWithinPartitions("part", "only_next", F.asc_nulls_last("doc_id"), "th")
    return lined.select("part", "doc_id", "text", "only_next").mapInArrow(run, "doc_id long, n_chars long, edited binary, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row of ``docs``: edits() with a digest of the edited text."""
    return edits(docs).select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")
