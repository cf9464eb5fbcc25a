"""Removal of repeated byte strings by the common-prefix interval tree of a sparse suffix array.

Every ``length``-byte string holds one anchor: the leftmost of its ``gram``-byte grams
with the least hash. Equal strings have equal anchors at equal places, so the suffixes
that start at anchors are a suffix array sparse enough to shuffle, and strings can only
match where their anchors' grams do.

Anchors with the same gram are first made classes: same gram, same reach, same bytes. A
class of two or more members is repeated as a whole and needs no further look. Only grams
with several classes go on, one representative each. Nodes of their common-prefix interval
tree are sets of suffixes that share so many bytes before and behind the anchor; a node may
hold a large part of the corpus, so none is scanned with a stack in one task: nodes are told
by hashes and counted with partial sums, level by level, and only below nodes that several
suffixes share. All occurrences of a node are compared, not only neighbours, and the
outermost window that is still shared, where extensions to the left or right begin to
differ, bounds what is covered.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refrain.llm.common import materialise, release

#: Bytes of a text that are hashed at a time, and how far cores lie apart.
CHUNK, STEP = 1 << 20, 16
_RANDOM = np.random.default_rng(20240229)
TABLE = _RANDOM.integers(0, 2**64, 256, np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


class Rolling:
    """Hashes of all windows of a byte string, by sums of its bytes' values times powers of an odd base, modulo 2^64."""

    def __init__(self, most: int):
        with np.errstate(over="ignore"):
            self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(most, BASE)]))
            self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(most, UNBASE)]))

    def windows(self, data: np.ndarray, width: int) -> np.ndarray:
        n = len(data)
        with np.errstate(over="ignore"):
            total = np.concatenate([[np.uint64(0)], np.cumsum(TABLE[data] * self.up[:n])])
            x = (total[width:] - total[:-width]) * self.down[: n - width + 1]
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            return x ^ (x >> np.uint64(31))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def anchors_of(data: bytes, rolling: Rolling, length: int, gram: int):
    """(gram's hash, anchor, first window's start, last window's start) for every anchor of a byte string."""
    array = np.frombuffer(data, np.uint8)
    for at in range(0, len(data) - length + 1, CHUNK):
        part = array[at : at + CHUNK + length - 1]
        h = rolling.windows(part, gram)
        where = np.arange(len(h), dtype=np.uint64)
        least = sliding_min((h & ~np.uint64(0xFFFFFF)) | where, length - gram + 1)
        place = (least & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.append(first[1:], len(place)) - 1
        yield h[place[first]].view(np.int64), place[first] + at, first + at, last + at


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of half-open spans; those that touch are one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], end)
        else:
            out.append((start, end))
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.coalesce("text", F.lit("")).cast("binary").alias("data"))


def anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    names = ["h", "dlo", "dhi", "f", "doc_id", "th", "a"]

    def run(batches):
        rolling = Rolling(CHUNK + length)
        for batch in batches:
            for doc_id, th, data in zip(*batch.columns, strict=True):
                data = data.as_py()
                for h, a, lo, hi in anchors_of(data, rolling, length, gram) if len(data) >= length else ():
                    f = np.array([xxhash.xxh3_64_intdigest(data[x:y]) for x, y in zip(lo.tolist(), (hi + length).tolist(), strict=True)], np.uint64).view(np.int64)
                    n = len(h)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h), pa.array((a - lo).astype(np.int32)), pa.array((a - hi).astype(np.int32)), pa.array(f), pa.array([doc_id.as_py()] * n, pa.int64()), pa.array([th.as_py()] * n, pa.int64()), pa.array(a)], names=names
                    )

    return _keyed(docs).mapInArrow(run, "h long, dlo int, dhi int, f long, doc_id long, th long, a long")


CLASS = ["h", "dlo", "dhi", "f"]


def _contexts(joined: DataFrame, length: int, step: int) -> DataFrame:
    """(class, cores, windows) of the classes asked for: hashes of every window, the furthest left first, and of every core, the nearest to the anchor first."""
    names = [*CLASS, "cores", "windows"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def run(batches):
        rolling = Rolling(2 * length)
        for batch in batches:
            for data, want in zip(*batch.columns, strict=True):
                data, out = data.as_py(), [[] for _ in names]
                for x in want.as_py():
                    dlo, dhi = x["dlo"], x["dhi"]
                    span = np.frombuffer(data[x["a"] - dlo : x["a"] - dhi + length], np.uint8)
                    cores = rolling.windows(span, length - step)[dlo - step * np.arange(dhi // step, dlo // step + 1)]
                    for column, v in zip(out, (x["h"], dlo, dhi, x["f"], cores.view(np.int64), rolling.windows(span, length).view(np.int64)), strict=True):
                        column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names=names)

    return joined.mapInArrow(run, "h long, dlo int, dhi int, f long, cores array<long>, windows array<long>")


def _reach(spans: DataFrame, length: int, step: int) -> DataFrame:
    """(class, left, right): how far the outermost repeated windows of each class go to both sides of its anchor.

    Nodes of the interval tree are told by hashes, so that a node which many suffixes share
    is counted with partial sums by many tasks. The tree is walked in two levels: cores
    (``length`` - ``step`` bytes at every ``step``-th place, of which each window holds one),
    and below cores that several suffixes share their windows.
    """
    node = F.col("dhi") - F.col("dhi") % step  # the place of the first core
    each = spans.select(*CLASS, F.posexplode("cores").alias("c", "k"))
    shared = each.groupBy("h", "k").agg(F.count("*").alias("n")).where("n > 1").select("h", "k")
    alive = each.join(shared, ["h", "k"], "left_semi").groupBy(*CLASS).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("c"))).alias("alive"))
    whose = spans.join(alive, CLASS).select(*CLASS, "alive", F.posexplode("windows").alias("i", "w")).withColumn("o", F.col("dlo") - F.col("i"))
    below = F.floor((F.col("o") - node) / step).cast("int")
    seen = materialise(whose.where(F.getbit("alive", below) == 1).select(*CLASS, "o", "w"), "windows")
    twice = seen.groupBy("h", "w").agg(F.count("*").alias("n")).where("n > 1").select("h", "w")
    return seen.join(twice, ["h", "w"], "left_semi").groupBy(*CLASS).agg(F.max("o").alias("left"), (F.lit(length) - F.min("o")).alias("right"))


def covered(docs: DataFrame, length: int = 400, gram: int = 128) -> DataFrame:
    """(doc_id, th, spans): the covered byte spans of each document that has any."""
    every = materialise(anchors(docs, length, gram), "anchors")
    live = materialise(every.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "grams")
    mine = materialise(every.join(live, "h"), "live")
    release(every)
    first = F.min(F.struct("doc_id", "th", "a")).alias("first")
    classes = materialise(mine.groupBy(*CLASS).agg(F.count("*").alias("n"), first), "classes")
    several = materialise(classes.groupBy("h").agg(F.count("*").alias("classes")).where("classes > 1"), "several")
    wanted = classes.join(several, "h").select(*CLASS, "first.*")
    wanted = materialise(wanted.groupBy("doc_id", "th").agg(F.collect_list(F.struct(*CLASS, "a")).alias("want")).select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "want"), "wanted")
    texts, step = _keyed(docs), max(1, min(STEP, length // 8))
    joined = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["_id"]) & (texts["th"] == wanted["_th"])).select("data", "want")
    spans = _contexts(joined, length, step)
    # equal rows hold equal texts: their classes come more than once, and count once
    spans = materialise(spans.dropDuplicates(CLASS) if _repeated_rows(docs) else spans, "spans")
    whole = classes.where("n > 1").select(*CLASS, F.col("dlo").alias("left"), (F.lit(length) - F.col("dhi")).alias("right"))
    reach = materialise(_reach(spans, length, step).union(whole).groupBy(*CLASS).agg(F.max("left").alias("left"), F.max("right").alias("right")), "reach")
    release(spans)
    found = mine.join(reach, CLASS).select("doc_id", "th", F.struct((F.col("a") - F.col("left")).alias("s"), (F.col("a") + F.col("right")).alias("e")).alias("x"))
    return materialise(found.groupBy("doc_id", "th").agg(F.collect_set("x").alias("spans")), "covered")


def _repeated_rows(docs: DataFrame) -> bool:
    return bool(docs.groupBy("doc_id").count().where("count > 1").limit(1).count())


def removed(docs: DataFrame, length: int = 400, gram: int = 128) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of every row of ``docs`` (columns doc_id, text; others are ignored): the maximal removed runs, half-open, in order, and the bytes that are left.

    A null text counts as empty; texts under ``length`` bytes lose nothing. Equal rows are
    documents of their own and repeat each other; a null doc_id stays null. An empty table
    gives no rows. ``kept`` is binary, as a run may end within a character.
    """
    spans = covered(docs, length, gram).select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "spans")
    texts = _keyed(docs)

    def run(batches):
        names = ["doc_id", "n_bytes", "spans", "kept"]
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc_id, data, found in zip(*batch.columns, strict=True):
                data = data.as_py()
                runs = merged([(x["s"], x["e"]) for x in found.as_py() or ()])
                left, at = [], 0
                for start, end in [*runs, (len(data), len(data))]:
                    left.append(data[at:start])
                    at = end
                row = doc_id.as_py(), len(data), [{"start": s, "end": e} for s, e in runs], b"".join(left)
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=names)

    whole = texts.join(spans, texts["doc_id"].eqNullSafe(spans["_id"]) & (texts["th"] == spans["_th"]), "left").select("doc_id", "data", "spans")
    return whole.mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def strip(docs: DataFrame, length: int = 400, gram: int = 128) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of ``docs``: figures of removed()."""
    gone = F.col("n_bytes") - F.length("kept")
    return removed(docs, length, gram).select("doc_id", "n_bytes", gone.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
