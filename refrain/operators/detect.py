"""Clone detection: repeated token windows, first occurrences, and maximal runs of them.

A window of k tokens is matched with the first occurrence of the same window in its pool,
in the order of (source_id, pos). Consecutive windows that repeat are one clone, whether or
not their first occurrences follow one another; ``exact`` also breaks a run where they don't.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refrain.sources.tables import materialise


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 64-bit hash of two, in this order."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k neighbours in ``h``: runs of 1, 2, 4 ... are hashed from two of half the length, and k from those that add up to it."""
    if len(h) < k:
        return h[:0]
    out, at, have, size = None, 0, h, 1
    with np.errstate(over="ignore"):
        while size <= k:
            if k & size:
                own = have[at : at + len(h) - k + 1]
                out = own if out is None else _mixed(out, own)
                at += size
            if 2 * size <= k:
                have = _mixed(have[:-size], have[size:])
            size *= 2
    return out


#: Values that a piece of a batch holds at most, unless one source has more: bounds the memory of its hashes.
PIECE = 1 << 18
#: Windows that a run holds at most.
RUN = 64
#: Runs beyond which a key counts as hot.
HOT = 100_000


def minima(h: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours in ``h``, from those of 2, 4, 8 ... neighbours."""
    if len(h) < w:
        return h[:0]
    have, size = h, 1
    while 2 * size <= w:
        have = np.minimum(have[:-size], have[size:])
        size *= 2
    return np.minimum(have[: len(h) - w + 1], have[w - size :])


def _runs(piece: pa.RecordBatch, k: int, m: int) -> list[pa.Array]:
    h = piece.column(4)
    sizes = np.asarray(pc.fill_null(h.value_lengths(), 0), np.int64)
    flat = h.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    counts = np.maximum(sizes - k + 1, 0)
    row = np.repeat(np.arange(len(sizes)), counts)
    at = np.arange(len(row))
    pos = at - (np.cumsum(counts) - counts)[row]
    own = (np.cumsum(sizes) - sizes)[row] + pos
    pool = piece.column(3).to_numpy().view(np.uint64)[row]
    with np.errstate(over="ignore"):
        w = _mixed(window_hashes(flat, k)[own], pool).view(np.int64)
        key = _mixed(minima(window_hashes(flat, m), k - m + 1)[own], pool).view(np.int64)
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    new |= (at - np.maximum.accumulate(np.where(new, at, 0))) % RUN == 0
    first = np.flatnonzero(new)
    of = pa.array(row[first])
    listed = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)), pa.int32()), pa.array(w))
    return [piece.column(0).take(of), pa.array(key[first]), piece.column(1).take(of), pa.array(pos[first], pa.int32()), piece.column(2).take(of), listed]


def windows(arrays: DataFrame, k: int) -> DataFrame:
    """(pool, key, source_id, pos, n, w) of all windows of k values, as runs of neighbours from ``pos`` on that share a key; w are their hashes.

    A window's key is the least hash of the shorter runs of values within it, so that equal
    windows have equal keys and most neighbours share one: what is shuffled afterwards is
    some 8 bytes a window. Values are hashed by the engine; their windows are hashed where
    they lie, a piece of a batch at a time, in about log2(k) vectorised steps. The pool is
    part of both hashes.
    """
    hashed = arrays.select("pool", "source_id", F.size("values").alias("n"), F.xxhash64("pool").alias("p"), F.transform("values", lambda v: F.xxhash64(v)).alias("h"))
    fields = hashed.schema
    shape = T.StructType([fields["pool"], T.StructField("key", T.LongType()), fields["source_id"], T.StructField("pos", T.IntegerType()), fields["n"], T.StructField("w", T.ArrayType(T.LongType()))])
    m = k // 3 if k >= 9 else k

    def run(batches):
        for batch in batches:
            ends, at = np.cumsum(np.asarray(pc.fill_null(batch.column(4).value_lengths(), 0), np.int64)), 0
            while at < batch.num_rows:
                upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE, "right")))
                yield pa.RecordBatch.from_arrays(_runs(batch.slice(at, upto - at), k, m), names=shape.names)
                at = upto

    return hashed.mapInArrow(run, shape)


def each_window(found: DataFrame) -> DataFrame:
    """(pool, key, whash, source_id, pos, n) of each window of runs."""
    return found.select("pool", "key", "source_id", F.col("pos").alias("_p"), "n", F.posexplode("w").alias("_i", "whash")).select("pool", "key", "whash", "source_id", (F.col("_p") + F.col("_i")).alias("pos"), "n")


@dataclass
class Seen:
    """Windows of rows of runs, as flat arrays. Equal ones are ranked in the order of their places, ``first`` is where the first of them stands; ``fresh`` marks rows not told before, ``whole`` those whose key is complete; ``weight`` adds up to how often a window occurs."""

    rows: pa.RecordBatch
    row: np.ndarray
    pos: np.ndarray
    rank: np.ndarray
    first: np.ndarray
    second: np.ndarray
    fresh: np.ndarray
    whole: np.ndarray
    weight: np.ndarray

    def column(self, name: str, at: np.ndarray) -> pa.Array:
        return self.rows.column(name).take(pa.array(self.row[at]))

    def neighbours(self, at: np.ndarray) -> np.ndarray:
        """Whether each place follows the one before in its run."""
        return np.append(False, (at[1:] == at[:-1] + 1) & (self.row[at[1:]] == self.row[at[:-1]]))[: len(at)]


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def _seen(batches):
    """Seen of rows in the order of key and place. Of a key that goes on in the next batch only runs that hold a window's first or second occurrence are kept."""
    held, weight, last, waiting = None, np.zeros(0, np.int64), None, []

    def told(batch: pa.RecordBatch | None) -> Seen:
        nonlocal held, weight, last
        known = held.num_rows if held is not None else 0
        rows = held if batch is None else batch if held is None else _joined([held, batch])
        sizes = np.asarray(rows.column("w").value_lengths(), np.int64)
        row = np.repeat(np.arange(rows.num_rows), sizes)
        flat, at = rows.column("w").flatten().to_numpy(), np.arange(len(row))
        pos = rows.column("pos").to_numpy()[row] + at - (np.cumsum(sizes) - sizes)[row]
        weights = np.append(weight, np.ones(len(row) - len(weight), np.int64))
        order = np.argsort(flat, kind="stable")
        ranked = flat[order]
        lead = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
        counts = np.diff(np.append(lead, len(row)))
        rank, first, second, total = np.empty_like(at), np.empty_like(at), np.full_like(at, -1), np.zeros_like(weights)
        rank[order] = at - np.repeat(lead, counts)
        first[order] = np.repeat(order[lead], counts)
        second[order[lead[counts > 1]]] = order[lead[counts > 1] + 1]
        total[order[lead]] = np.add.reduceat(weights[order], lead)
        key = rows.column("key").to_numpy()
        open_ = key == key[-1] if batch is not None else np.zeros(len(key), bool)
        keep = open_ & (np.bincount(row[rank <= 1], minlength=len(key)) > 0)
        held, weight = rows.filter(pa.array(keep)), total[keep[row]]
        return Seen(rows, row, pos, rank, first, second, row >= known, ~open_[row], total)

    for batch in batches:
        if batch.num_rows:
            waiting.append(batch)
            if held is None or sum(x.num_rows for x in waiting) >= held.num_rows:
                yield told(_joined(waiting))
                waiting = []
    if waiting:
        yield told(_joined(waiting))
    if held is not None and held.num_rows:
        yield told(None)


def _over_keys(found: DataFrame, tell, shape: T.StructType | str, order: tuple = ("source_id", "pos")) -> DataFrame:
    """What ``tell`` makes of Seen, the runs of a key being together and in order."""

    def run(batches):
        for seen in _seen(batches):
            yield pa.RecordBatch.from_pydict(tell(seen))

    return found.repartition("key").sortWithinPartitions("key", *order).mapInArrow(run, shape)


def cooled(found: DataFrame) -> DataFrame:
    """Runs of a key that has many are parted into windows, each a key of its own, so that they are dealt to all tasks; the runs are made twice."""
    hot = found.groupBy("key").agg(F.count("*").alias("_c")).where(F.col("_c") > HOT).select("key", F.lit(True).alias("_hot"))
    pieces = F.transform("w", lambda v, i: F.struct(v.alias("key"), (F.col("pos") + i).alias("pos"), F.array(v).alias("w")))
    pieces = F.when(F.col("_hot"), pieces).otherwise(F.array(F.struct("key", "pos", "w")))
    return found.join(F.broadcast(hot), "key", "left").select("pool", "source_id", "n", F.explode(pieces).alias("x")).select("pool", "x.key", "source_id", "x.pos", "n", "x.w")


def _place(found: DataFrame) -> str:
    """The type of a source's id, for the shape of what Python makes."""
    return found.schema["source_id"].dataType.simpleString()


def hits(found: DataFrame, hot_keys: bool = False, exact: bool = False) -> DataFrame:
    """Windows that occurred before, as runs of c neighbours: (pool, source_id, pos, c, first struct<source_id,pos,n>), ``first`` of the first of them.

    One shuffle of runs by key. With ``exact`` runs break where first occurrences don't
    follow one another; with ``hot_keys`` the runs of keys that a large part of a corpus
    shares are dealt out by window.
    """

    def tell(x: Seen) -> dict:
        at = np.flatnonzero(x.fresh & (x.rank > 0))
        new = ~x.neighbours(at)
        if exact:
            new |= ~x.neighbours(x.first[at])
        lead = np.flatnonzero(new)
        at, c = at[lead], np.diff(np.append(lead, len(at)))
        f = x.first[at]
        return {"pool": x.column("pool", at), "source_id": x.column("source_id", at), "pos": pa.array(x.pos[at], pa.int32()), "c": pa.array(c), "f": x.column("source_id", f), "fp": pa.array(x.pos[f], pa.int32()), "fn": x.column("n", f)}

    kind = _place(found)
    made = _over_keys(cooled(found) if hot_keys else found, tell, f"pool {found.schema['pool'].dataType.simpleString()}, source_id {kind}, pos int, c long, f {kind}, fp int, fn int")
    return made.select("pool", "source_id", "pos", "c", F.struct(F.col("f").alias("source_id"), F.col("fp").alias("pos"), F.col("fn").alias("n")).alias("first"))


def firsts(found: DataFrame, order: tuple = ("source_id", "pos")) -> DataFrame:
    """Runs of only the first occurrence, by ``order``, of each window; those of a key are together."""

    def tell(x: Seen) -> dict:
        at = np.flatnonzero(x.fresh & (x.rank == 0))
        lead = np.flatnonzero(~x.neighbours(at))
        flat = x.rows.column("w").flatten().take(pa.array(at))
        head = at[lead]
        listed = pa.ListArray.from_arrays(pa.array(np.append(lead, len(at)), pa.int32()), flat)
        return {"pool": x.column("pool", head), "key": x.column("key", head), "source_id": x.column("source_id", head), "pos": pa.array(x.pos[head], pa.int32()), "n": x.column("n", head), "w": listed}

    return _over_keys(found, tell, found.schema, order)


def repeated(found: DataFrame) -> DataFrame:
    """(pool, source_id, pos, times) of the first occurrence of each window that repeats."""

    def tell(x: Seen) -> dict:
        at = np.flatnonzero(x.whole & (x.rank == 0) & (x.weight > 1))
        return {"pool": x.column("pool", at), "source_id": x.column("source_id", at), "pos": pa.array(x.pos[at], pa.int32()), "times": pa.array(x.weight[at])}

    return _over_keys(found, tell, f"pool {found.schema['pool'].dataType.simpleString()}, source_id {_place(found)}, pos int, times long")


def window_counts(found: DataFrame) -> DataFrame:
    """(pool, windows, distinct_windows)."""

    def tell(x: Seen) -> dict:
        at = np.flatnonzero(x.fresh)
        made = pa.table({"pool": x.column("pool", at), "d": pa.array((x.rank[at] == 0).astype(np.int64))}).group_by("pool").aggregate([("d", "count"), ("d", "sum")]).combine_chunks()
        return {"pool": made.column("pool").combine_chunks(), "w": made.column("d_count").combine_chunks(), "d": made.column("d_sum").combine_chunks()}

    made = _over_keys(found, tell, f"pool {found.schema['pool'].dataType.simpleString()}, w long, d long")
    return made.groupBy("pool").agg(F.sum("w").alias("windows"), F.sum("d").alias("distinct_windows"))


def islands(matched: DataFrame, k: int, exact: bool = False) -> DataFrame:
    """Clones (pool, a_id, a_pos, b_id, b_pos, tokens) of maximal runs of hits; those whose first side would pass its source's end are dropped."""
    by = Window.partitionBy("source_id").orderBy("pos")
    new = F.lag(F.col("pos") + F.col("c")).over(by) != F.col("pos")
    if exact:
        d, o = F.col("first.pos") - F.col("pos"), F.col("first.source_id")
        new = new | (F.lag(d).over(by) != d) | (F.lag(o).over(by) != o)
    runs = matched.withColumn("g", F.coalesce(new, F.lit(True)).cast("int")).withColumn("g", F.sum("g").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    made = runs.groupBy("pool", "source_id", "g").agg(F.min(F.struct("pos", "first")).alias("x"), (F.sum("c") + k - 1).alias("tokens"))
    return made.where(F.col("x.first.pos") + F.col("tokens") <= F.col("x.first.n")).select(
        "pool", F.col("x.first.source_id").alias("a_id"), F.col("x.first.pos").alias("a_pos"), F.col("source_id").alias("b_id"), F.col("x.pos").alias("b_pos"), "tokens"
    )


def clones(arrays: DataFrame, k: int, exact: bool = False, hot_keys: bool = False) -> DataFrame:
    return islands(hits(windows(arrays, k), hot_keys, exact), k, exact)


def with_lines(found: DataFrame, arrays: DataFrame) -> DataFrame:
    """Clones with a_start, a_end, b_start, b_end: lines of their first and last tokens."""
    at = arrays.select(F.col("source_id").alias("_s"), "lines")
    out = found
    for side in "ab":
        out = out.join(at, F.col(f"{side}_id") == F.col("_s")).withColumns({f"{side}_start": F.get("lines", F.col(f"{side}_pos")), f"{side}_end": F.get("lines", (F.col(f"{side}_pos") + F.col("tokens") - 1).cast("int"))}).drop("_s", "lines")
    return out


def min_lines(least: int) -> Column:
    """The first side spans so many lines."""
    return F.col("a_end") - F.col("a_start") >= least


def dedup(found: DataFrame) -> DataFrame:
    """One clone for each unordered pair of (id, start line): sides in order, the first emitted (by b, then a) stays."""
    a, b = F.struct(F.col("a_id").alias("id"), F.col("a_start").alias("start")), F.struct(F.col("b_id").alias("id"), F.col("b_start").alias("start"))
    by = Window.partitionBy("pool", F.least(a, b), F.greatest(a, b)).orderBy("b_id", "b_pos", "a_id", "a_pos")
    return found.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def secondary_candidates(found: DataFrame, k: int) -> DataFrame:
    """Runs (pool, a_id, a_pos, b_id, b_pos, windows) of the first and second occurrences of repeated windows along a diagonal."""

    def tell(x: Seen) -> dict:
        a = np.flatnonzero((x.second >= 0) & x.fresh[x.second])
        b = x.second[a]
        lead = np.flatnonzero(~(x.neighbours(a) & x.neighbours(b)))
        c, a, b = np.diff(np.append(lead, len(a))), a[lead], b[lead]
        return {"pool": x.column("pool", a), "a_id": x.column("source_id", a), "a_pos": pa.array(x.pos[a], pa.int32()), "b_id": x.column("source_id", b), "b_pos": pa.array(x.pos[b], pa.int32()), "c": pa.array(c)}

    kind = _place(found)
    pairs = _over_keys(found, tell, f"pool {found.schema['pool'].dataType.simpleString()}, a_id {kind}, a_pos int, b_id {kind}, b_pos int, c long")
    d = F.col("b_pos") - F.col("a_pos")
    along = Window.partitionBy("pool", "a_id", "b_id", d).orderBy("a_pos")
    new = F.coalesce(F.lag(F.col("a_pos") + F.col("c")).over(along) != F.col("a_pos"), F.lit(True)).cast("int")
    runs = pairs.withColumn("g", new).withColumn("g", F.sum("g").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("pool", "a_id", "b_id", d.alias("d"), "g").agg(F.min("a_pos").alias("a_pos"), F.min("b_pos").alias("b_pos"), F.sum("c").alias("windows")).drop("d", "g")


def _uncovered(runs: DataFrame, covered: DataFrame) -> DataFrame:
    """Runs neither of whose sides lies within one of the intervals ``covered`` (source, start, end) of its source, which are apart."""
    key = ["pool", "a_id", "a_pos", "b_id", "b_pos"]
    side = lambda x: F.struct(F.col(f"{x}_id").alias("source"), F.col(f"{x}_start").alias("start"), F.col(f"{x}_end").alias("end"))
    asked = runs.select(F.struct(*key).alias("key"), F.explode(F.array(side("a"), side("b"))).alias("s")).select("s.*", "key")
    both = asked.unionByName(covered.select("source", "start", "end"), allowMissingColumns=True)
    by = Window.partitionBy("source").orderBy("start", F.col("key").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    within = F.coalesce(F.max(F.when(F.col("key").isNull(), F.col("end"))).over(by) >= F.col("end"), F.lit(False))
    free = both.withColumn("within", within).where("key is not null").groupBy("key").agg(F.bool_or("within").alias("within")).where("not within").select("key.*")
    return runs.join(free, key, "left_semi")


def secondary(candidates: DataFrame, primary: DataFrame, arrays: DataFrame, k: int, allowed: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Candidate runs that add uncovered lines on both sides, taken greedily by (a, b) after the primary clones; of those with lines only what ``allowed`` leaves.

    What the primary clones cover doesn't depend on an order: runs that lie within it on one
    side go first, everywhere at once. The order of those that are left decides, so each
    pool's are walked in one Python group, with what is covered in their sources.
    """
    import pandas as pd

    from refrain.operators.stats import interval_union

    runs = with_lines(candidates.withColumn("tokens", F.col("windows") + k - 1).drop("windows"), arrays)
    runs = runs.transform(allowed) if allowed else runs
    spans = primary.select("pool", F.explode(F.array(*[F.struct(F.col(f"{x}_id").alias("source"), F.col(f"{x}_start").alias("start"), F.col(f"{x}_end").alias("end")) for x in "ab"])).alias("s"))
    covered = interval_union(spans.select("s.*"), "source")
    left = materialise(_uncovered(runs, covered), "runs")
    touched = left.select("pool", F.explode(F.array("a_id", "b_id")).alias("source")).distinct()
    shape = "pool a_id a_pos b_id b_pos tokens a_start a_end b_start b_end".split()
    zero, one = F.lit(0), F.lit(1)
    known = covered.join(touched, "source").select("pool", F.col("source").alias("a_id"), zero.alias("a_pos"), F.col("source").alias("b_id"), zero.alias("b_pos"), F.lit(0).cast("long").alias("tokens"), F.col("start").alias("a_start"), F.col("end").alias("a_end"), F.col("start").alias("b_start"), F.col("end").alias("b_end"), one.alias("first"))
    both = known.unionByName(left.select(*shape, zero.alias("first")))

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        covered: dict[int, set[int]] = {}
        kept = []
        for row in group.sort_values(["first", "a_id", "a_pos", "b_id", "b_pos"], ascending=[False, True, True, True, True]).itertuples():
            a, b = covered.setdefault(row.a_id, set()), covered.setdefault(row.b_id, set())
            new_a, new_b = set(range(row.a_start, row.a_end + 1)), set(range(row.b_start, row.b_end + 1))
            if row.first or (new_a - a and new_b - b):
                if not row.first:
                    kept.append(row.Index)
                a |= new_a
                b |= new_b
        return group.loc[kept].drop(columns="first")

    return both.groupBy("pool").applyInPandas(walk, both.drop("first").schema)


def skip_local(root: str = "folder") -> Column:
    """Drops clones whose sides lie under the same root."""
    return ~F.coalesce(F.col(f"a_{root}") == F.col(f"b_{root}"), F.lit(False))


def skip_isolated(groups: list[list[str]], folder: str = "folder") -> Column:
    """Drops clones whose sides lie under two different folders of a group."""
    out = F.lit(True)
    for members in groups:
        if len(set(members)) > 1:
            out = out & ~(F.col(f"a_{folder}").isin(members) & F.col(f"b_{folder}").isin(members) & (F.col(f"a_{folder}") != F.col(f"b_{folder}")))
    return out


def validated(found: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Clones with ``messages``: the names of the conditions that fail; none for a clone that all accept."""
    told = F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]))
    return found.withColumn("messages", told)


def with_blame(found: DataFrame, blame: DataFrame) -> DataFrame:
    """Clones with a_author and b_author: who wrote the first line of each side, from ``blame`` (source_id, line, author)."""
    out = found
    for side in "ab":
        who = blame.select(F.col("source_id").cast("string").alias("_s"), F.col("line").cast("int").alias("_l"), F.col("author").alias(f"{side}_author"))
        out = out.join(who, (F.regexp_replace(F.col(f"{side}_id").cast("string"), r"(?<=..):[a-z0-9+-]+$", "") == F.col("_s")) & (F.col(f"{side}_start") == F.col("_l")), "left").drop("_s", "_l")
    return out


def aligned_authors(found: DataFrame, blame: DataFrame) -> DataFrame:
    """A row for each pair of lines of a clone's sides that stand side by side: (pool, a_id, a_line, b_id, b_line, a_author, b_author, same), from ``blame`` (source_id, line, author)."""
    span = F.least(F.col("a_end") - F.col("a_start"), F.col("b_end") - F.col("b_start"))
    out = found.select("pool", "a_id", "a_start", "b_id", "b_start", F.explode(F.sequence(F.lit(0), span)).alias("i"))
    out = out.select("pool", "a_id", (F.col("a_start") + F.col("i")).alias("a_line"), "b_id", (F.col("b_start") + F.col("i")).alias("b_line"))
    for side in "ab":
        who = blame.select(F.col("source_id").alias(f"{side}_id"), F.col("line").cast("int").alias(f"{side}_line"), F.col("author").alias(f"{side}_author"))
        out = out.join(who, [f"{side}_id", f"{side}_line"], "left")
    return out.withColumn("same", F.col("a_author") == F.col("b_author")).select("pool", "a_id", "a_line", "b_id", "b_line", "a_author", "b_author", "same")


def with_attribute(found: DataFrame, sources: DataFrame, name: str) -> DataFrame:
    """Clones with a_<name> and b_<name> from ``sources``."""
    out = found
    for side in "ab":
        out = out.join(sources.select(F.col("source_id").alias("_s"), F.col(name).alias(f"{side}_{name}")), F.col(f"{side}_id") == F.col("_s")).drop("_s")
    return out
