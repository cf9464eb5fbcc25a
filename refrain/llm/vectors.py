"""Near-duplicate vectors by spherical k-means cells and blocked cosine products.

Equal vectors are one class. k-means centres are fitted on a bounded sample; then every
class is assigned to its nearest centre, its home, and visits each other cell that a
partner may live in. A vector within angle a of y lies at most sin(a) * |c - c'| on the
other side of the plane between y's centre c and c'; a random one rarely more than a few
standard deviations of that. They are fitted for each pair of cells: sin(a) times the
share of c - c' in the sample's variance within cells, at least |c - c'| / sqrt(dimensions),
so that vectors that vary in few dimensions go further. ``spread`` of them set how far y
visits; with ``exact`` it goes all of sin(a) * |c - c'|, which no partner is beyond. Members are compared with everything in their home cell, in blocks; where both
visit the other's home, each counts the pair in its own, and where only one does, the pair
counts for both where it is found, so that links are symmetric. A cell with
many members is dealt out in pairs of blocks, so that a large group of near copies is
shared by many tasks, and each pair of blocks sends on counts and a spanning forest.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refrain.llm.common import connected_components, materialise, stars

#: Rows that a block of a cell's own members holds, and a block of all that are compared with them.
BLOCK_ROWS, OTHER_ROWS = 256, 512
#: What rounding may take from the distance of two centres, at most.
ROUNDED = 1e-6
#: Rows times cells that are placed at a time.
PLACED = 1 << 18


def _rows(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; those whose squares would overflow or vanish are scaled first."""
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    odd = np.flatnonzero(~((norm > 1e-140) & (norm < 1e140)))
    if len(odd):
        rows[odd] /= np.abs(rows[odd]).max(axis=1, keepdims=True)
        norm[odd] = np.linalg.norm(rows[odd], axis=1, keepdims=True)
    return rows / norm


def nearest(unit: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row, some rows at a time."""
    return np.concatenate([(unit[at : at + 2048] @ centres.T).argmax(axis=1) for at in range(0, max(1, len(unit)), 2048)])


def fit(sample: np.ndarray, cells: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Unit centres of a spherical k-means over unit rows."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(rounds):
        own = nearest(sample, centres)
        total = np.zeros_like(centres)
        np.add.at(total, own, sample)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(norm > 0, total / np.where(norm > 0, norm, 1), centres)
    return centres


def shares(sample: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Each direction's share of the variance of ``sample`` within its cells, as a matrix; zeros without any."""
    rest = sample - centres[nearest(sample, centres)]
    total = float((rest * rest).sum())
    return rest.T @ rest / total if total > 1e-12 else np.zeros((sample.shape[1],) * 2)


def deviations(centres: np.ndarray, share: np.ndarray | None) -> np.ndarray:
    """For each pair of cells the deviation of a random step of length one across the plane between them, times the centres' distance; without ``share`` the distance, which is the most."""
    far = np.maximum(0, 2 - 2 * (centres @ centres.T))
    if share is None:
        return np.sqrt(far) + ROUNDED
    own = centres @ share @ centres.T
    return np.sqrt(np.maximum(far / centres.shape[1], np.diag(own)[:, None] + np.diag(own)[None] - 2 * own))


def reaches(unit: np.ndarray, home: np.ndarray, other: np.ndarray, centres: np.ndarray, share: np.ndarray | None, reach: float) -> np.ndarray:
    """Whether each row, at home in one cell, visits the other one."""
    apart = centres[other] - centres[home]
    far = (apart * apart).sum(axis=1)
    step = np.sqrt(far) + ROUNDED if share is None else np.sqrt(np.maximum(far / centres.shape[1], ((apart @ share) * apart).sum(axis=1)))
    return (unit * apart).sum(axis=1) >= -reach * step


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, spread: float = 4.0, max_sample: int = 20_000, per_cell: int = 400, exact: bool = False) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding; others are ignored).

    Null, empty and zero vectors and those with null or non-finite components link with
    nothing; vectors of other lengths than most link among their own length only. Equal
    rows link with each other. A null vec_id keeps its row, counts as a partner, and
    component_id is the smallest id that is not null (its own row's where it links with
    nothing). ``max_sample`` bounds the rows that centres are fitted on; all rows are indexed.
    ``exact`` loses no pair and takes no ``spread``; it costs up to a product of all with all.
    An empty table gives no rows.
    """
    x = F.col("embedding").cast("array<double>")
    valid = (F.size(x) > 0) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(x, lambda v: v != 0)
    kept = vectors.schema["embedding"].dataType.simpleString()  # floats travel as floats; they are compared as doubles
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.coalesce(valid, F.lit(False)), x).alias("x")).withColumn("h", F.xxhash64("x"))
    linked = rows.where("x is not null")
    # the class key is the vector itself, by way of 64 bits and then its first member
    classes = materialise(linked.groupBy("h", "x").agg(F.count("*").alias("n"), F.min("vec_id").alias("low")).withColumn("class", F.xxhash64("h", "x")), "classes")
    sizes = dict(classes.groupBy(F.size("x")).count().collect())  # one row for each length of vectors
    if not sizes:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    centres = {}
    for width, count in sizes.items():
        sample = classes.where(F.size("x") == width).orderBy("class").limit(max_sample).select("x").toArrow()
        unit = _unit(_rows(sample.column(0).combine_chunks()))
        c = fit(unit, max(1, min(len(unit) // 8, count // per_cell)))
        centres[width] = c, None if exact else shares(unit, c)
    reach = (1 if exact else spread) * math.sqrt(1 - max(0.0, cosine) ** 2)

    def assign(batches):
        names, step = ["class", "n", "x", "cell", "home", "at"], {}
        for batch in batches:
            width = np.array([len(v) for v in batch.column(2)])
            for w in np.unique(width):
                part = batch.filter(pa.array(width == w))
                unit = _unit(_rows(part.column(2)))
                c, share = centres[int(w)]
                if w not in step:
                    step[w] = deviations(c, share)
                few = max(1, min(2048, PLACED // len(c)))
                for at in range(0, len(unit), few):
                    near = unit[at : at + few] @ c.T
                    own = near.argmax(axis=1)
                    i, j = np.nonzero(near >= near.max(axis=1, keepdims=True) - reach * step[w][own])
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).slice(at).take(pa.array(i)), part.column(1).slice(at).take(pa.array(i)), part.column(2).slice(at).take(pa.array(i)), pa.array((j + (int(w) << 32)).astype(np.int64)), pa.array(j == own[i]), pa.array((own[i] + (int(w) << 32)).astype(np.int64))], names=names
                    )

    placed = materialise(classes.select("class", "n", F.col("x").cast(kept).alias("x")).mapInArrow(assign, f"class long, n long, x {kept}, cell long, home boolean, at long"), "placed")
    of = lambda n, rows: F.ceil(n / rows).cast("int")
    members = materialise(placed.groupBy("cell").agg(of(F.count_if("home"), BLOCK_ROWS).alias("own"), of(F.count("*"), OTHER_ROWS).alias("all")), "cells")
    dealt = placed.join(members, "cell")
    columns, spot = ["class", "n", "x", "cell", "at"], F.xxhash64("class")
    here = dealt.where("home").select(F.pmod(spot, F.col("own")).alias("i"), F.explode(F.sequence(F.lit(0), F.col("all") - 1)).alias("j"), *columns, F.lit(True).alias("asks"))
    there = dealt.where("own > 0").select(F.explode(F.sequence(F.lit(0), F.col("own") - 1)).alias("i"), F.pmod(spot, F.col("all")).alias("j"), *columns, F.lit(False).alias("asks"))
    tasks = here.select(F.col("i").cast("long"), F.col("j").cast("long"), *columns, "asks").union(there.select(F.col("i").cast("long"), F.col("j").cast("long"), *columns, "asks")).select(F.xxhash64("cell", "i", "j").alias("task"), *columns, "asks")

    def compare(batches):
        held: list[pa.RecordBatch] = []

        def flush(table: pa.Table):
            task = table.column(0).to_numpy()
            ends = np.append(np.flatnonzero(task[1:] != task[:-1]) + 1, len(task))
            at = 0
            for end in ends.tolist():
                part = table.slice(at, end - at).combine_chunks()
                asks = part.column(6).to_numpy(zero_copy_only=False)
                at = end
                if not asks.any() or asks.all():
                    continue
                key, n, unit = part.column(1).to_numpy(), part.column(2).to_numpy(), _unit(_rows(part.column(3).combine_chunks()))
                i, j = np.nonzero(unit[asks] @ unit[~asks].T >= cosine)
                i, j = np.flatnonzero(asks)[i], np.flatnonzero(~asks)[j]
                other = key[i] != key[j]
                i, j = i[other], j[other]
                if len(i):
                    here, from_cell = int(part.column(4)[0].as_py()), part.column(5).to_numpy()
                    count = np.bincount(i, n[j], len(key))
                    alone = np.flatnonzero(from_cell[j] != here)  # found by a visitor: does the other visit its home too?
                    c, share = centres[here >> 32]
                    low = (1 << 32) - 1
                    alone = alone[~reaches(unit[i[alone]], from_cell[i[alone]] & low, from_cell[j[alone]] & low, c, share, reach)]
                    count = (count + np.bincount(j[alone], n[i[alone]], len(key))).astype(np.int64)
                    found = np.flatnonzero(count)
                    x, y = stars(key[i], key[j])
                    none = [None] * len(x)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate([key[found], x])), pa.array([*count[found].tolist(), *none], pa.int64()), pa.array([*[None] * len(found), *y.tolist()], pa.int64())], names=["class", "links", "other"]
                    )

        for batch in batches:
            table = pa.Table.from_batches([*held, batch])
            task = table.column(0).to_numpy()
            cut = int(np.flatnonzero(task != task[-1])[-1]) + 1 if len(task) and (task != task[-1]).any() else 0
            yield from flush(table.slice(0, cut)) if cut else ()
            held = table.slice(cut).to_batches()
        if held:
            yield from flush(pa.Table.from_batches(held))

    tasks = tasks.select("task", *columns, "asks").repartition("task").sortWithinPartitions("task")
    found = materialise(tasks.mapInArrow(compare, "class long, links long, other long"), "links")
    links = materialise(found.where("links is not null").groupBy("class").agg(F.sum("links").alias("links")), "counts")
    parts = materialise(connected_components(found.where("other is not null").select(F.col("class").alias("a"), F.col("other").alias("b"))), "parts")
    named = classes.select("class", "n", "low").join(links, "class", "left").join(parts, F.col("class") == F.col("node"), "left").select("class", "low", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "class").alias("part"))
    named = materialise(named, "named")
    lows = materialise(named.groupBy("part").agg(F.min("low").alias("component_id")), "lows")
    whole = materialise(named.join(lows, "part").select(F.col("class").alias("_class"), "n_links", "component_id"), "whole")
    own = rows.select("vec_id", F.when(F.col("x").isNotNull(), F.xxhash64("h", "x")).alias("_own"))
    out = own.join(whole, F.col("_own") == F.col("_class"), "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("_class").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
