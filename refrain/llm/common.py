"""What the operators of this subpackage share: scratch tables, components, joins that survive a hot key.

Nothing here collects rows that grow with the corpus to the driver, and nothing is
kept in executor memory or on an executor's own disk: lineage is cut by tables in the
shared folder that ``spark.checkpoint.dir`` names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refrain.sources.tables import materialise, release, scratch  # noqa: F401

#: Edges that one task of a local contraction holds at a time.
LOCAL_EDGES = 500_000


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used and in whatever lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Component label (smallest member's index) of each of n nodes under the given links; vectorised hooking and pointer jumping."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, label[left], low)
        np.minimum.at(label, label[right], low)
        while not np.array_equal(jump := label[label], label):
            label = jump
        if np.array_equal(before, label):
            return label


def stars(nodes_a: np.ndarray, nodes_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest in star form of the links a-b: (member, smallest member), members that are not their own root."""
    nodes, where = np.unique(np.concatenate([nodes_a, nodes_b]), return_inverse=True)
    label = forest(len(nodes), where[: len(nodes_a)], where[len(nodes_a) :])
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def edge_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=EDGE)


def _contract(batches):
    held, n = [], 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        n += batch.num_rows
        if n >= LOCAL_EDGES:
            yield edge_batch(*stars(*map(np.concatenate, zip(*held, strict=True))))
            held, n = [], 0
    if n:
        yield edge_batch(*stars(*map(np.concatenate, zip(*held, strict=True))))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (long columns a, b, no nulls); component is the smallest node reachable.

    Each partition first contracts its own edges to a spanning forest. Then alternating
    large-star and small-star steps run until nothing changes, O(log^2 n) rounds. A hub
    that many edges share is no hot spot: minima are combined before they are shuffled,
    and the joins run between written tables, so that adaptive execution can split them.
    No nodes, or an empty table, give no rows.
    """
    given = materialise(edges, "links")  # so that no task runs the Python of its edges and of their contraction at once
    now = materialise(given.mapInArrow(_contract, "a long, b long"), "edges")
    release(given)
    state = None
    while True:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "low")
        large = materialise(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        release(low, now)
        low = materialise(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        moved = large.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = materialise(moved.union(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        release(low, large)
        n, mark = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if (n, mark) == state:
            break
        state = (n, mark)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
