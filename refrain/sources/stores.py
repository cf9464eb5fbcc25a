"""Where an index of windows is kept: cached by executors, or as a table that several runs share."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame

#: Caches are rebuilt from their sources where an executor is lost; nothing but speed depends on them.
KINDS: dict[str, Callable[[DataFrame, str | None], DataFrame]] = {
    "memory": lambda index, path: index.persist(StorageLevel.MEMORY_AND_DISK),
    "disk": lambda index, path: index.persist(StorageLevel.DISK_ONLY),
}


def store(kind: str):
    """Registers a store: a function of an index and a path that returns the index as it is read from then on."""

    def add(f):
        KINDS[kind] = f
        return f

    return add


@store("table")
def _table(index: DataFrame, path: str | None) -> DataFrame:
    if path is None:
        raise ValueError("a table needs a path")
    index.repartitionByRange("pool", "whash").sortWithinPartitions("pool", "whash").write.mode("overwrite").parquet(path)
    return index.sparkSession.read.parquet(path)


def get_store(kind: str | None, namespace: str = "") -> Callable[[DataFrame, str | None], DataFrame]:
    """A store by name; unknown names fall back to memory, with a warning. Runs of different namespaces share a path without sharing entries."""
    if kind is not None and kind not in KINDS:
        warnings.warn(f"no store named {kind!r}: memory is used", stacklevel=2)
    keep = KINDS.get(kind or "memory", KINDS["memory"])
    return lambda index, path: keep(index, f"{path.rstrip('/')}/{namespace}" if path and namespace else path)
