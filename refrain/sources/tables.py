"""Tables of a folder, read so that small ones keep all cores busy, and scratch tables that cut lineage."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a table, for each core, under which its rows are dealt out anew.
SPREAD = 4 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table often is one row group, and so one task, however costly its rows are: they are dealt out to all cores. Larger tables stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < SPREAD * cores else df


def dealt(df: DataFrame) -> DataFrame:
    """Rows that take much longer to work on than to move are dealt out in parts of SPREAD bytes, however large the pieces are that they are read in."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-size // SPREAD)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def scratch(spark: SparkSession) -> str:
    """The shared scratch folder: the session's ``spark.checkpoint.dir``; a folder of our own only where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="refrain-"))
    return context.getCheckpointDir().rstrip("/")


_swept: set[str] = set()


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def _sweep(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before the interpreter does
        _delete(spark, path)


def materialise(df: DataFrame, name: str = "t") -> DataFrame:
    """Writes ``df`` as Parquet in the scratch folder and reads it back, so that a lost executor costs one stage at most.

    The application's tables are deleted when its interpreter ends; release() deletes one before.
    """
    spark = df.sparkSession
    folder = f"{scratch(spark)}/refrain/{spark.sparkContext.applicationId}"
    if folder not in _swept:
        _swept.add(folder)
        atexit.register(_sweep, spark, folder)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._refrain_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables that materialise() returned, once nothing reads them any more."""
    for table in tables:
        _delete(table.sparkSession, table._refrain_path)
