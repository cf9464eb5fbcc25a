"""Snippets in a stream, checked against a static index of windows."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refrain.operators import detect, snippets
from refrain.operators.tokens import token_arrays


def check_stream(stream: DataFrame, index: DataFrame, k: int, out: str, checkpoint: str):
    """Starts a query that checks each micro-batch of snippets (source_id, pool, content) and appends its runs to Parquet at ``out``.

    A batch that is repeated after a failure overwrites its own folder, so that runs are written once.
    """

    def check(batch: DataFrame, number: int) -> None:
        snippets.check(token_arrays(batch), index, k).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(check).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_index(stream: DataFrame, k: int, out: str, checkpoint: str):
    """Keeps an index of windows growing: each micro-batch's sources are hashed and appended; readers take the least place of a window."""

    def add(batch: DataFrame, number: int) -> None:
        snippets_index = snippets.index_of(token_arrays(batch), k)
        snippets_index.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_index(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out).groupBy("pool", "whash").agg(F.min("first").alias("first"))


def new_windows(stream: DataFrame, k: int, late: str = "10 minutes") -> DataFrame:
    """Windows of a stream of sources (source_id, pool, content, ts) that were not seen within the watermark: state is bounded by it."""
    keyed = stream.withColumn("source_id", F.struct("source_id", "ts"))
    timed = detect.each_window(detect.windows(token_arrays(keyed), k)).select("pool", "whash", "source_id.source_id", "pos", F.col("source_id.ts").alias("ts"))
    return timed.withWatermark("ts", late).dropDuplicatesWithinWatermark(["pool", "whash"])


def run_once(spark: SparkSession, path: str, arrays: DataFrame, k: int) -> DataFrame:
    """Streams the items at ``path`` (item_id, text) past an index of ``arrays`` and returns all runs."""
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="refrain-")
    base = f"{base.rstrip('/')}/refrain/stream-{abs(hash((path, k))):x}-{spark.sparkContext.startTime}-{id(arrays)}"
    snippets.write_index(arrays, k, f"{base}/index")
    index = spark.read.parquet(f"{base}/index")
    folder, name = path.rsplit("/", 1)
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    stream = stream.select(F.col("item_id").alias("source_id"), F.lit("all").alias("pool"), F.col("text").alias("content"))
    check_stream(stream, index, k, f"{base}/out", f"{base}/state").awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    return out.drop("batch").select("snippet_id", "pos", "source_id", "source_pos", "tokens")
