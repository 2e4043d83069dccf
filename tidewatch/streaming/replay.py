"""File-based message streams: replay a table in time order, run a query to its end, read results."""
from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.sources.tables import shared_dir


def replay(df: DataFrame, path: str, ts: str, key: str, slices: int, files: int = 4) -> None:
    """Write payload rows as text files whose age follows the time order.

    The time span is cut into `slices`, written one after the other. Rows of one key share a
    file within a slice, so a trigger that ends between files keeps each key in order.
    """
    kind = dict(df.dtypes)[ts]
    span = df.agg(F.min(ts).cast("string").alias("a"), F.max(ts).cast("string").alias("b")).first()
    first, last = (F.lit(span[x]).cast(kind) for x in ("a", "b"))
    total = F.timestamp_diff("MICROSECOND", first, last) + 1
    part = F.floor(F.timestamp_diff("MICROSECOND", first, F.col(ts)) * slices / total)
    marked = df.withColumn("_slice", part)
    for i in range(slices):
        marked.filter(F.col("_slice") == i).repartition(files, key).select("payload").write.mode("append").text(path)


def payload_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema("value STRING")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.text(path).withColumnRenamed("value", "payload")


def table_stream(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A stored table as a stream; its schema is taken from the files."""
    schema = spark.read.parquet(f"{root}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(root)


PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state needs the RocksDB store; choose it unless the session already has."""
    if "RocksDB" not in spark.conf.get(PROVIDER, ""):
        spark.conf.set(PROVIDER, ROCKSDB)


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Process all available input into a table and read it back."""
    spark, base = stream.sparkSession, shared_dir(stream.sparkSession)
    use_rocksdb(spark)
    out = os.path.join(base, "out")
    q = (stream.writeStream.outputMode(mode).format("parquet").option("path", out)
         .option("checkpointLocation", os.path.join(base, "progress")).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Process all available input with a function per micro-batch."""
    base = shared_dir(stream.sparkSession)
    use_rocksdb(stream.sparkSession)
    q = (stream.writeStream.outputMode(mode).foreachBatch(handle)
         .option("checkpointLocation", os.path.join(base, "progress")).trigger(availableNow=True).start())
    q.awaitTermination()
