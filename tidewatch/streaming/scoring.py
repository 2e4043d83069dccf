"""Micro-batch sinks: score, append measurements and predictions, keep latest rows."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.plans.forecast import LinearModel, score_horizons
from tidewatch.sources import sinks
from tidewatch.operators.topk import latest_per_key
from tidewatch.sources.tables import pinned, small_table


def score_and_store(models: dict[int, LinearModel], keys: list[str], ts: str, source: str, parameter: str, value: str, measurements: str, predictions: str):
    """Batch handler: one measurement and one prediction per horizon for every scored row.

    Each batch is written to its own folder, so a batch that is run again after a failure
    replaces its rows instead of adding them twice.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        m = sinks.measurement_rows(batch, ts, source, parameter, value, F.lit("GOOD"))
        m.write.mode("overwrite").parquet(f"{measurements}/batch={batch_id}")
        scored = score_horizons(batch.dropna(subset=sorted({f for x in models.values() for f in x.features})), models)
        p = sinks.prediction_rows(scored, keys, {h: f"forecast_{h}" for h in models}, "linear")
        p.write.mode("overwrite").parquet(f"{predictions}/batch={batch_id}")

    return handle


#: Column that names the folder of a bucket; the rows must have none of that name.
BUCKET = "latest_bucket"


class LatestRows:
    """Newest row per key over all batches, in `buckets` of keys by hash: a batch writes the buckets it touches and no other.

    The rows of a batch are reduced to one per key, merged with the touched buckets and written to a
    folder of the batch's own. A commit table then says which batch holds each bucket; it has at most
    `buckets` rows and counts once it is whole. The one to build on is looked up in the folder, as the
    last whole one of an earlier batch: a restarted query goes on where it was, and a repeated batch
    writes the same again. Of rows that tie in `order`, which one stays is left open, so `order`
    should end with an id. Buckets and commits that neither the new commit nor the one before names
    are deleted, so that a reader of the last state is not cut off by the next batch.
    """

    def __init__(self, path: str, keys: list[str], order: list[str], buckets: int = 64):
        self.path, self.keys, self.order, self.buckets = path, keys, order, buckets

    def _folder(self, spark: SparkSession, name: str):
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder

    def _commits(self, spark: SparkSession) -> list[int]:
        fs, folder = self._folder(spark, "commits")
        if not fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(folder)]
        return sorted(int(n) for n in names if n.isdigit() and fs.exists(self._folder(spark, f"commits/{n}/_SUCCESS")[1]))

    def _holders(self, spark: SparkSession, commit: int) -> dict[int, int]:
        """Bucket to the batch that wrote it last."""
        rows = spark.read.schema("bucket INT, batch LONG").parquet(f"{self.path}/commits/{commit}")
        return {r.bucket: r.batch for r in rows.collect()}

    def _rows(self, spark: SparkSession, holders: dict[int, int], schema: T.StructType) -> DataFrame:
        paths = [f"{self.path}/rows/{batch}/{BUCKET}={b}" for b, batch in sorted(holders.items())]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    def handle(self, batch: DataFrame, batch_id: int) -> None:
        spark, schema = batch.sparkSession, batch.schema
        place = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias(BUCKET)
        # the stream is read once: a second reading could meet other rows
        with pinned(latest_per_key(batch, self.keys, self.order).select(*schema.names)) as new:
            touched = [r[0] for r in new.select(place).distinct().collect()]
            earlier = [i for i in self._commits(spark) if i < batch_id]
            before = self._holders(spark, earlier[-1]) if earlier else {}
            old = self._rows(spark, {b: before[b] for b in touched if b in before}, schema)
            both = old.unionByName(new).select("*", place).repartition(BUCKET)
            merged = latest_per_key(both, [BUCKET, *self.keys], self.order)
            merged.write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}/rows/{batch_id}")
        after = before | {b: batch_id for b in touched}
        small_table(spark, sorted(after.items()), "bucket INT, batch LONG").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/{batch_id}")
        self._remove(spark, batch_id, [*earlier[-1:], batch_id], {(v, b) for held in (before, after) for b, v in held.items()})

    def _remove(self, spark: SparkSession, batch_id: int, commits: list[int], held: set[tuple[int, int]]) -> None:
        """Delete older commits, and older buckets that no kept commit names."""
        for n in self._commits(spark):
            if n < batch_id and n not in commits:
                fs, folder = self._folder(spark, f"commits/{n}")
                fs.delete(folder, True)
        fs, rows = self._folder(spark, "rows")
        for f in fs.listStatus(rows):
            n = int(f.getPath().getName())
            if n >= batch_id:
                continue
            left = {int(x.getPath().getName().removeprefix(f"{BUCKET}=")) for x in fs.listStatus(f.getPath()) if x.isDirectory()}
            kept = {b for b in left if (n, b) in held}
            for b in left - kept:
                fs.delete(self._folder(spark, f"rows/{n}/{BUCKET}={b}")[1], True)
            if not kept:
                fs.delete(f.getPath(), True)

    def read(self, spark: SparkSession, schema: T.StructType) -> DataFrame:
        commits = self._commits(spark)
        return self._rows(spark, self._holders(spark, commits[-1]) if commits else {}, schema)


def several(*handlers: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """One batch handler that gives the same rows to each: the batch is stored once, as a second reading could meet other rows."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        with pinned(batch) as rows:
            for h in handlers:
                h(rows, batch_id)

    return handle
