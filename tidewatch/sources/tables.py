"""Table scans: delimited files, directories with provenance, column and row pruning."""
from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below the session's `spark.checkpoint.dir`; it is removed when the program ends.

    A cluster has to name that folder. A local session that names none gets one of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="tidewatch-")
        spark.conf.set("spark.checkpoint.dir", base)
        _MADE.append((spark, base))
    path = f"{base.rstrip('/')}/tidewatch-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    return path


_MADE: list[tuple[SparkSession, str]] = []


@atexit.register
def remove_shared_dirs() -> None:
    """Delete the folders made so far, as far as their sessions still run."""
    while _MADE:
        spark, path = _MADE.pop()
        try:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        except Exception:  # noqa: BLE001  the session has ended: its folder stays
            continue


def pin(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage durably."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), "pinned")
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def pinned(df: DataFrame) -> Iterator[DataFrame]:
    """`pin` for the length of a block whose results leave it collected or written: the folder is deleted at its end."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), "pinned")
    try:
        df.write.mode("overwrite").parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        folder = spark._jvm.org.apache.hadoop.fs.Path(os.path.dirname(path))
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within the block, what is written passes Python workers in Arrow batches of `rows` rows at most: for rows that hold whole texts.

    Both sides of the pipe keep a batch, and the memory of the largest so far. A lower limit of the session stays.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if 0 < int(before) <= rows:
        yield
        return
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A driver-side catalogue as a table of known size, so Spark broadcasts it by its own check."""
    types = T._parse_datatype_string(schema)
    return spark.createDataFrame(pd.DataFrame(rows, columns=types.names), types)


def read_delimited(spark: SparkSession, path, schema: T.StructType | None = None, **options) -> DataFrame:
    """Delimited scan with a given schema; types are inferred (one extra pass) only without one."""
    reader = spark.read.options(header=True, **options)
    return (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(path)


def read_parts(spark: SparkSession, paths: list[str], fmt: str = "parquet", schema: T.StructType | None = None) -> DataFrame:
    """All files of a directory or list as one table; `source_file` keeps each row's file name."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(paths).withColumn("source_file", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1))


def schema_table(df: DataFrame) -> DataFrame:
    """Column table of a DataFrame: ordinal, name and type, learned without reading rows."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return small_table(df.sparkSession, rows, "ordinal INT, column_name STRING, data_type STRING")


def scan(
    df: DataFrame,
    columns: list[str] | None = None,
    where: list[Column] | None = None,
    order: list[Column] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Relational scan with optional predicates, order and row limit (all pushed by Catalyst)."""
    for predicate in where or []:
        df = df.filter(predicate)
    if order:
        df = df.orderBy(*order)
    if limit is not None:
        df = df.limit(limit)
    return df.select(*columns) if columns else df


def read_manifest(spark: SparkSession, path: str, fallback: tuple[str, str] = ("features", "feature_names")) -> DataFrame:
    """Feature manifest from a JSON object: the first key that is present, with its order."""
    schema = T.StructType([T.StructField(k, T.ArrayType(T.StringType())) for k in fallback])
    doc = spark.read.schema(schema).json(path, multiLine=True)
    return doc.select(F.posexplode(F.coalesce(*fallback)).alias("feature_order", "feature"))


def registry_table(spark: SparkSession, entries: list[tuple[str, str, str, str]]) -> DataFrame:
    """Static dataset catalogue: name, path, role, status."""
    return small_table(spark, entries, "dataset STRING, path STRING, role STRING, status STRING")


def surplus_copies(df: DataFrame, cols: list[str], name: str = "duplicates") -> DataFrame:
    """One row: how many rows repeat an earlier row's values.

    Rows are first counted by a 128-bit hash of their values, so narrow rows are shuffled; only rows whose hash repeats are then
    grouped by the values themselves. Copies are combined before the shuffle both times.
    """
    # the hash passes over nulls: their places are hashed too
    values = [F.concat_ws("", *[F.col(c).isNull().cast("int").cast("string") for c in cols]), *cols]
    own = df.select(*cols, F.xxhash64(*values).alias("_h1"), F.xxhash64(F.lit(1), *values).alias("_h2"))
    again = own.groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    again = pin(again.select(F.col("_h1").alias("_r1"), F.col("_h2").alias("_r2")))
    groups = own.join(again, (F.col("_h1") == F.col("_r1")) & (F.col("_h2") == F.col("_r2"))).groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias(name))


def inventory(df: DataFrame, name: str) -> DataFrame:
    """One inventory row: rows, columns, missing, NaN, infinite, duplicate rows, verdict."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]

    def total(conds):
        acc = F.lit(0)
        for c in conds:
            acc = acc + c.cast("int")
        return F.coalesce(F.sum(acc), F.lit(0)).cast("long")

    out = df.agg(
        F.count(F.lit(1)).alias("rows"),
        total([F.col(c).isNull() for c in df.columns]).alias("missing"),
        total([F.coalesce(F.isnan(c), F.lit(False)) for c in floats]).alias("nan_values"),
        total([F.coalesce(F.abs(F.col(c)) == F.lit(float("inf")), F.lit(False)) for c in floats]).alias("infinite"),
    ).withColumn("duplicates", surplus_copies(df, df.columns).scalar())
    bad = F.col("missing") + F.col("nan_values") + F.col("infinite") + F.col("duplicates")
    return out.select(
        F.lit(name).alias("dataset"), "rows", F.lit(len(df.columns)).alias("columns"),
        "missing", "nan_values", "infinite", "duplicates",
        F.when(bad == 0, "PASS").otherwise("REVIEW").alias("status"),
    )


def scan_jdbc(spark: SparkSession, url: str, name: str, column: str, lower: int, upper: int, parts: int, **properties) -> DataFrame:
    """Relational source read in parallel ranges of a numeric column; filters are pushed to it."""
    return spark.read.jdbc(url, name, column=column, lowerBound=lower, upperBound=upper, numPartitions=parts, properties=properties)
