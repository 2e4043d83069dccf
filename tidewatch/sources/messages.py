"""JSON messages: decode, bad-row branch and replay of a table as ordered messages."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MESSAGE_SCHEMA = "timestamp STRING, source STRING, step BIGINT, features MAP<STRING, STRING>"


def encode(df: DataFrame, ts: str, source: Column, step: str, features: dict[str, Column]) -> DataFrame:
    """Rows as messages `{timestamp, source, step, features}`. Null features are left out."""
    entries = F.map_from_entries(F.array_compact(F.array(*[F.when(v.isNotNull(), F.struct(F.lit(k), v)) for k, v in features.items()])))
    body = F.struct(F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias("timestamp"), source.alias("source"), F.col(step).alias("step"), entries.alias("features"))
    return df.select(F.to_json(body).alias("payload"))


def decode(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Parsed fields; `corrupt` marks text that is no message (its fields are null)."""
    m = F.from_json(F.col(payload), MESSAGE_SCHEMA)
    out = df.withColumn("_m", m)
    others = [c for c in df.columns if c != payload]
    return out.select(*others, "_m.timestamp", "_m.source", "_m.step", "_m.features", (F.col("_m.step").isNull() & F.col("_m.timestamp").isNull()).alias("corrupt"))


def feature_columns(df: DataFrame, names: list[str], features: str = "features") -> DataFrame:
    """Map entries as double columns (null when absent or no number)."""
    return df.withColumns({n: F.element_at(features, n).try_cast("double") for n in names})
