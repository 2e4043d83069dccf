"""Result tables: appends with retry-safe ids, partitioned writes and latest-row snapshots."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_id(*cols: str) -> Column:
    """Row id from the row's key columns: a retried task or batch writes the same id."""
    return F.sha2(F.to_json(F.struct(*cols)), 256)


def append(df: DataFrame, path: str, batch_id: int, partition_by: list[str] = ()) -> None:
    """Add a batch in a folder of its own: a batch that is run again replaces its rows."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{path}/batch={batch_id}")


def measurement_rows(df: DataFrame, ts: str, source: str, parameter: str, value: str, quality: Column) -> DataFrame:
    out = df.select(F.col(ts).alias("timestamp"), F.col(source).alias("source_id"), F.col(parameter).alias("parameter_id"), F.col(value).alias("value"), quality.alias("quality_status"))
    return out.withColumn("measurement_id", content_id("timestamp", "source_id", "parameter_id"))


def prediction_rows(df: DataFrame, keys: list[str], horizons: dict[int, str], model: str) -> DataFrame:
    """One row per horizon from a row that holds all forecasts."""
    items = F.array(*[F.struct(F.lit(h).alias("prediction_horizon_minutes"), F.col(c).alias("predicted_value")) for h, c in horizons.items()])
    out = df.select(*keys, F.inline(items)).withColumn("model_name", F.lit(model)).withColumn("prediction_type", F.lit("FORECAST"))
    return out.withColumn("prediction_id", content_id(*keys, "model_name", "prediction_horizon_minutes"))


def alarm_rows(df: DataFrame, keys: list[str], level: str, action: Column, score: str, label: str) -> DataFrame:
    """Alarm rows of the levels that need one."""
    from tidewatch.functions import rules

    lv = F.col(level)
    return df.filter(lv != "LEVEL_1").select(
        *keys, F.lit("DSS_DECISION").alias("event_type"), rules.alarm_code(lv).alias("alarm_code"), rules.alarm_severity(lv).alias("severity"),
        F.lit("ACTIVE").alias("status"), rules.alarm_text(lv, action, F.col(score), F.col(label)).alias("description"),
    ).withColumn("event_row_id", content_id(*keys, "alarm_code"))


def write_partitioned(df: DataFrame, path: str, by: list[str]) -> None:
    """Replace a result table, partitioned by series or date. Rows are gathered by the partition columns, and a value that holds
    much is parted by size at run time, so each gets as many writers as it needs."""
    df.hint("rebalance", *by).write.mode("overwrite").partitionBy(*by).parquet(path)


def snapshot(df: DataFrame, keys: list[str], order: list[str], path: str) -> None:
    """Newest row per key, written whole."""
    from tidewatch.operators.topk import latest_per_key

    latest_per_key(df, keys, order).write.mode("overwrite").parquet(path)
