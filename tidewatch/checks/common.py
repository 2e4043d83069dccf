"""Bindings of the driver's tables to telemetry shapes, in Spark and as SQL text."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.series import Series
from tidewatch.sources.tables import table

TAGS = ["click", "error", "purchase", "signup", "view"]
MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


def by_user(**kw) -> Series:
    return Series(["user_id"], ["ts", "event_id"], **kw)


def by_type(**kw) -> Series:
    return Series(["event_type"], ["ts", "event_id"], **kw)


def one_stream(**kw) -> Series:
    """All events as one series: `ts` is its only key."""
    return Series([], ["ts", "event_id"], **kw)


def r(col, places: int = 6):
    return F.round(col, places)


def tags_hourly(spark: SparkSession, d: str) -> DataFrame:
    """Wide table: one row per hour, one column per tag (mean value), label of the hour."""
    e = events(spark, d)
    return (
        e.groupBy(F.date_trunc("hour", "ts").alias("hour"))
        .agg(
            *[F.avg(F.when(F.col("event_type") == t, F.col("value"))).alias(t) for t in TAGS],
            F.max(F.when(F.col("event_type") == "error", 1).otherwise(0)).alias("label"),
        )
    )


TAGS_HOURLY = "tags AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, " + ", ".join(
    f"avg(CASE WHEN event_type = '{t}' THEN value END) AS {t}" for t in TAGS
) + ", max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::INTEGER AS label FROM events GROUP BY 1)"
