"""Date functions whose defaults differ from pandas."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def yearless(c: Column) -> Column:
    """`MM/DD HH:MM:SS` in the year 1900, the year a missing one stands for (weekday is a feature)."""
    return F.try_to_timestamp(F.concat(F.lit("1900/"), c), F.lit("yyyy/MM/dd HH:mm:ss"))


def iso_timestamp(c: Column) -> Column:
    return F.try_to_timestamp(c)


def duration_text(seconds: Column) -> Column:
    """Whole hours, minutes or else seconds, as text."""
    s = seconds.cast("long")
    return (
        F.when(s % 3600 == 0, F.concat((s / 3600).cast("long").cast("string"), F.lit(" hour(s)")))
        .when(s % 60 == 0, F.concat((s / 60).cast("long").cast("string"), F.lit(" minute(s)")))
        .otherwise(F.concat(s.cast("string"), F.lit(" second(s)")))
    )
