"""Aggregates over the tags of a family inside one row."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def family_mean(cols: list[str]) -> Column:
    """Mean of the present values of a tag family in a row."""
    vals = F.array_compact(F.array(*[F.col(c) for c in cols]))
    total = F.aggregate(vals, F.lit(0.0), lambda a, v: a + v)
    return F.when(F.size(vals) > 0, total / F.when(F.size(vals) > 0, F.size(vals)))


def family_sum(cols: list[str]) -> Column:
    vals = F.array_compact(F.array(*[F.col(c) for c in cols]))
    return F.when(F.size(vals) > 0, F.aggregate(vals, F.lit(0.0), lambda a, v: a + v))


def map_family_sum(features: Column, pattern: str) -> Column:
    """Sum of the finite numbers of a text map whose names match a pattern; null without any."""
    number = lambda v: v.try_cast("double")
    kept = F.map_filter(features, lambda k, v: k.rlike(pattern) & F.coalesce(F.abs(number(v)) < float("inf"), F.lit(False)))
    return F.when(F.size(kept) > 0, F.aggregate(F.map_values(kept), F.lit(0.0), lambda a, v: a + number(v)))
