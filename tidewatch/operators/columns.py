"""Column selection by manifest, pattern, type and leakage rules; row cleaning."""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.names import LEAKAGE_PATTERNS, plain_words


def by_manifest(df: DataFrame, manifest: list[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in manifest])


def matching(df: DataFrame, prefixes: tuple[str, ...] = (), suffixes: tuple[str, ...] = ()) -> list[str]:
    return [c for c in df.columns if (prefixes and c.startswith(prefixes)) or (suffixes and c.endswith(suffixes))]


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def feature_set(columns: list[str], calendar: list[str], bases: list[str], targets: list[str]) -> list[str]:
    """Calendar, base columns and their lags, once each and in order, never a target."""
    wanted = [c for c in calendar if c in columns]
    for b in bases:
        if b in columns:
            wanted += [b, *[c for c in columns if c.startswith(f"{b}_lag_")]]
    return [c for c in dict.fromkeys(wanted) if c not in targets]


def leaking(columns: list[str], patterns: dict[str, list[str]] = LEAKAGE_PATTERNS) -> list[str]:
    """Columns whose plain name matches a leakage pattern."""
    rules = [re.compile(p) for ps in patterns.values() for p in ps]
    return [c for c in columns if any(r.search(plain_words(c)) for r in rules)]


def drop_incomplete(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.dropna(subset=cols)


def finite_or_null(c: str | Column) -> Column:
    """NaN and infinities become null."""
    v = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), v)


def finite_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: finite_or_null(c) for c in cols}).dropna(subset=cols)


def lenient_double(c: str) -> Column:
    """Number or null; text that is no number does not fail the query."""
    return finite_or_null(F.col(c).try_cast("double"))


def strict_double(c: str) -> Column:
    """Number; text that is no number fails the query (ANSI cast)."""
    return F.col(c).cast("double")


def stack_with_constants(df: DataFrame, constants: dict[str, object], renames: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(renames).withColumns({k: F.lit(v) for k, v in constants.items()})


def glue(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Put the columns of two row-aligned tables side by side: equi-join on the order key."""
    return left.join(right.drop(*[c for c in right.columns if c in left.columns and c not in keys]), keys)


def route(features: Column, schemas: dict[str, list[str]]) -> Column:
    """Name of the first schema whose features are all present in a map; null when none is."""
    out = None
    for name, wanted in schemas.items():
        complete = F.size(F.array_except(F.array(*[F.lit(x) for x in wanted]), F.map_keys(features))) == 0
        out = F.when(complete, name) if out is None else out.when(complete, name)
    return out


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b).withColumn("side", F.lit("left_only")).unionByName(b.subtract(a).withColumn("side", F.lit("right_only")))


def ordered_distinct(df: DataFrame, cols: list[str], order: str) -> DataFrame:
    """Distinct values with the place of their first occurrence."""
    return df.groupBy(*cols).agg(F.min(order).alias("first_place"))
