"""Equi-joins with their checks, lookups, interval joins and row-aligned comparisons.

No join here carries a broadcast hint: Spark's own size check picks broadcast for small
dimensions, and beyond it sort-merge with the adaptive split of skewed partitions.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.series import Series


def star_join(fact: DataFrame, dims: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """Left-join dimensions in turn: (dimension, key on the left so far, key in the dimension)."""
    for dim, left, right in dims:
        fact = fact.join(dim, fact[left] == dim[right], "left").drop(dim[right])
    return fact


def duplicate_keys(sides: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Keys that occur more than once, per side: empty when a join is one to one."""
    out = None
    for name, df in sides.items():
        one = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1").select(F.lit(name).alias("side"), *keys, "copies")
        out = one if out is None else out.unionByName(one)
    return out


def lookup(df: DataFrame, key: str, table: DataFrame | dict[str, str], value: str, default: str) -> DataFrame:
    """Dictionary lookup: `value` of the matching key, else the default.

    A Python dictionary becomes a literal map, so no join is needed; a table (unique keys) is
    left-joined and Spark decides on broadcast by its size.
    """
    if isinstance(table, dict):
        pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
        return df.withColumn(value, F.coalesce(F.try_element_at(pairs, F.col(key)), F.lit(default)))
    found = table.select(F.col(key), F.col(value))
    return df.join(found, key, "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def key_differences(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of the left that the right lacks (`missing`) and the reverse (`extra`)."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, keys, "left_anti").withColumn("side", F.lit("extra")))


def _epoch(c: Column) -> Column:
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c.cast("timestamp_ntz"))


def interval_join(
    rows: DataFrame, intervals: DataFrame, ts: str, start: str, end: str,
    keys: list[str] = (), width_seconds: int = 3600, how: str = "inner",
) -> DataFrame:
    """Rows inside closed intervals. Both sides meet on (keys, time slot), an equi-join that
    Spark can hash, broadcast or split; an interval is repeated once per slot it touches."""
    keys = list(keys)
    slot = lambda c: F.floor(_epoch(F.col(c)) / width_seconds)
    left = rows.withColumn("_slot", slot(ts))
    right = intervals.withColumn("_slot", F.explode(F.sequence(slot(start), slot(end))))
    right = right.withColumnsRenamed({k: f"_r_{k}" for k in [*keys, "_slot"]})
    on = (F.col("_slot") == F.col("_r__slot")) & F.col(ts).between(F.col(start), F.col(end))
    for k in keys:
        on = on & (F.col(k) == F.col(f"_r_{k}"))
    return left.join(right, on, how).drop("_slot", "_r__slot", *[f"_r_{k}" for k in keys])


def interval_hits(rows: DataFrame, intervals: DataFrame, ident: str, ts: str, start: str, end: str, keys: list[str] = ()) -> DataFrame:
    """Rows inside each closed interval, zero included; `ident` names an interval.

    No (row, interval) pair is made: rows and bounds are ordered together, and an interval's rows are the running row count at its
    end less the one at its start. A start comes before rows of the same time, an end behind them.
    """
    keys = list(keys)
    point = lambda c, kind, name: [*keys, F.col(c).alias("_ts"), F.lit(kind).alias("_kind"), name.alias("_id")]
    fine = intervals.filter(F.col(start) <= F.col(end))
    name = F.col(ident).cast("string")
    both = rows.filter(F.col(ts).isNotNull()).select(*point(ts, 1, F.lit(None).cast("string")))
    both = both.unionByName(fine.select(*point(start, 0, name))).unionByName(fine.select(*point(end, 2, name)))
    counted = Series(keys, ["_ts", "_kind", "_id"]).frame(both).running_sum("_so_far", F.when(F.col("_kind") == 1, 1).otherwise(0)).rows()
    at = lambda kind: F.max(F.when(F.col("_kind") == kind, F.col("_so_far")))
    n = counted.filter("_kind <> 1").groupBy("_id").agg((at(2) - at(0)).alias("rows"))
    out = intervals.select(ident, start, end).join(n, F.col(ident).cast("string") == F.col("_id"), "left").drop("_id")
    return out.withColumn("rows", F.coalesce("rows", F.lit(0)).cast("long"))


def interval_minutes(intervals: DataFrame, start: str, end: str) -> DataFrame:
    """One row per minute an interval touches."""
    m = lambda c: F.date_trunc("minute", F.col(c))
    return intervals.withColumn("minute", F.explode(F.sequence(m(start), m(end), F.expr("INTERVAL 1 MINUTE"))))


def minute_tags(intervals: DataFrame, positive_minutes: DataFrame, order: str, start: str, end: str, overrides: DataFrame | None = None) -> DataFrame:
    """Owner interval of each positive minute: the last in catalogue order wins, and an
    override (minute plus the same payload columns) wins over all."""
    payload = [c for c in intervals.columns if c not in (start, end)]
    spread = interval_minutes(intervals, start, end).join(positive_minutes.select("minute").distinct(), "minute", "left_semi")
    owner = spread.groupBy("minute").agg(F.max_by(F.struct(*payload), F.col(order)).alias("_o")).select("minute", "_o.*")
    if overrides is None:
        return owner
    return owner.join(overrides.select("minute"), "minute", "left_anti").unionByName(overrides.select("minute", *payload))


def tag_rows(rows: DataFrame, ts: str, tags: DataFrame) -> DataFrame:
    """Tag every row of a tagged minute (left join on the minute)."""
    return rows.withColumn("minute", F.date_trunc("minute", F.col(ts))).join(tags, "minute", "left").drop("minute")


def uncovered_minutes(positive_minutes: DataFrame, intervals: DataFrame, start: str, end: str) -> DataFrame:
    """Positive minutes no interval touches."""
    covered = interval_minutes(intervals.select(start, end), start, end).select("minute").distinct()
    return positive_minutes.select("minute").distinct().join(covered, "minute", "left_anti")


def merged_windows(windows: DataFrame, start: str, end: str) -> DataFrame:
    """Union of closed windows as disjoint ones (`start`, `end`)."""

    fr = Series([], [start, end]).frame(windows.select(start, end))
    fr = fr.running_max("_reach", F.col(end), inclusive=False)
    fr = fr.running_sum("_island", F.when(F.col(start) <= F.col("_reach"), 0).otherwise(1))
    return fr.rows().groupBy("_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def guard_split(rows: DataFrame, ts: str, held_out: DataFrame, start: str, end: str, guard_minutes: int, normal: Column, scenario: str, ident: str) -> DataFrame:
    """Split `evaluation`: held-out scenarios plus normal rows within the guard of one; all
    other rows are `train`.

    Rows are read once. Guard windows are merged, hence disjoint and at least twice the guard
    long, so a time slot of that length meets at most two of them.
    """
    g = F.expr(f"INTERVAL {int(guard_minutes)} MINUTES")
    width = max(int(guard_minutes) * 120, 60)
    windows = merged_windows(held_out.select((F.col(start) - g).alias("_gs"), (F.col(end) + g).alias("_ge")), "_gs", "_ge")
    slot = lambda c: F.floor(_epoch(F.col(c)) / width)
    slots = windows.withColumn("_slot", F.explode(F.sequence(slot("_gs"), slot("_ge"))))
    slots = slots.groupBy("_slot").agg(F.collect_list(F.struct("_gs", "_ge")).alias("_w"))
    names = held_out.select(F.col(ident).alias(scenario)).distinct().withColumn("_held", F.lit(True))
    out = rows.withColumn("_slot", slot(ts)).join(slots, "_slot", "left").join(names, scenario, "left")
    near = F.coalesce(F.exists("_w", lambda w: F.col(ts).between(w["_gs"], w["_ge"])), F.lit(False))
    split = F.when(F.col("_held") | (normal & near), "evaluation").otherwise("train")
    return out.select(*rows.columns, split.alias("split"))


def aligned_differences(left: DataFrame, right: DataFrame, keys: list[str], cols: list[str], exact: list[str] = ()) -> DataFrame:
    """Full join on the order key: presence of each side and absolute differences per column; of `exact` columns whether they are the same."""
    a = left.select(*keys, *[F.col(c).alias(f"_a_{c}") for c in (*cols, *exact)], F.lit(True).alias("_l"))
    b = right.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in (*cols, *exact)], F.lit(True).alias("_r"))
    j = a.join(b, keys, "full")
    side = F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only").otherwise("both")
    diffs = []
    for c in cols:
        x, y = F.col(f"_a_{c}"), F.col(f"_b_{c}")
        diffs.append(F.when(x.isNull() & y.isNull(), F.lit(0.0)).otherwise(F.abs(x - y)).alias(f"{c}_diff"))
    same = [F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}")).alias(f"{c}_same") for c in exact]
    return j.select(*keys, side.alias("side"), *diffs, *same)


def equivalence(left: DataFrame, right: DataFrame, keys: list[str], tolerances: dict[str, float], exact: list[str] = ()) -> DataFrame:
    """One row: rows on each side, rows in both, largest difference and verdict per column set.

    With `exact`, columns of any type that have to be equal, the rows that differ are counted per column as well."""
    d = aligned_differences(left, right, keys, list(tolerances), list(exact))
    both = F.col("side") == "both"
    # a value present on one side only is a difference
    off = {c: ~F.col(f"{c}_same") for c in exact} | {c: F.coalesce(F.col(f"{c}_diff") > tol, F.lit(True)) for c, tol in tolerances.items()}
    bad = reduce(lambda a, b: a | b, off.values(), F.lit(False))
    return d.agg(
        F.count(F.when(both, 1)).alias("matched_rows"), F.count(F.when(F.col("side") == "left_only", 1)).alias("left_only"),
        F.count(F.when(F.col("side") == "right_only", 1)).alias("right_only"), F.count(F.when(both & bad, 1)).alias("different_rows"),
        *[F.count(F.when(both & off[c], 1)).alias(f"different_{c}") for c in off if exact],
        *[F.max(F.when(both, F.col(f"{c}_diff"))).alias(f"max_{c}_diff") for c in tolerances],
    ).withColumn("equivalent", (F.col("left_only") == 0) & (F.col("right_only") == 0) & (F.col("different_rows") == 0))
