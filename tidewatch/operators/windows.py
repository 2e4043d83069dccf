"""Time-ordered features per series: lags, leads, differences, rolling statistics, segments."""
from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.series import Frame, Series, with_group_value


def seconds_between(earlier: Column, later: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", earlier, later) / F.lit(1e6)


def row_lags(df: DataFrame, series: Series, cols: list[str], steps: Iterable[int]) -> DataFrame:
    """`<col>_lag_<k>` for every column and step."""
    steps = list(steps)
    fr = series.frame(df, before=max(steps))
    w = fr.window()
    return fr.with_columns({f"{c}_lag_{k}": F.lag(c, k).over(w) for c in cols for k in steps}).rows()


def row_leads(df: DataFrame, series: Series, col: str, steps: dict[str, int]) -> DataFrame:
    """Future values of `col`; `steps` maps the target name to the number of rows ahead."""
    fr = series.frame(df, after=max(steps.values()))
    w = fr.window()
    return fr.with_columns({name: F.lead(col, k).over(w) for name, k in steps.items()}).rows()


def supervised_rows(
    df: DataFrame, series: Series, col: str, lags: Iterable[int], leads: dict[str, int], drop_incomplete: bool = True
) -> DataFrame:
    """Lags and leads in one sort; rows in warm-up or without a future are dropped."""
    lags = list(lags)
    fr = series.frame(df, before=max(lags), after=max(leads.values()))
    w = fr.window()
    new = {f"{col}_lag_{k}": F.lag(col, k).over(w) for k in lags}
    new |= {name: F.lead(col, k).over(w) for name, k in leads.items()}
    out = fr.with_columns(new).rows()
    return out.dropna(subset=list(new)) if drop_incomplete else out


def calendar(df: DataFrame, ts: str) -> DataFrame:
    """Hour, minute, weekday (Monday = 0) and day of month."""
    t = F.col(ts)
    return df.withColumns(
        {"hour": F.hour(t), "minute": F.minute(t), "day_of_week": F.weekday(t), "day_of_month": F.dayofmonth(t)}
    )


def _restart_flag(series: Series, fr: Frame, gap_seconds: float, exact: bool) -> Column:
    """1 where a new sequence starts. `exact`: any interval other than `gap_seconds` breaks."""
    ts = series.order[0]
    dt = seconds_between(F.lag(ts).over(fr.window()), F.col(ts))
    broken = dt != gap_seconds if exact else dt > gap_seconds
    return F.when(broken, 1).otherwise(0)


def temporal_features(
    df: DataFrame,
    series: Series,
    cols: list[str],
    gap_seconds: float | None = None,
    window: int = 5,
    kinds: Iterable[str] = ("diff", "abs_diff", "diff2", "mean", "std", "deviation"),
) -> DataFrame:
    """Differences and rolling statistics, restarted at gaps when `gap_seconds` is given.

    Rolling values need a full window (as many null warm-up rows as `window - 1`).
    """
    fr = series.frame(df, before=max(window - 1, 2))
    w = fr.window()
    if gap_seconds is not None:
        fr = fr.with_columns({"_restart": _restart_flag(series, fr, gap_seconds, exact=False)})
        fr = fr.with_columns({"_segment": F.sum("_restart").over(w.rowsBetween(Window.unboundedPreceding, 0))})

    def joined(k: int, v: Column) -> Column:
        # Segments only grow along the series, so equal ends mean one segment in between:
        # no second sort by segment is needed.
        if gap_seconds is None:
            return v
        return F.when(F.lag("_segment", k).over(w) == F.col("_segment"), v)

    full = w.rowsBetween(-(window - 1), 0)
    new: dict[str, Column] = {}
    for c in cols:
        v = F.col(c)
        ready = F.count(v).over(full) == window
        mean = joined(window - 1, F.when(ready, F.avg(v).over(full)))
        diff = joined(1, v - F.lag(v).over(w))
        made = {
            "diff": diff,
            "abs_diff": F.abs(diff),
            "diff2": joined(2, v - 2 * F.lag(v, 1).over(w) + F.lag(v, 2).over(w)),
            "mean": mean,
            "std": joined(window - 1, F.when(ready, F.stddev_samp(v).over(full))),
            "deviation": v - mean,
        }
        new |= {f"{c}__{k}": made[k] for k in kinds}
    return fr.with_columns(new).rows().drop("_restart", "_segment")


def sequence_ids(df: DataFrame, series: Series, gap_seconds: float, exact: bool = False, name: str = "sequence_id") -> DataFrame:
    """Gap-free sequence number per series.

    `exact=False`: a gap longer than the limit starts a sequence, counted from 0.
    `exact=True`: any interval different from the cadence starts one, counted from 1.
    """
    fr = series.frame(df, before=1)
    fr = fr.with_columns({"_restart": _restart_flag(series, fr, gap_seconds, exact)}).core()
    base = 1 if exact else 0
    return fr.running_sum(name, F.col("_restart")).with_columns({name: (F.col(name) + base).cast("long")}).rows().drop("_restart")


def intervals(df: DataFrame, series: Series, name: str = "interval_s", previous: str | None = None) -> DataFrame:
    """Seconds since the previous row of the series (null on the first)."""
    fr = series.frame(df, before=1)
    prev = F.lag(series.order[0]).over(fr.window())
    new = {name: seconds_between(prev, F.col(series.order[0]))}
    if previous:
        new[previous] = prev
    return fr.with_columns(new).rows()


def gap_report(df: DataFrame, series: Series, gap_seconds: float) -> DataFrame:
    """One row per gap: previous and current timestamp and the length in seconds."""
    ts = series.order[0]
    return (
        intervals(df.select(*series.keys, *series.order), series, "gap_s", "previous_ts")
        .filter(F.col("gap_s") > gap_seconds)
        .select(*series.keys, "previous_ts", F.col(ts).alias("current_ts"), "gap_s")
    )


def islands(df: DataFrame, series: Series, label: str) -> DataFrame:
    """Runs of equal consecutive labels: start, end, rows and duration of each."""
    ts = series.order[0]
    fr = series.frame(df.select(*series.keys, *series.order, label), before=1)
    changed = F.coalesce(F.lag(label).over(fr.window()).eqNullSafe(F.col(label)), F.lit(False))
    first = F.row_number().over(fr.window()) == 1
    flag = F.when(first | ~changed, 1).otherwise(0)
    fr = fr.with_columns({"_new": flag}).core().running_sum("segment", F.col("_new"))
    out = fr.rows().groupBy(*series.keys, F.col("segment").cast("long").alias("segment"), label)
    return out.agg(
        F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"), F.count(F.lit(1)).alias("rows"),
    ).withColumn("duration_s", seconds_between(F.col("start_ts"), F.col("end_ts")))


def bucket_blocks(df: DataFrame, keys: list[str], bucket: str, step_seconds: int, series: Series | None = None) -> DataFrame:
    """Blocks of consecutive buckets (a distinct truncated timestamp column)."""
    marks = df.select(*keys, bucket).distinct()
    s = series or Series(keys, [bucket], cell=F.date_trunc("day", F.col(bucket)))
    fr = s.frame(marks, before=1)
    dt = seconds_between(F.lag(bucket).over(fr.window()), F.col(bucket))
    fr = fr.with_columns({"_new": F.when(dt == step_seconds, 0).otherwise(1)}).core()
    return (
        fr.running_sum("block", F.col("_new")).rows()
        .groupBy(*keys, F.col("block").cast("long").alias("block"))
        .agg(F.min(bucket).alias("first_bucket"), F.max(bucket).alias("last_bucket"), F.count(F.lit(1)).alias("buckets"))
    )


def continuity(df: DataFrame, group: list[str], bucket: str, step_seconds: int) -> DataFrame:
    """Per group: number of distinct buckets and of breaks between consecutive ones."""
    return (
        bucket_blocks(df, group, bucket, step_seconds)
        .groupBy(*group)
        .agg(F.sum("buckets").alias("buckets"), (F.count(F.lit(1)) - 1).alias("breaks"))
        .withColumn("continuous", F.col("breaks") == 0)
    )


def episode_gaps(episodes: DataFrame, start: str, end: str, ident: str, keys: list[str] = ()) -> DataFrame:
    """Whole minutes between the last minute of the previous episode and the first of this one
    (consecutive minutes have gap 0, overlapping ones a negative gap)."""
    s = Series(list(keys), [start, ident])
    fr = s.frame(episodes.select(*keys, start, end, ident), before=1)
    gap = seconds_between(F.lag(end).over(fr.window()), F.col(start)) / 60 - 1
    return fr.with_columns({"gap_minutes": gap}).rows()


def seconds_in_minute(df: DataFrame, series: Series, ordinal: str) -> DataFrame:
    """Second reconstructed from the row's place in its minute.

    Minute-stamped rows get `minute + place seconds`. The first minute of a series is taken
    as cut at its start, so its places begin at 1 (later ones at 0).
    """
    ts = series.order[0]
    stamped = df.withColumn("minute", F.date_trunc("minute", F.col(ts)))
    minutes = Series([*series.keys, "minute"], [ts, ordinal], cell=F.date_trunc("second", F.col(ts)))
    out = minutes.frame(stamped).position("place").rows()
    out = with_group_value(out, df, series.keys, F.min(F.date_trunc("minute", ts)), "_first")
    shift = F.when((F.col("minute") == F.col("_first")) & (F.col("place") < 60), 1).otherwise(0)
    rebuilt = F.expr("minute + make_dt_interval(0, 0, 0, cast(_place_s AS DECIMAL(18,6)))")
    return out.withColumn("_place_s", F.col("place") + shift).withColumn("second_ts", rebuilt).drop("_first", "_place_s")


def streaks(df: DataFrame, series: Series, hit: Column, name: str = "streak") -> DataFrame:
    """Length of the current run of `hit` rows; any other row resets it to 0.

    It is the hits so far minus the hits so far at the last miss, both of which carry over
    chunk borders.
    """
    fr = series.frame(df).with_columns({"_hit": F.coalesce(hit.cast("int"), F.lit(0))})
    fr = fr.running_sum("_hits", F.col("_hit")).running_max("_base", F.when(F.col("_hit") == 0, F.col("_hits")))
    out = fr.with_columns({name: (F.col("_hits") - F.coalesce("_base", F.lit(0))).cast("long")})
    return out.rows().drop("_hit", "_hits", "_base")


def readiness(
    df: DataFrame, series: Series, cadence_seconds: float, cols: list[str], lagged: list[str] = (),
    steps: tuple[int, ...] = (1, 2, 5, 10), name: str = "row_status",
) -> DataFrame:
    """WARMUP_INCOMPLETE / BLOCKED / READY per row.

    A row needs as many prior rows as the longest lag; then the last intervals must all be on
    the cadence and the row's values and the lags of the `lagged` columns finite.
    """
    history = max(steps)
    fr = series.frame(df, before=history + 1)
    ts = series.order[0]
    w = fr.window()

    def finite(v: Column) -> Column:
        return F.coalesce(~F.isnan(v) & (F.abs(v) != float("inf")), F.lit(False))

    good = F.lit(True)
    for c in cols:
        good = good & finite(F.col(c))
    for c in lagged:
        for k in steps:
            good = good & finite(F.lag(c, k).over(w))
    dt = seconds_between(F.lag(ts).over(w), F.col(ts))
    fr = fr.with_columns({"_ok": F.when(dt == cadence_seconds, 1).otherwise(0), "_good": good})
    last, values = w.rowsBetween(-(history - 1), 0), w.rowsBetween(-history, 0)
    fr = fr.with_columns({"_steps": F.min("_ok").over(last), "_seen": F.count(F.lit(1)).over(values)})
    status = (
        F.when(F.col("_seen") <= history, "WARMUP_INCOMPLETE")
        .when((F.col("_steps") == 0) | ~F.col("_good"), "BLOCKED").otherwise("READY")
    )
    return fr.with_columns({name: status}).rows().drop("_ok", "_good", "_steps", "_seen")


def extreme_changes(df: DataFrame, series: Series, cols: list[str], gap_seconds: float, k: int = 20) -> DataFrame:
    """Largest absolute changes per feature inside gap-free sequences, with both values."""
    fr = series.frame(df.select(*series.keys, *series.order, *cols), before=1)
    w = fr.window()
    ts = F.col(series.order[0])
    joined = seconds_between(F.lag(ts).over(w), ts) <= gap_seconds
    fr = fr.with_columns({f"_p_{c}": F.when(joined, F.lag(c).over(w)) for c in cols})
    pairs = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"_p_{c}").alias("previous"), F.col(c).alias("current")) for c in cols
    ])
    tall = fr.rows().select(*series.keys, *series.order, F.inline(pairs)).filter(F.col("previous").isNotNull())
    tall = tall.withColumns({"change": F.col("current") - F.col("previous"), "abs_change": F.abs(F.col("current") - F.col("previous"))})
    from tidewatch.operators.topk import top_k

    return top_k(tall, ["feature"], [F.desc("abs_change"), *[F.asc(c) for c in [*series.order, *series.keys]]], k, "change_rank")


def interval_check(df: DataFrame, series: Series, cadence_seconds: float) -> DataFrame:
    """Per series: rows, non-increasing steps and steps off the cadence."""
    step = intervals(df.select(*series.keys, *series.order), series, "_dt")
    dt = F.col("_dt")
    return step.groupBy(*series.keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.when(dt <= 0, 1).otherwise(0)).alias("not_increasing"),
        F.sum(F.when(dt != cadence_seconds, 1).otherwise(0)).alias("off_cadence"),
    )


def positions(df: DataFrame, series: Series, name: str = "position", total: str | None = None) -> DataFrame:
    """Zero-based position of each row in its series and, optionally, the series length."""
    out = series.frame(df).position(name).rows()
    if total is None:
        return out
    return with_group_value(out, df, series.keys, F.count(F.lit(1)), total)


def rebase(df: DataFrame, keys: list[str], ts: str, start: Column, name: str = "rebased_ts") -> DataFrame:
    """Move each series so that its first row falls on `start`."""
    out = with_group_value(df, df, keys, F.min(ts), "_first")
    return out.withColumn(name, start + (F.col(ts) - F.col("_first"))).drop("_first")
