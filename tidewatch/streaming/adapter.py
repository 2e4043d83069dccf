"""Runtime adapter: one message in, one status out, with a bounded history per source.

A message is checked in a fixed order and the first failure wins: malformed message, invalid
timestamp, timestamp order, cadence, source, malformed features, missing values, values that
are no numbers, values that are not finite. Every failure clears the
history. A late or repeated timestamp keeps the last accepted time; a cadence break and all
later failures advance it; an unreadable timestamp forgets it. The batch form states the same
rules as windows, the stream form as keyed state.
"""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidewatch.operators.contracts import message_violations
from tidewatch.operators.series import Series
from tidewatch.operators.windows import row_lags, seconds_between, streaks

HISTORY = 11
LAGS = (1, 2, 5, 10)


def parse(messages: DataFrame, names: list[str], source: str | None = None) -> DataFrame:
    """Typed fields and the content failure of each message (not yet its time failures)."""
    codes = message_violations(F.col("features"), names, allow_extra=True)
    failure = (
        F.when(F.lit(source is not None) & ~F.coalesce(F.col("source") == (source or ""), F.lit(False)), "source")
        .when(F.col("features").isNull(), "malformed_features")
        .when(F.array_contains(codes, "missing_keys"), "missing_raw")
        .when(F.exists(F.array(*[F.element_at("features", n) for n in names]), lambda v: v.try_cast("double").isNull()), "invalid_values")
    )
    values = [F.element_at("features", n).try_cast("double") for n in names]
    finite = F.lit(True)
    for v in values:
        finite = finite & ~F.isnan(v) & (F.abs(v) != float("inf"))
    failure = F.coalesce(failure, F.when(~F.coalesce(finite, F.lit(False)), "non_finite"))
    if "corrupt" in messages.columns:
        failure = F.when(F.col("corrupt"), "malformed_message").otherwise(failure)
    out = messages.withColumns({"ts": F.try_to_timestamp(F.col("timestamp")).cast("timestamp_ntz"), "content_failure": failure})
    return out.withColumns({n: F.when(F.col("content_failure").isNull(), v) for n, v in zip(names, values)}).select(
        "source", "step", "ts", "content_failure", *names)


def _feature_columns(names: list[str]) -> list[str]:
    return [*names, *[f"{n}_lag_{k}" for n in names for k in LAGS]]


def adapt_batch(parsed: DataFrame, names: list[str], cadence_seconds: float = 120.0, **series_options) -> DataFrame:
    """Statuses and features for stored messages, ordered by `step` within a source."""
    opts = {"cell": F.floor(F.col("step") / 65536), **series_options}
    order = Series(["source"], ["step"], **opts).measured(parsed)
    fr = order.frame(parsed).running_sum("_era", F.col("ts").isNull().cast("int"))
    era = fr.rows()
    by_era = Series(["source", "_era"], ["step"], **opts)
    last = by_era.frame(era).running_max("_last", F.col("ts"), inclusive=False).rows()
    dt = seconds_between(F.col("_last"), F.col("ts"))
    failure = (
        F.when(F.col("content_failure") == "malformed_message", "malformed_message").when(F.col("ts").isNull(), "invalid_timestamp").when(dt <= 0, "timestamp_order").when(dt != cadence_seconds, "cadence")
        .otherwise(F.col("content_failure"))
    )
    run = streaks(last.withColumn("failure", failure), order, F.col("failure").isNull(), "_run")
    lagged = row_lags(run, order, names, LAGS)
    ready = F.col("_run") >= HISTORY
    status = F.when(F.col("failure").isNotNull(), "INVALID_INPUT").when(ready, "READY").otherwise("NOT_READY")
    feats = [F.when(ready, F.col(c)).alias(c) for c in _feature_columns(names)]
    return lagged.select("source", "step", "ts", status.alias("status"), "failure", *feats)


class _Adapter(StatefulProcessor):
    def __init__(self, names: list[str], cadence_seconds: float):
        self.names, self.cadence = names, int(cadence_seconds * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("adapter", "last_us BIGINT, history ARRAY<DOUBLE>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True).sort_values("step", kind="stable")
        last, history, f = None, [], len(self.names)
        if self.state.exists():
            last_us, flat = self.state.get()
            last = None if last_us is None or last_us < 0 else int(last_us)
            flat = [] if flat is None else list(flat)
            history = [flat[i:i + f] for i in range(0, len(flat), f)]
        out = []
        for row in pdf.itertuples(index=False):
            us = None if row.us is None or row.us != row.us else int(row.us)
            failure = None
            if us is None:
                malformed = isinstance(row.content_failure, str) and row.content_failure == "malformed_message"
                failure, last = "malformed_message" if malformed else "invalid_timestamp", None
            elif last is not None and us <= last:
                failure = "timestamp_order"
            else:
                failure = "cadence" if last is not None and us - last != self.cadence else row.content_failure
                last = us
            feats = [None] * (f * (1 + len(LAGS)))
            if isinstance(failure, str):
                history, status = [], "INVALID_INPUT"
            else:
                failure = None
                history = [*history, [float(getattr(row, n)) for n in self.names]][-HISTORY:]
                status = "READY" if len(history) == HISTORY else "NOT_READY"
                if status == "READY":
                    feats = [*history[-1], *[history[-1 - k][i] for i in range(f) for k in LAGS]]
            out.append((key[0], row.step, None if us is None else us, status, failure, *feats))
        self.state.update((-1 if last is None else last, [v for h in history for v in h]))
        yield pd.DataFrame(out, columns=["source", "step", "us", "status", "failure", *_feature_columns(self.names)]).astype(
            {c: "float64" for c in _feature_columns(self.names)})

    def close(self) -> None:
        pass


def _micros(ts: str) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts))


def adapt_stream(parsed: DataFrame, names: list[str], cadence_seconds: float = 120.0) -> DataFrame:
    """The adapter as keyed state: last time and the last 11 rows per source."""
    rows = parsed.select("source", "step", _micros("ts").alias("us"), "content_failure", *names)
    schema = "source STRING, step BIGINT, us BIGINT, status STRING, failure STRING, " + ", ".join(f"`{c}` DOUBLE" for c in _feature_columns(names))
    out = rows.groupBy("source").transformWithStateInPandas(
        statefulProcessor=_Adapter(names, cadence_seconds), outputStructType=schema, outputMode="Append", timeMode="None")
    ts = F.timestamp_add("MICROSECOND", F.col("us"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return out.withColumn("us", ts).withColumnRenamed("us", "ts")

