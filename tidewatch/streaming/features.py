"""Streaming forms of the windowed features, the decision streak and running counters."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidewatch.functions import rules

KINDS = ("diff", "abs_diff", "diff2", "mean", "std", "deviation")


#: Keys meet in this many buckets by hash: a trigger calls Python once per bucket it touches, not once per key.
BUCKETS = 1024
BUCKET, NAME, NONE = "bucket_of_key", "name_of_key", "none_of_"  # names that begin with _ are lost on the way to Python
WHOLE = {"tinyint", "smallint", "int", "bigint"}


def _dealt(rows: DataFrame, key: str, buckets: int) -> DataFrame:
    """Rows with the bucket and the name of their key. Nulls among whole numbers are marked apart: pandas would make all of them floats."""
    whole = [c for c, t in rows.dtypes if t in WHOLE]
    name = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))  # a missing key is a key of its own
    marks = {f"{NONE}{c}": F.col(c).isNull() for c in whole}
    rows = rows.withColumns({BUCKET: F.pmod(F.xxhash64(key), F.lit(buckets)), NAME: name, **marks})
    return rows.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast(dict(rows.dtypes)[c])) for c in whole})


def _schema(rows: DataFrame, columns: list[str], made: str) -> str:
    return ", ".join([*[f"`{c}` {t}" for c, t in rows.dtypes if c in columns or c.removeprefix(NONE) in columns], made])


def _restored(out: DataFrame) -> DataFrame:
    """Marked nulls back in their places."""
    marks = {c.removeprefix(NONE): c for c in out.columns if c.startswith(NONE)}
    return out.select(*[F.when(~F.col(marks[c]), F.col(f"`{c}`")).alias(c) if c in marks else F.col(f"`{c}`") for c in out.columns if not c.startswith(NONE)])


def _numbered(rows: Iterator[pd.DataFrame], order: list[str], known: list[str]) -> tuple[pd.DataFrame, np.ndarray, list[str]]:
    """Rows by key and order, each row's key as a number, and the names of the numbers: known keys first."""
    pdf = pd.concat(list(rows), ignore_index=True)
    own, fresh = pd.factorize(pdf[NAME])
    number = {n: i for i, n in enumerate(known)}
    place = np.array([number.setdefault(n, len(number)) for n in fresh], np.int64)
    by = [c for o in order for c in (f"{NONE}{o}", o) if c in pdf.columns]
    pdf = pdf.assign(_at=place[own]).sort_values(["_at", *by], kind="stable")
    return pdf, pdf["_at"].to_numpy(), list(number)


def _starts(at: np.ndarray) -> np.ndarray:
    """For each row of a table sorted by `at`, where the run of its number begins."""
    first = np.flatnonzero(np.diff(at, prepend=-1))
    return np.repeat(first, np.diff(np.append(first, len(at))))


def window_features(values: np.ndarray, place: np.ndarray, window: int) -> dict[str, np.ndarray]:
    """Features of a (rows x tags) block of series one after another; `place` is a row's position in its series."""
    n, f = values.shape

    def after(k, made):
        out = np.full((n, f), np.nan)
        if n > k:
            out[k:] = made
        out[place < k] = np.nan
        return out

    diff = after(1, values[1:] - values[:-1])
    diff2 = after(2, values[2:] - 2 * values[1:-1] + values[:-2])
    mean = std = np.full((n, f), np.nan)
    if n >= window:
        view = np.lib.stride_tricks.sliding_window_view(values, window, axis=0)
        mean, std = after(window - 1, view.mean(axis=2)), after(window - 1, view.std(axis=2, ddof=1))
    return {"diff": diff, "abs_diff": np.abs(diff), "diff2": diff2, "mean": mean, "std": std, "deviation": values - mean}


class _Windows(StatefulProcessor):
    """Carries the last `window - 1` rows of every series of a bucket, so results do not depend on batch limits."""

    def __init__(self, cols: list[str], order: list[str], ids: list[str], kinds: tuple[str, ...], window: int):
        self.cols, self.order, self.ids, self.kinds, self.window = cols, order, ids, kinds, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("tails", "names ARRAY<STRING>, sizes ARRAY<INT>, flat ARRAY<DOUBLE>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names, sizes, flat = map(list, self.state.get()) if self.state.exists() else ([], [], [])
        pdf, own, all_names = _numbered(rows, self.order, names)
        f, before = len(self.cols), sum(sizes)
        at = np.concatenate([np.repeat(np.arange(len(names)), sizes), own])
        order = np.argsort(at, kind="stable")  # carried rows of a series come before its new ones
        block = np.vstack([np.array(flat, float).reshape(-1, f), pdf[self.cols].to_numpy(dtype=float)])[order]
        at, new = at[order], order >= before
        row, start = np.arange(len(at)), _starts(at)
        made = window_features(block, row - start, self.window)
        left = len(at) - 1 - _starts(at.max() - at[::-1])[::-1] - row  # rows of the series behind this one
        kept = left < self.window - 1
        self.state.update((all_names, np.bincount(at[kept], minlength=len(all_names)).tolist(), block[kept].ravel().tolist()))
        out = {c: pdf[c].to_numpy() for c in self.ids}
        for i, c in enumerate(self.cols):
            out[c] = block[new, i]
            out |= {f"{c}__{k}": made[k][new, i] for k in self.kinds}
        yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def stream_temporal_features(
    stream: DataFrame, key: str, order: list[str], ids: list[str], cols: list[str], window: int = 5, kinds: tuple[str, ...] = KINDS, buckets: int = BUCKETS
) -> DataFrame:
    """Differences and rolling statistics per series on a stream (null until the window is full)."""
    values = {c: F.col(c).cast("double").alias(f"value_of_{c}") for c in cols}
    rows = _dealt(stream.select(*dict.fromkeys([key, *ids, *order]), *values.values()), key, buckets)
    passed = list(dict.fromkeys([key, *ids]))
    marked = [c for c in rows.columns if c in passed or (c.startswith(NONE) and c.removeprefix(NONE) in passed)]
    inner = [f"value_of_{c}" for c in cols]
    schema = _schema(rows, passed, ", ".join(f"`{v}` DOUBLE, " + ", ".join(f"`{v}__{k}` DOUBLE" for k in kinds) for v in inner))
    out = rows.groupBy(BUCKET).transformWithStateInPandas(
        statefulProcessor=_Windows(inner, order, marked, kinds, window), outputStructType=schema, outputMode="Append", timeMode="None")
    out = _restored(out)
    made = [F.nanvl(F.col(f"`value_of_{c}__{k}`"), F.lit(None).cast("double")).alias(f"{c}__{k}") for c in cols for k in kinds]
    made = [x for i, c in enumerate(cols) for x in (F.col(f"`value_of_{c}`").alias(c), *made[i * len(kinds):(i + 1) * len(kinds)])]
    return out.select(*[F.col(f"`{c}`") for c in [key, *ids]], *made)


class _Streak(StatefulProcessor):
    """Carries the streak of every key of a bucket."""

    def __init__(self, order: list[str], passed: list[str]):
        self.order, self.passed = order, passed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("streaks", "names ARRAY<STRING>, n ARRAY<BIGINT>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names, counts = map(list, self.state.get()) if self.state.exists() else ([], [])
        pdf, at, names = _numbered(rows, self.order, names)
        carried = np.zeros(len(names), np.int64)
        carried[:len(counts)] = counts
        hit, row, start = pdf["is_hit"].to_numpy(dtype=bool), np.arange(len(at)), _starts(at)
        last_miss = np.maximum.accumulate(np.where(hit, -1, row))
        streak = np.where(last_miss < start, carried[at] + row - start + 1, row - last_miss)
        streak = np.where(hit, streak, 0)
        ends = np.append(start[1:] != start[:-1], True)
        carried[at[ends]] = streak[ends]
        self.state.update((names, carried.tolist()))
        yield pdf[self.passed].assign(streak=streak.astype("int64"))

    def close(self) -> None:
        pass


def stream_decisions(stream: DataFrame, key: str, order: list[str], state: str, threshold: int = 3, buckets: int = BUCKETS) -> DataFrame:
    """Running count of consecutive anomalies per key and the decision level."""
    rows = _dealt(stream, key, buckets)
    passed = [c for c in rows.columns if c not in (BUCKET, NAME)]
    hits = rows.withColumn("is_hit", F.coalesce(F.upper(state) == "ANOMALY", F.lit(False)))
    out = hits.groupBy(BUCKET).transformWithStateInPandas(
        statefulProcessor=_Streak(order, passed), outputStructType=_schema(rows, stream.columns, "streak BIGINT"), outputMode="Append", timeMode="None")
    out = _restored(out)
    level = rules.decision_level(F.col(state), F.col("streak"), threshold)
    return out.withColumn("level", level).withColumn("action", rules.decision_action(F.col("level")))


def status_counts(stream: DataFrame, cols: list[str]) -> DataFrame:
    """Running counters per status and failure kind (complete or update mode)."""
    return stream.groupBy(*cols).agg(F.count(F.lit(1)).alias("messages"))
