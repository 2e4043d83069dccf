"""Leakage-free splits: chronological, by episode, with guards and within episodes."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.series import Series
from tidewatch.operators.windows import positions


def positional_split(df: DataFrame, series: Series, fraction: float, names=("train", "test")) -> DataFrame:
    """First floor(n * fraction) rows of each series and the rest."""
    p = positions(df, series, "_p", "_n")
    return p.withColumn("split", F.when(F.col("_p") < F.floor(F.col("_n") * F.lit(fraction)), names[0]).otherwise(names[1])).drop("_p", "_n")


class Cuts:
    """Order keys of the rows at given fractions of one long series.

    Found once; a split is then a filter on the order columns, which reaches the scan, instead
    of a window that every training pass would repeat.
    """

    def __init__(self, df: DataFrame, series: Series, fractions: list[float]):
        self.order = series.order
        p = positions(df.select(*series.order), series, "_p", "_n")
        wanted = F.array(*[F.struct(F.lit(float(f)).alias("f"), F.floor(F.col("_n") * F.lit(f)).alias("at")) for f in fractions])
        types = dict(df.dtypes)
        self.types = [types[c] for c in series.order]
        # as text: a typed literal made from it does not depend on the session's time zone
        hit = p.select(*[F.col(c).cast("string").alias(c) for c in series.order], F.explode(F.filter(wanted, lambda w: w["at"] == F.col("_p"))).alias("_w"))
        self.keys = {r["f"]: [r[c] for c in self.order] for r in hit.select(*self.order, "_w.f").collect()}

    def before(self, fraction: float) -> Column:
        """Rows ahead of the cut; all rows for a fraction of 1."""
        key = self.keys.get(float(fraction))
        if key is None:
            return F.lit(True)
        out, tie = F.lit(False), F.lit(True)
        at = [F.lit(v).cast(t) for v, t in zip(key, self.types)]
        for c, v in zip(self.order, at):
            out = out | (tie & (F.col(c) < v))
            tie = tie & (F.col(c) == v)
        # the leading bound alone can be pushed to the scan
        return (F.col(self.order[0]) <= at[0]) & out

    def between(self, low: float, high: float) -> Column:
        return ~self.before(low) & self.before(high)


# fixed values: expanding folds (train up to, test up to), as fractions of the rows
FOLDS = [(0.6, 0.8), (0.7, 0.9), (0.8, 1.0)]


def expanding_folds(df: DataFrame, series: Series, folds=FOLDS) -> DataFrame:
    """One copy of a row per fold that uses it, marked train or test."""
    p = positions(df, series, "_p", "_n")
    n, pos = F.col("_n"), F.col("_p")
    items = []
    for i, (a, b) in enumerate(folds, 1):
        role = F.when(pos < F.floor(n * F.lit(a)), "train").when(pos < F.floor(n * F.lit(b)), "test")
        items.append(F.struct(F.lit(i).alias("fold"), role.alias("role")))
    return p.select(*df.columns, F.inline(F.array(*items))).filter(F.col("role").isNotNull())


def elapsed_split(df: DataFrame, ts: str, shares=(0.6, 0.8), names=("train", "validation", "test")) -> DataFrame:
    """Split by shares of the elapsed time between the first and last row."""
    span = df.agg(F.min(ts).alias("_a"), F.max(ts).alias("_b"))
    total = F.timestamp_diff("MICROSECOND", F.col("_a"), F.col("_b"))
    since = F.timestamp_diff("MICROSECOND", F.col("_a"), F.col(ts))
    label = F.when(since < total * F.lit(shares[0]), names[0]).when(since < total * F.lit(shares[1]), names[1]).otherwise(names[2])
    return df.withColumns({c: span.select(c).scalar() for c in ("_a", "_b")}).withColumn("split", label).drop("_a", "_b")


def crossing_groups(df: DataFrame, group: str, split: str = "split") -> DataFrame:
    """Groups with rows in more than one split."""
    pairs = df.filter(F.col(group).isNotNull()).groupBy(group, split).agg(F.count(F.lit(1)).alias("rows"))
    return pairs.groupBy(group).agg(F.count(F.lit(1)).alias("splits"), F.sum("rows").alias("rows")).filter("splits > 1")


def timestamp_split(df: DataFrame, ts: str, cuts: list[str], names: list[str]) -> DataFrame:
    """Split at fixed timestamps; a cut belongs to the later split."""
    out = None
    for cut, name in zip(cuts, names):
        c = F.col(ts) < F.lit(cut).cast("timestamp_ntz")
        out = F.when(c, name) if out is None else out.when(c, name)
    return df.withColumn("split", out.otherwise(names[-1]))


def overlap(parts: dict[str, DataFrame], cols: list[str]) -> DataFrame:
    """Values shared by any two parts: no rows means no leakage."""
    tagged = reduce(DataFrame.unionByName, [df.select(*cols).distinct().withColumn("_part", F.lit(n)) for n, df in parts.items()])
    # at most one row per part and value
    return tagged.groupBy(*cols).agg(F.count(F.lit(1)).alias("parts")).filter("parts > 1")


def holdout_by_scenario(df: DataFrame, ts: str, scenario: str, normal: Column, held_out: list[str]) -> DataFrame:
    """Held-out scenarios, and normal rows inside their overall time span, are for evaluation."""
    held = F.coalesce(F.col(scenario).isin(held_out), F.lit(False))
    span = df.filter(held).agg(F.min(ts).alias("_a"), F.max(ts).alias("_b"))
    inside = normal & F.col(ts).between(F.col("_a"), F.col("_b"))
    out = df.withColumns({c: span.select(c).scalar() for c in ("_a", "_b")})
    return out.withColumn("split", F.when(held | F.coalesce(inside, F.lit(False)), "evaluation").otherwise("train")).drop("_a", "_b")


def subset_split(df: DataFrame, scenario: str, chosen: list[str], names=("calibration", "train")) -> DataFrame:
    return df.withColumn("split", F.when(F.col(scenario).isin(chosen), names[0]).otherwise(names[1]))


def _minute_roles(df: DataFrame, ts: str, scenario: str, episode: Column, role) -> DataFrame:
    """Role of each (scenario, minute); ranked on distinct minutes, so an episode with many
    rows per minute costs no more than its number of minutes."""
    minutes = df.filter(episode).select(scenario, F.date_trunc("minute", ts).alias("_m")).distinct()
    w = Window.partitionBy(scenario)
    marked = minutes.withColumn("_i", F.row_number().over(w.orderBy("_m"))).withColumn("_k", F.count(F.lit(1)).over(w))
    return marked.select(scenario, "_m", role(F.col("_i"), F.col("_k")).alias("split"))


def _within(df, series, ts, scenario, episode, role, fraction, names) -> DataFrame:
    roles = _minute_roles(df, ts, scenario, episode, role)
    rows = df.filter(episode).withColumn("_m", F.date_trunc("minute", ts)).join(roles, [scenario, "_m"]).drop("_m")
    normal = positional_split(df.filter(~episode), series, fraction, names)
    return rows.select(*df.columns, "split").unionByName(normal.select(*df.columns, "split"))


def last_minute_split(df: DataFrame, series: Series, ts: str, scenario: str, episode: Column) -> DataFrame:
    """Within each episode: last minute calibration, the one before guard (if three or more),
    the rest training. Other rows: first 80 % training. One-minute episodes are `too_short`."""
    def role(i, k):
        return F.when(k < 2, "too_short").when(i == k, "calibration").when((k >= 3) & (i == k - 1), "guard").otherwise("train")

    return _within(df, series, ts, scenario, episode, role, 0.8, ("train", "calibration"))


def half_guard_split(df: DataFrame, series: Series, ts: str, scenario: str, episode: Column) -> DataFrame:
    """Within each episode: first half fit, one guard minute, the rest validation; two-minute
    episodes have no guard. Other rows: half and half."""
    def role(i, k):
        fit = F.least(F.greatest(F.lit(1), F.floor(k / 2)), k - 2)
        three = F.when(i <= fit, "fit").when(i == fit + 1, "guard").otherwise("validation")
        return F.when(k < 2, "too_short").when(k == 2, F.when(i == 1, "fit").otherwise("validation")).otherwise(three)

    return _within(df, series, ts, scenario, episode, role, 0.5, ("fit", "validation"))
