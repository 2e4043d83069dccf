"""Column profiles, quality flags, drift between samples, duplicates and contracts' counts."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.quantiles import exact_quantiles, unpivot
from tidewatch.operators.series import Series, with_group_value
from tidewatch.sources.tables import pin, surplus_copies

INF = float("inf")
# fixed values: quantiles of the quality profile
QUALITY_QUANTILES = {"q01": 0.01, "q05": 0.05, "q25": 0.25, "median": 0.5, "q75": 0.75, "q95": 0.95, "q99": 0.99}


def _finite(v: Column) -> Column:
    return F.when(~F.isnan(v) & (F.abs(v) != INF), v)


def feature_moments(df: DataFrame, cols: list[str], group: list[str] = ()) -> DataFrame:
    """Counts and moments per feature. One wide aggregate (no row explosion), then its single
    row per group is turned into one row per feature."""
    group = list(group)
    aggs: list[Column] = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(cols):
        v = F.col(c).cast("double")
        ok = _finite(v)
        aggs.append(F.struct(
            F.lit(c).alias("feature"),
            F.count(ok).alias("valid"),
            (F.count(F.lit(1)) - F.count(v)).alias("missing"),
            F.count(F.when(F.abs(v) == INF, 1)).alias("infinite"),
            F.count(F.when(v == 0, 1)).alias("zeros"),
            F.min(ok).alias("min"), F.max(ok).alias("max"), F.avg(ok).alias("mean"), F.stddev_samp(ok).alias("std"),
            F.max(F.abs(ok)).alias("abs_max"),
        ).alias(f"_f{i}"))
    wide = df.groupBy(*group).agg(*aggs)
    return wide.select(*group, F.col("_rows").alias("rows"), F.inline(F.array(*[F.col(f"_f{i}") for i in range(len(cols))])))


def distinct_values(df: DataFrame, cols: list[str], group: list[str] = (), count_null: bool = False) -> DataFrame:
    """Distinct values per feature; optionally null counts as one more value."""
    tall = unpivot(df, list(group), cols)
    n = F.count_distinct("value")
    if count_null:
        n = n + F.max(F.when(F.col("value").isNull(), 1).otherwise(0))
    return tall.groupBy(*group, "feature").agg(n.cast("long").alias("distinct_values"))


def column_profile(df: DataFrame, cols: list[str], group: list[str] = ()) -> DataFrame:
    """Distinct, moments, median, missing, infinite and zero counts with quality flags."""
    group = list(group)
    on = [*group, "feature"]
    tall = unpivot(df, group, cols).filter(_finite(F.col("value")).isNotNull())
    med = exact_quantiles(tall, on, "value", {"median": 0.5}, few_groups=not group)
    return (
        feature_moments(df, cols, group)
        .join(distinct_values(df, cols, group), on, "left").join(med, on, "left")
        .withColumn("zero_variance", F.coalesce(F.col("std") == 0, F.lit(False)))
        .withColumn("near_zero_variance", F.coalesce((F.col("std") > 0) & (F.col("std") < 1e-8), F.lit(False)))
        .withColumn("wide_range", F.coalesce(F.col("max") - F.col("min") > 1000, F.lit(False)))
    )


def quality_profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """Valid and missing shares, moments and q01..q99 per feature."""
    tall = unpivot(df, [], cols).filter(_finite(F.col("value")).isNotNull())
    q = exact_quantiles(tall, ["feature"], "value", QUALITY_QUANTILES, few_groups=True)
    return (
        feature_moments(df, cols).join(distinct_values(df, cols), "feature", "left").join(q, "feature", "left")
        .withColumn("missing_pct", F.try_divide(F.col("missing") * 100.0, F.col("rows").cast("double")))
    )


def value_counts(df: DataFrame, cols: list[str], group: list[str] = ()) -> DataFrame:
    """Frequency and share of each value per feature."""
    tall = unpivot(df, list(group), cols).groupBy(*group, "feature", "value").agg(F.count(F.lit(1)).alias("rows"))
    out = with_group_value(tall, df, list(group), F.count(F.lit(1)), "_all")
    return out.withColumn("share", F.col("rows") / F.col("_all")).drop("_all")


def dominant_share(df: DataFrame, cols: list[str], threshold: float = 0.99) -> DataFrame:
    """Share of the most frequent value per feature and the near-constant flag."""
    counts = unpivot(df, [], cols).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    share = F.max("n") / F.sum("n")
    return counts.groupBy("feature").agg(share.alias("top_share")).withColumn("near_constant", F.col("top_share") >= threshold)


def kind_counts(distinct: DataFrame) -> DataFrame:
    """How many features are constant, binary and continuous."""
    n = F.col("distinct_values")
    kind = F.when(n <= 1, "constant").when(n == 2, "binary").otherwise("continuous")
    return distinct.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("features"))


def table_health(df: DataFrame, series: Series) -> DataFrame:
    """Rows, null cells, duplicate rows and rows that step back in time (ties allowed)."""
    nulls = reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in df.columns])
    counts = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(nulls), F.lit(0)).cast("long").alias("null_cells"))
    counts = counts.withColumn("duplicate_rows", surplus_copies(df, df.columns).scalar())
    return counts.withColumn("backward_steps", backward_steps(df, series).scalar()).withColumn("monotonic", F.col("backward_steps") == 0)


def backward_steps(df: DataFrame, series: Series) -> DataFrame:
    """Rows whose timestamp is earlier than the row before them in ordinal order."""
    ts = series.order[-1]
    fr = series.frame(df.select(*series.keys, *series.order), before=1)
    fr = fr.with_columns({"_back": (F.lag(ts).over(fr.window()) > F.col(ts)).cast("int")})
    return fr.rows().agg(F.coalesce(F.sum("_back"), F.lit(0)).cast("long").alias("backward_steps"))


def duplicate_groups(df: DataFrame, cols: list[str]) -> DataFrame:
    """Groups of equal values with more than one row."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def sample_stability(a: DataFrame, b: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct, min, max and mean of two samples side by side with constant flags."""

    def side(df, tag):
        m = feature_moments(df, cols).join(distinct_values(df, cols), "feature")
        return m.select("feature", *[F.col(c).alias(f"{c}_{tag}") for c in ("distinct_values", "min", "max", "mean")])

    both = side(a, "a").join(side(b, "b"), "feature")
    ca, cb = F.col("distinct_values_a") <= 1, F.col("distinct_values_b") <= 1
    return both.withColumns({"constant_a": ca, "constant_b": cb, "constant_both": ca & cb})


# fixed values: quantiles whose shift counts for the priority, and those a drift table lists
PRIORITY_QUANTILES = ["q05", "median", "q95"]


def drift(base: DataFrame, others: dict[str, DataFrame], cols: list[str], zero_std_as_zero: bool = False) -> DataFrame:
    """Signed shift of mean, median, q05 and q95 of each sample in base standard deviations,
    the share of its values outside the base range, and the quantiles of both sides. All
    samples share the same few passes.

    A constant base feature has no scale: its shifts are null, or 0 with `zero_std_as_zero`.
    """
    parts = [base.select(F.lit("").alias("sample"), *cols), *[df.select(F.lit(n).alias("sample"), *cols) for n, df in others.items()]]
    rows = reduce(DataFrame.unionByName, parts)
    on = ["sample", "feature"]
    tall = unpivot(rows, ["sample"], cols)
    stats = feature_moments(rows, cols, ["sample"]).join(exact_quantiles(tall, on, "value", QUALITY_QUANTILES, few_groups=True), on)
    # one row per sample and feature, used three times: kept, so the readings are not read again
    stats = pin(stats)
    kept = ["mean", "std", "min", "max", *QUALITY_QUANTILES]
    side = lambda tag, df: df.select(*on, *[F.col(c).alias(f"{tag}_{c}") for c in kept])
    b = side("base", stats.filter("sample = ''")).drop("sample")
    o = side("other", stats.filter("sample <> ''"))
    # base ranges: one row per feature
    limits = F.broadcast(b.select("feature", "base_min", "base_max"))
    v, lo, hi = F.col("value"), F.col("base_min"), F.col("base_max")
    outside = tall.filter("sample <> ''").join(limits, "feature").groupBy(*on).agg(
        (F.avg(F.when(v < lo, 1.0).otherwise(0.0)) * 100).alias("below_pct"), (F.avg(F.when(v > hi, 1.0).otherwise(0.0)) * 100).alias("above_pct"))

    def shift(c):
        z = F.try_divide(F.col(f"other_{c}") - F.col(f"base_{c}"), F.col("base_std"))
        return F.when(F.col("base_std") > 0, z).otherwise(F.lit(0.0) if zero_std_as_zero else None)

    out = o.join(b, "feature").join(outside, on)
    out = out.withColumns({f"{c}_shift": shift(c) for c in ("mean", *PRIORITY_QUANTILES)})
    return out.withColumns({
        "shift_flag": F.coalesce(F.abs("mean_shift") >= 2, F.lit(False)),
        "range_flag": (F.col("below_pct") + F.col("above_pct")) > 1,
    })


def drift_priority(drifts: DataFrame) -> DataFrame:
    """Largest absolute shift and largest outside share of each feature over all samples;
    ranked by the outside share, then the shift. One row per feature goes into the rank."""
    shift = F.greatest(*[F.abs(f"{c}_shift") for c in ("mean", *PRIORITY_QUANTILES)])
    scored = drifts.groupBy("feature").agg(F.max(shift).alias("shift_priority"), F.max(F.col("below_pct") + F.col("above_pct")).alias("range_priority"))
    order = Window.orderBy(F.desc("range_priority"), F.desc("shift_priority"), F.asc("feature"))
    return scored.withColumn("shift_rank", F.row_number().over(order))


def temporal_feasibility(df: DataFrame, series: Series, cols: list[str], gap_seconds: float, window: int = 5) -> DataFrame:
    """How strongly each feature changes inside gap-free sequences."""
    from tidewatch.operators.windows import temporal_features

    feats = temporal_features(df, series, cols, gap_seconds, window, kinds=("diff", "std"))
    tall = feats.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"{c}__diff").alias("diff"), F.col(f"{c}__std").alias("std")) for c in cols
    ])))
    d = F.abs(F.col("diff"))
    stats = tall.groupBy("feature").agg(
        F.count("diff").alias("steps"), F.coalesce(F.avg(F.when(F.col("diff") != 0, 1.0).when(F.col("diff") == 0, 0.0)), F.lit(0.0)).alias("change_rate"),
        F.avg(d).alias("mean_abs_change"), F.max(d).alias("max_abs_change"), F.stddev_samp("diff").alias("std_of_diff"),
        F.avg("std").alias("mean_rolling_std"), F.max("std").alias("max_rolling_std"),
    )
    q = exact_quantiles(tall.withColumn("_a", d), ["feature"], "_a", {"median_abs_change": 0.5, "p95_abs_change": 0.95}, few_groups=True)
    qs = exact_quantiles(tall, ["feature"], "std", {"median_rolling_std": 0.5, "p95_rolling_std": 0.95}, few_groups=True)
    return stats.join(q, "feature", "left").join(qs, "feature", "left")


def family_summary(df: DataFrame, family: str, values: list[str]) -> DataFrame:
    """Count, mean, median and maximum of each statistic per feature family."""
    aggs = [a for v in values for a in (F.avg(v).alias(f"mean_{v}"), F.max(v).alias(f"max_{v}"))]
    out = df.groupBy(family).agg(F.count(F.lit(1)).alias("features"), *aggs)
    for v in values:
        out = out.join(exact_quantiles(df, [family], v, {f"median_{v}": 0.5}), family, "left")
    return out


def column_groups(names: DataFrame, name: str) -> DataFrame:
    """Column names grouped by their prefix (process) and the kind of tag at their end."""
    parts = F.split(name, "_")
    kind = F.regexp_replace(F.element_at(parts, -1), r"[0-9]+$", "")
    return names.groupBy(F.element_at(parts, 1).alias("process"), kind.alias("tag_type")).agg(F.count(F.lit(1)).alias("columns"))
