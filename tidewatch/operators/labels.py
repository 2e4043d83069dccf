"""Event labels: catalogues, multi-label targets, coverage and scenario statistics."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.windows import seconds_between


def minute_label(df: DataFrame, ts: str, label: str) -> DataFrame:
    return df.groupBy(F.date_trunc("minute", ts).alias("minute")).agg(F.max(label).alias(label))


def stamp_repetition(df: DataFrame, stamp: str, label: str) -> DataFrame:
    """Rows, distinct labels and label sum per timestamp."""
    return df.groupBy(stamp).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(label).alias("distinct_labels"), F.sum(label).alias("label_sum"))


def repetition_histogram(per_stamp: DataFrame) -> DataFrame:
    return per_stamp.groupBy("rows").agg(F.count(F.lit(1)).alias("timestamps"), F.sum(F.when(F.col("distinct_labels") > 1, 1).otherwise(0)).alias("mixed"))


def odd_buckets(df: DataFrame, ts: str, unit: str, expected: int) -> DataFrame:
    """Time buckets whose row count is not the expected one."""
    return df.groupBy(F.date_trunc(unit, ts).alias("bucket")).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") != expected)


def scenario_blocks(df: DataFrame, scenario: str, ts: str, codes: str) -> DataFrame:
    return df.filter(F.col(scenario).isNotNull()).groupBy(scenario).agg(
        F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"), F.count(F.lit(1)).alias("rows"), F.min_by(codes, ts).alias("codes")
    ).withColumn("duration_s", seconds_between(F.col("start_ts"), F.col("end_ts")))


def distribution(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows per combination with its percentage of all rows."""
    n = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("rows"))
    return n.withColumn("pct", F.col("rows") * 100.0 / n.agg(F.sum("rows")).scalar())


def label_matrix(df: DataFrame, codes: Column, labels: list[str]) -> DataFrame:
    """0/1 column per label from an array of codes."""
    return df.withColumns({x: F.coalesce(F.array_contains(codes, x), F.lit(False)).cast("int") for x in labels})


def label_count(labels: list[str]) -> Column:
    out = F.lit(0)
    for x in labels:
        out = out + F.col(x)
    return out


def cardinality(df: DataFrame, labels: list[str]) -> DataFrame:
    """How many rows carry 0, 1, 2 … labels."""
    return df.groupBy(label_count(labels).alias("labels_per_row")).agg(F.count(F.lit(1)).alias("rows"))


def coverage(df: DataFrame, split: str, splits: list[str], labels: list[str]) -> DataFrame:
    """Positives per label and split, and where the label is seen. One wide aggregate per split."""
    wide = df.groupBy(split).agg(*[F.sum(x).alias(x) for x in labels])
    tall = wide.select(split, F.inline(F.array(*[F.struct(F.lit(x).alias("label"), F.col(x).cast("long").alias("n")) for x in labels])))
    out = tall.groupBy("label").agg(*[F.coalesce(F.sum(F.when(F.col(split) == s, F.col("n"))), F.lit(0)).cast("long").alias(s) for s in splits])
    first, rest = F.col(splits[0]), F.greatest(*[F.col(s) for s in splits[1:]]) if len(splits) > 2 else F.col(splits[1])
    status = F.when((first > 0) & (rest > 0), "common").when(first > 0, f"{splits[0]}_only").when(rest > 0, f"unseen_in_{splits[0]}").otherwise("absent")
    return out.withColumn("status", status)


def incidence(pairs: DataFrame, scenario: str, code: str) -> DataFrame:
    """Distinct scenario and code pairs with the number of scenarios that carry the code."""
    pairs = pairs.select(scenario, F.col(code).alias("code")).distinct()
    freq = pairs.groupBy("code").agg(F.count(F.lit(1)).alias("scenarios"))
    return pairs.join(freq, "code")


def mandatory_scenarios(inc: DataFrame, scenario: str) -> DataFrame:
    """Scenarios that are the only ones with some code."""
    return inc.filter("scenarios = 1").groupBy(scenario).agg(F.count(F.lit(1)).alias("unique_codes"))


def holdout_eligible(inc: DataFrame, scenario: str) -> DataFrame:
    """Scenarios whose every code also occurs elsewhere."""
    return inc.groupBy(scenario).agg(F.min("scenarios").alias("rarest"), F.count(F.lit(1)).alias("codes")).filter("rarest >= 2")


def top_label_per_scenario(df: DataFrame, scenario: str, top: str, score: str, order: str) -> DataFrame:
    """Most frequent top-1 label of each scenario, its share, and mean, median and maximum of
    the rows' highest scores. Of equally frequent labels the one seen first wins."""
    from tidewatch.operators.quantiles import exact_quantiles

    n = df.groupBy(scenario, top).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("_first"), F.sum(score).alias("_sum"), F.max(score).alias("_max"))
    out = n.groupBy(scenario).agg(
        F.sum("n").alias("rows"), F.min_by(top, F.struct(-F.col("n"), F.col("_first"))).alias("top_label"), (F.max("n") / F.sum("n")).alias("top_share"),
        (F.sum("_sum") / F.sum("n")).alias("mean_max_score"), F.max("_max").alias("max_score"))
    return out.join(exact_quantiles(df, [scenario], score, {"median_max_score": 0.5}), scenario, "left")
