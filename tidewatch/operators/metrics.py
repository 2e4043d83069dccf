"""Evaluation metrics as aggregates over tall prediction tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def regression_errors(df: DataFrame, group: list[str], actual: str, forecast: str) -> DataFrame:
    """MAE, RMSE and R2 per group in one aggregate."""
    a, f = F.col(actual), F.col(forecast)
    e = f - a
    return (
        df.groupBy(*group)
        .agg(
            F.count(F.lit(1)).alias("rows"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
            F.sum(e * e).alias("_sse"), (F.var_pop(a) * F.count(a)).alias("_sst"),
        )
        .withColumn("r2", 1 - F.try_divide(F.col("_sse"), F.col("_sst")))
        .drop("_sse", "_sst")
    )


def confusion(df: DataFrame, group: list[str], y: str, p: str) -> DataFrame:
    """TN, FP, FN, TP, precision, recall, F1 and accuracy; a ratio over nothing is 0."""
    t, h = F.col(y) == 1, F.col(p) == 1
    n = lambda c: F.count(F.when(c, 1))
    out = df.groupBy(*group).agg(n(~t & ~h).alias("tn"), n(~t & h).alias("fp"), n(t & ~h).alias("fn"), n(t & h).alias("tp"))
    return add_scores(out).withColumn("accuracy", ratio(F.col("tn") + F.col("tp"), F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")))


def add_scores(df: DataFrame) -> DataFrame:
    """Precision, recall and F1 from tp, fp, fn."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return df.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def label_scores(df: DataFrame, group: list[str], y: str, p: str) -> DataFrame:
    """Per-label confusion scores with support; `group` ends with the label column."""
    return confusion(df, group, y, p).withColumn("support", F.col("tp") + F.col("fn"))


def multilabel_summary(per_label: DataFrame, group: list[str] = ()) -> DataFrame:
    """Micro and macro scores and Hamming loss from per-label confusion counts."""
    cells = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    s = per_label.groupBy(*group).agg(
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.sum(cells).alias("_cells"),
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"),
    )
    s = add_scores(s).withColumnsRenamed({"precision": "micro_precision", "recall": "micro_recall", "f1": "micro_f1"})
    return s.withColumn("hamming_loss", ratio(F.col("fp") + F.col("fn"), F.col("_cells"))).drop("_cells", "tp", "fp", "fn")


def threshold_counts(df: DataFrame, group: list[str], y: str, p: str, thresholds: list[float]) -> DataFrame:
    """Confusion counts at every threshold (prediction = score >= threshold).

    Scores are first counted per (group, band between thresholds): rows are read once and
    not multiplied; the sweep then works on the band counts.
    """
    ts = sorted(thresholds)
    band = F.lit(0)
    for t in ts:
        band = band + F.when(F.col(p) >= t, 1).otherwise(0)
    bands = df.groupBy(*group, band.alias("_band")).agg(
        F.count(F.when(F.col(y) == 1, 1)).alias("_pos"), F.count(F.when(F.col(y) == 0, 1)).alias("_neg"))
    steps = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.lit(i + 1).alias("_need")) for i, t in enumerate(ts)])
    hit = F.col("_band") >= F.col("_need")
    s = lambda c, n: F.sum(F.when(hit if c else ~hit, F.col(n)).otherwise(0))
    out = bands.select("*", F.inline(steps)).groupBy(*group, "threshold").agg(
        s(False, "_neg").alias("tn"), s(True, "_neg").alias("fp"), s(False, "_pos").alias("fn"), s(True, "_pos").alias("tp"))
    return add_scores(out)


def best_threshold(sweep: DataFrame, group: list[str], metric: str = "f1") -> DataFrame:
    """Threshold of the best metric per group; the first one in ascending order wins a tie and
    a metric of 0 is no improvement (null threshold)."""
    best = F.struct(F.col(metric), -F.col("threshold"))
    good = F.when(F.col(metric) > 0, F.col("threshold"))
    return sweep.groupBy(*group).agg(F.max_by(good, best).alias("best_threshold"), F.max(metric).alias(f"best_{metric}"))


def _score_steps(df: DataFrame, group: list[str], y: str, p: str) -> DataFrame:
    """Distinct scores per group with their positives and negatives and the counts below."""
    from tidewatch.operators.quantiles import value_cell
    from tidewatch.operators.series import Series

    folded = df.groupBy(*group, F.col(p).cast("double").alias("_s")).agg(
        F.count(F.when(F.col(y) == 1, 1)).alias("_pos"), F.count(F.when(F.col(y) == 0, 1)).alias("_neg"))
    fr = Series(group, ["_s"], cell=value_cell(F.col("_s"))).frame(folded)
    return fr.running_sum("_neg_below", F.col("_neg"), inclusive=False).running_sum("_pos_below", F.col("_pos"), inclusive=False).rows()


def ranking(df: DataFrame, group: list[str], y: str, p: str) -> DataFrame:
    """ROC AUC (null for one class) and step-wise average precision (0 without positives).

    Equal scores are folded before the ordered pass, so it is as long as the number of
    distinct scores; a long one is cut into chunks with carried counts.
    """
    steps = _score_steps(df, group, y, p)
    totals = df.groupBy(*group).agg(F.count(F.when(F.col(y) == 1, 1)).alias("positives"), F.count(F.when(F.col(y) == 0, 1)).alias("negatives"))
    j = steps.join(totals, group)
    above_pos, above_neg = F.col("positives") - F.col("_pos_below"), F.col("negatives") - F.col("_neg_below")
    ap_term = F.when(F.col("_pos") > 0, F.col("_pos") * above_pos / (above_pos + above_neg)).otherwise(0.0)
    out = j.groupBy(*group).agg(
        F.max("positives").alias("positives"), F.max("negatives").alias("negatives"),
        F.sum(F.col("_pos") * (F.col("_neg_below") + F.col("_neg") / 2)).alias("_u"), F.sum(ap_term).alias("_ap"))
    return out.select(
        *group, "positives", "negatives",
        F.try_divide(F.col("_u"), (F.col("positives") * F.col("negatives")).cast("double")).alias("roc_auc"),
        ratio(F.col("_ap"), F.col("positives")).alias("average_precision"))


def probability_quality(df: DataFrame, group: list[str], y: str, p: str) -> DataFrame:
    """Mean, median, p95 and maximum score of positives and of negatives per group."""
    from tidewatch.operators.quantiles import exact_quantiles

    side = F.when(F.col(y) == 1, "positive").otherwise("negative").alias("side")
    src = df.select(*group, side, F.col(p).alias("_p"))
    m = src.groupBy(*group, "side").agg(F.count(F.lit(1)).alias("rows"), F.avg("_p").alias("mean"), F.max("_p").alias("max"))
    return m.join(exact_quantiles(src, [*group, "side"], "_p", {"median": 0.5, "p95": 0.95}), [*group, "side"])


def detection_rates(df: DataFrame, row: list[str], truth: str, p: str, thresholds: list[float]) -> DataFrame:
    """Share of positive and of normal rows whose highest label score reaches each threshold."""
    top = df.groupBy(*row).agg(F.max(truth).alias("_y"), F.max(p).alias("_p"))
    c = threshold_counts(top, [], "_y", "_p", thresholds)
    return c.select("threshold", ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("attack_rate"), ratio(F.col("fp"), F.col("fp") + F.col("tn")).alias("normal_rate"))


def probability_losses(df: DataFrame, group: list[str], y: str, p: str, eps: float = 1e-7) -> DataFrame:
    """Brier score and log loss with clipped probabilities."""
    q = F.when(F.col(p).isNotNull(), F.least(F.greatest(F.col(p), F.lit(eps)), F.lit(1 - eps)))
    loss = -F.when(F.col(y) == 1, F.ln(q)).otherwise(F.ln(1 - q))
    d = F.col(p) - F.col(y)
    return df.groupBy(*group).agg(F.avg(d * d).alias("brier"), F.avg(loss).alias("log_loss"))


def reliability(df: DataFrame, group: list[str], y: str, p: str, bins: int = 10, few_groups: bool = False) -> DataFrame:
    """Quantile-binned calibration curve: mean score, observed rate and their gap."""
    from tidewatch.operators.quantiles import exact_quantiles

    edges = exact_quantiles(df, group, p, {f"_e{i}": i / bins for i in range(1, bins)}, few_groups=few_groups)
    j = df.join(F.broadcast(edges) if few_groups else edges, group)
    b = F.lit(0)
    for i in range(1, bins):
        b = b + F.when(F.col(p) > F.col(f"_e{i}"), 1).otherwise(0)
    out = j.groupBy(*group, b.alias("bin")).agg(F.count(F.lit(1)).alias("rows"), F.avg(p).alias("mean_score"), F.avg(y).alias("observed_rate"))
    return out.withColumn("gap", F.abs(F.col("mean_score") - F.col("observed_rate")))


# fixed values: quantiles of a score summary
SCORE_QUANTILES = {"p01": 0.01, "p05": 0.05, "p10": 0.10, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.90, "p95": 0.95, "p99": 0.99}


def score_summary(df: DataFrame, group: list[str], score: str, ddof: int = 0) -> DataFrame:
    from tidewatch.operators.quantiles import exact_quantiles

    std = F.stddev_pop(score) if ddof == 0 else F.stddev_samp(score)
    below = F.count(F.when(F.col(score) < 0, 1))
    m = df.groupBy(*group).agg(
        F.count(score).alias("rows"), F.min(score).alias("min"), F.max(score).alias("max"), F.avg(score).alias("mean"), std.alias("std"),
        below.alias("below_zero"), (ratio(below, F.count(score)) * 100).alias("below_zero_pct"))
    return m.join(exact_quantiles(df, group, score, SCORE_QUANTILES), group)


def class_separation(df: DataFrame, group: list[str], y: str, score: str) -> DataFrame:
    """Mean score of normal and anomalous rows and their difference."""
    m = lambda v: F.avg(F.when(F.col(y) == v, F.col(score)))
    out = df.groupBy(*group).agg(m(0).alias("mean_normal"), m(1).alias("mean_anomaly"))
    return out.withColumn("separation", F.col("mean_normal") - F.col("mean_anomaly"))


def error_group(y: str, p: str) -> Column:
    t, h = F.col(y) == 1, F.col(p) == 1
    return F.when(t & h, "TP").when(t & ~h, "FN").when(h, "FP").otherwise("TN")


def error_group_summary(df: DataFrame, group: list[str], y: str, p: str, score: str, features: list[str]) -> DataFrame:
    """Score statistics and feature means per TN / FP / FN / TP; an empty group counts 0."""
    from tidewatch.operators.quantiles import exact_quantiles

    on = [*group, "error_group"]
    src = df.withColumn("error_group", error_group(y, p))
    m = src.groupBy(*on).agg(
        F.count(F.lit(1)).alias("rows"), F.min(score).alias("min_score"), F.avg(score).alias("mean_score"), F.max(score).alias("max_score"),
        F.stddev_pop(score).alias("std_score"), *[F.avg(f).alias(f"mean_{f}") for f in features])
    m = m.join(exact_quantiles(src, on, score, {"median_score": 0.5}), on, "left")
    four = F.explode(F.array(*[F.lit(x) for x in ("TN", "FP", "FN", "TP")])).alias("error_group")
    every = df.select(*group).distinct().select(*group, four) if group else df.limit(1).select(four)
    return every.join(m, on, "left").withColumn("rows", F.coalesce("rows", F.lit(0)).cast("long"))


def error_feature_differences(df: DataFrame, group: list[str], y: str, p: str, features: list[str]) -> DataFrame:
    """Per feature: anomaly - normal, TP - FN and FP - TN differences of the means."""
    eg = error_group(y, p)
    mean = lambda f, cond: F.avg(F.when(cond, F.col(f)))
    items = [F.struct(
        F.lit(f).alias("feature"), (mean(f, F.col(y) == 1) - mean(f, F.col(y) == 0)).alias("anomaly_minus_normal"),
        (mean(f, eg == "TP") - mean(f, eg == "FN")).alias("tp_minus_fn"), (mean(f, eg == "FP") - mean(f, eg == "TN")).alias("fp_minus_tn"),
    ).alias(f"_d{i}") for i, f in enumerate(features)]
    return df.groupBy(*group).agg(*items).select(*group, F.inline(F.array(*[F.col(f"_d{i}") for i in range(len(features))])))


def forecast_accuracy(df: DataFrame, group: list[str], actual: str, forecast: str) -> DataFrame:
    """Errors plus MAPE over non-zero actuals, bias, extremes and shares within 5 % and 10 %."""
    a, e = F.col(actual), F.col(forecast) - F.col(actual)
    pct = F.when(a != 0, F.abs(e / F.when(a != 0, a)) * 100)
    extra = df.groupBy(*group).agg(
        F.avg(pct).alias("mape"), F.avg(e).alias("mean_error"), F.max(F.abs(e)).alias("max_abs_error"), F.stddev_pop(e).alias("std_error"),
        *[(F.avg(F.when(F.abs(e) <= F.abs(a) * (n / 100), 1.0).otherwise(0.0)) * 100).alias(f"within_{n}_pct") for n in (5, 10)])
    return regression_errors(df, group, actual, forecast).join(extra, group)


# fixed values: ramp ranges (closed on the right) by upper bound; the last has none
RAMP_RANGES = {"0-2 MW": 2, "2-5 MW": 5, "5-10 MW": 10, "10-20 MW": 20, "20-50 MW": 50, ">50 MW": None}


def right_closed_bin(v: Column, ranges: dict[str, float | None] = RAMP_RANGES) -> Column:
    """Name of the range (lo, hi] a value falls into; null for a missing value."""
    from tidewatch.functions.rules import choose

    last = next(name for name, hi in ranges.items() if hi is None)
    return F.when(v.isNotNull(), choose([(v <= hi, name) for name, hi in ranges.items() if hi is not None], last))


def errors_by_bin(df: DataFrame, group: list[str], bin_of: Column, error: str) -> DataFrame:
    return df.groupBy(*group, bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("rows"), F.avg(error).alias("mean_error"), F.max(error).alias("max_error"))


def fold_summary(folds: DataFrame, group: list[str], metrics: list[str]) -> DataFrame:
    """Mean, population deviation and minimum of each metric over the folds."""
    return folds.groupBy(*group).agg(*[f(m).alias(f"{m}_{n}") for m in metrics for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min))])


def candidate_robustness(scores: DataFrame, name: str, sample: str, samples: list[str], metric: str, size: str, reference: str, others: list[str] = ()) -> DataFrame:
    """Mean and spread of a metric over the samples, its value and delta to a reference
    candidate per sample, means of further metrics and the size reduction."""
    value = lambda s: F.max(F.when(F.col(sample) == s, F.col(metric)))
    per = scores.groupBy(name).agg(
        F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("std"), (F.max(metric) - F.min(metric)).alias("difference"), F.max(size).alias("size"),
        *[value(s).alias(s) for s in samples], *[F.avg(o).alias(f"mean_{o}") for o in others])
    ref = per.filter(F.col(name) == reference)
    deltas = {f"{c}_delta": F.col(c) - ref.select(c).scalar() for c in ("mean", *samples)}
    return per.withColumns({**deltas, "reduction_pct": (1 - F.col("size") / ref.select("size").scalar()) * 100})
