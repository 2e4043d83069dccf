from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.checks.common import by_user, events, r
from tidewatch.checks.profile import measures
from tidewatch.checks.registry import query
from tidewatch.checks.windows import LEADS, U
from tidewatch.operators import metrics as m, windows as w
from tidewatch.operators.correlate import pearson_of
from tidewatch.operators.topk import top_k
from tidewatch.sources.tables import table

# Tall (row, label, y, p): two labels per document with a score from its length.
PROB = """prob AS (SELECT l.doc_id AS row_id, 'quality' AS label, quality AS y, 1.0 / (1 + exp(-(n_chars - 900) / 700.0)) AS p FROM labels l JOIN documents d ON l.doc_id = d.doc_id
UNION ALL SELECT l.doc_id, 'toxic', toxic, round(1.0 - 1.0 / (1 + exp(-(n_chars - 900) / 700.0)), 2) FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def probabilities(spark, d):
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    s = 1 / (1 + F.exp(-(F.col("n_chars") - 900) / F.lit(700.0)))
    return j.select(F.col("doc_id").alias("row_id"), F.inline(F.array(
        F.struct(F.lit("quality").alias("label"), F.col("quality").alias("y"), s.alias("p")),
        F.struct(F.lit("toxic").alias("label"), F.col("toxic").alias("y"), F.round(1 - s, 2).alias("p")))))


def rr(df, keep, cols, places=6):
    return df.select(*keep, *[r(c, places).alias(c) for c in cols])


CONF = """count(*) FILTER (y = 0 AND h = 0) AS tn, count(*) FILTER (y = 0 AND h = 1) AS fp, count(*) FILTER (y = 1 AND h = 0) AS fn, count(*) FILTER (y = 1 AND h = 1) AS tp"""
PRF = """coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1"""
HARD = f"{PROB}, hard AS (SELECT *, (p >= 0.5)::INT AS h FROM prob)"
ROUND3 = "round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1"


def hard(spark, d):
    return probabilities(spark, d).withColumn("h", (F.col("p") >= 0.5).cast("int"))


@query("G30_confusion", f"WITH {HARD}, c AS (SELECT label, {CONF} FROM hard GROUP BY 1), s AS (SELECT *, {PRF} FROM c) SELECT label, tn, fp, fn, tp, {ROUND3}, round((tn + tp) / (tn + fp + fn + tp), 6) AS accuracy FROM s")
def g30(spark, d):
    return rr(m.confusion(hard(spark, d), ["label"], "y", "h"), ["label", "tn", "fp", "fn", "tp"], ["precision", "recall", "f1", "accuracy"])


MULTI = ["micro_precision", "micro_recall", "micro_f1", "macro_precision", "macro_recall", "macro_f1", "hamming_loss"]
MULTI_SQL = """SELECT {g} round(sum(tp) / nullif(sum(tp + fp), 0), 6) AS micro_precision, round(sum(tp) / nullif(sum(tp + fn), 0), 6) AS micro_recall,
round(2 * sum(tp) / nullif(sum(2 * tp + fp + fn), 0), 6) AS micro_f1, round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1,
round(sum(fp + fn) / sum(tn + fp + fn + tp), 6) AS hamming_loss FROM s"""


@query("G31_multilabel_scores", f"WITH {HARD}, c AS (SELECT label, {CONF} FROM hard GROUP BY 1), s AS (SELECT *, {PRF} FROM c) " + MULTI_SQL.format(g=""))
def g31(spark, d):
    return rr(m.multilabel_summary(m.label_scores(hard(spark, d), ["label"], "y", "h")), [], MULTI)


@query("G32_label_scores", f"WITH {HARD}, c AS (SELECT label, {CONF} FROM hard GROUP BY 1), s AS (SELECT *, {PRF} FROM c) SELECT label, {ROUND3}, tp + fn AS support FROM s")
def g32(spark, d):
    return rr(m.label_scores(hard(spark, d), ["label"], "y", "h"), ["label", "support"], ["precision", "recall", "f1"])


RANKED = f"""{PROB}, k AS (SELECT *, rank() OVER (PARTITION BY label ORDER BY p) + (count(*) OVER (PARTITION BY label, p) - 1) / 2.0 AS rk FROM prob)"""


@query("G33_roc_auc", f"""WITH {RANKED} SELECT label, sum(y)::BIGINT AS positives, count(*) - sum(y)::BIGINT AS negatives,
round((sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * (count(*) - sum(y)), 0), 6) AS roc_auc FROM k GROUP BY 1""")
def g33(spark, d):
    return rr(m.ranking(probabilities(spark, d), ["label"], "y", "p"), ["label", "positives", "negatives"], ["roc_auc"])


@query("G34_average_precision", f"""WITH {PROB}, k AS (SELECT label, p, sum(y) AS pos, count(*) AS n FROM prob GROUP BY 1, 2),
c AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS seen FROM k WINDOW w AS (PARTITION BY label ORDER BY p DESC))
SELECT label, round(coalesce(sum(pos * tp / seen) / nullif(sum(pos), 0), 0), 6) AS average_precision FROM c GROUP BY 1""")
def g34(spark, d):
    return rr(m.ranking(probabilities(spark, d), ["label"], "y", "p"), ["label"], ["average_precision"])


SWEEP = [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
# fixed values: the two sweeps of classifier diagnostics
SWEEP_9 = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
SWEEP_17 = [0.000001, 0.000005, 0.00001, 0.00002, 0.00005, 0.0001, 0.0002, 0.0005, 0.001, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.5]


def sweep_sql(thresholds):
    return f"""{PROB}, t AS (SELECT unnest({thresholds}::DOUBLE[]) AS threshold), x AS (SELECT label, threshold, y, (p >= threshold)::INT AS h FROM prob, t),
c AS (SELECT label, threshold, {CONF} FROM x GROUP BY 1, 2), s AS (SELECT *, {PRF} FROM c)"""


SWEEP_SQL = sweep_sql(SWEEP)
for _name, _thresholds in (("G35_threshold_sweep", SWEEP), ("G35_threshold_sweep_9", SWEEP_9), ("G35_threshold_sweep_17", SWEEP_17)):
    @query(_name, f"WITH {sweep_sql(_thresholds)} " + MULTI_SQL.format(g="threshold,") + " GROUP BY threshold")
    def g35(spark, d, thresholds=_thresholds):
        c = m.threshold_counts(probabilities(spark, d), ["label"], "y", "p", thresholds)
        return rr(m.multilabel_summary(c, ["threshold"]), ["threshold"], MULTI)


@query("G36_best_threshold", f"WITH {SWEEP_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY f1 DESC, threshold) AS k FROM s) SELECT label, threshold AS best_threshold, round(f1, 6) AS best_f1 FROM b WHERE k = 1")
def g36(spark, d):
    c = m.threshold_counts(probabilities(spark, d), ["label"], "y", "p", SWEEP)
    return rr(m.best_threshold(c, ["label"]), ["label", "best_threshold"], ["best_f1"])


@query("G37_probability_quality", f"""WITH {PROB} SELECT label, CASE WHEN y = 1 THEN 'positive' ELSE 'negative' END AS side, count(*) AS rows, round(avg(p), 6) AS mean,
round(max(p), 6) AS max, round(quantile_cont(p, 0.5), 6) AS median, round(quantile_cont(p, 0.95), 6) AS p95 FROM prob GROUP BY 1, 2""")
def g37(spark, d):
    return rr(m.probability_quality(probabilities(spark, d), ["label"], "y", "p"), ["label", "side", "rows"], ["mean", "max", "median", "p95"])


@query("G38_detection_rates", f"""WITH {PROB}, x AS (SELECT row_id, max(y) AS y, max(p) AS p FROM prob GROUP BY 1), t AS (SELECT unnest({SWEEP}::DOUBLE[]) AS threshold)
SELECT threshold, round(coalesce(avg((p >= threshold)::INT) FILTER (y = 1), 0), 6) AS attack_rate, round(coalesce(avg((p >= threshold)::INT) FILTER (y = 0), 0), 6) AS normal_rate FROM x, t GROUP BY 1""")
def g38(spark, d):
    return rr(m.detection_rates(probabilities(spark, d), ["row_id"], "y", "p", SWEEP), ["threshold"], ["attack_rate", "normal_rate"])


@query("G39_brier_log_loss", f"""WITH {PROB}, q AS (SELECT *, least(greatest(p, 1e-7), 1 - 1e-7) AS c FROM prob)
SELECT label, round(avg((p - y) ** 2), 6) AS brier, round(avg(-CASE WHEN y = 1 THEN ln(c) ELSE ln(1 - c) END), 6) AS log_loss FROM q GROUP BY 1""")
def g39(spark, d):
    return rr(m.probability_losses(probabilities(spark, d), ["label"], "y", "p"), ["label"], ["brier", "log_loss"])


@query("G40_reliability_curve", f"""WITH {PROB}, e AS (SELECT label, {", ".join(f"quantile_cont(p, {i / 10}) AS e{i}" for i in range(1, 10))} FROM prob GROUP BY 1),
b AS (SELECT label, y, p, ({" + ".join(f"(p > e{i})::INT" for i in range(1, 10))})::INTEGER AS bin FROM prob JOIN e USING (label))
SELECT label, bin, count(*) AS rows, round(avg(p), 6) AS mean_score, round(avg(y), 6) AS observed_rate, round(abs(avg(p) - avg(y)), 6) AS gap FROM b GROUP BY 1, 2""")
def g40(spark, d):
    return rr(m.reliability(probabilities(spark, d), ["label"], "y", "p", few_groups=True), ["label", "bin", "rows"], ["mean_score", "observed_rate", "gap"])


# Events as scored rows: truth = error event, score = value, prediction = low value.
SCORED = "sc AS (SELECT event_id, user_id, ts, value AS score, (event_type = 'error')::INT AS y, (value < 20)::INT AS h, strftime(ts, '%d') < '16' AS early, CASE WHEN day(ts) < 16 THEN 'first' ELSE 'second' END AS dataset, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events)"


def scored(spark, d):
    e = events(spark, d)
    return e.select("event_id", "user_id", "ts", F.col("value").alias("score"), (F.col("event_type") == "error").cast("int").alias("y"),
                    (F.col("value") < 20).cast("int").alias("h"), F.when(F.dayofmonth("ts") < 16, "first").otherwise("second").alias("dataset"),
                    F.get_json_object("props", "$.k").cast("double").alias("k"))


@query("G41_score_summary", f"""WITH {SCORED} SELECT dataset, count(score) AS rows, round(min(score), 4) AS min, round(max(score), 4) AS max, round(avg(score), 4) AS mean, round(stddev_pop(score), 4) AS std, count(*) FILTER (score < 0) AS below_zero, round(100.0 * count(*) FILTER (score < 0) / count(*), 6) AS below_zero_pct,
{", ".join(f"round(quantile_cont(score, {q}), 4) AS {n}" for n, q in m.SCORE_QUANTILES.items())} FROM sc GROUP BY 1""")
def g41(spark, d):
    return rr(m.score_summary(scored(spark, d), ["dataset"], "score"), ["dataset", "rows", "below_zero"], ["min", "max", "mean", "std", "below_zero_pct", *m.SCORE_QUANTILES], 4)


@query("G42_score_summary_by_label", f"""WITH {SCORED} SELECT dataset, y, count(score) AS rows, round(avg(score - 30), 4) + 0 AS mean, count(*) FILTER (score < 30) AS below_zero, {", ".join(f"round(quantile_cont(score - 30, {q}), 4) + 0 AS {n}" for n, q in m.SCORE_QUANTILES.items())} FROM sc GROUP BY 1, 2""")
def g42s(spark, d):
    x = scored(spark, d).withColumn("score", F.col("score") - 30)
    return rr(m.score_summary(x, ["dataset", "y"], "score"), ["dataset", "y", "rows", "below_zero"], ["mean", *m.SCORE_QUANTILES], 4)


@query("G42_class_separation", f"""WITH {SCORED} SELECT dataset, round(avg(score) FILTER (y = 0), 6) AS mean_normal, round(avg(score) FILTER (y = 1), 6) AS mean_anomaly,
round(avg(score) FILTER (y = 0) - avg(score) FILTER (y = 1), 6) + 0 AS separation FROM sc GROUP BY 1""")
def g42(spark, d):
    return rr(m.class_separation(scored(spark, d), ["dataset"], "y", "score"), ["dataset"], ["mean_normal", "mean_anomaly", "separation"])


EG = "CASE WHEN y = 1 AND h = 1 THEN 'TP' WHEN y = 1 THEN 'FN' WHEN h = 1 THEN 'FP' ELSE 'TN' END"


@query("G43_error_groups", f"""WITH {SCORED} SELECT dataset, {EG} AS error_group, count(*) AS rows, round(min(score), 6) AS min_score, round(avg(score), 6) AS mean_score, round(max(score), 6) AS max_score,
round(stddev_pop(score), 6) AS std_score, round(quantile_cont(score, 0.5), 6) AS median_score, round(avg(k), 6) AS mean_k FROM sc GROUP BY 1, 2""")
def g43(spark, d):
    return rr(m.error_group_summary(scored(spark, d), ["dataset"], "y", "h", "score", ["k"]), ["dataset", "error_group", "rows"], ["min_score", "mean_score", "max_score", "std_score", "median_score", "mean_k"])


def _diff(f):
    a = lambda c: f"avg({f}) FILTER ({c})"
    return f"""SELECT dataset, '{f}' AS feature, round({a('y = 1')} - {a('y = 0')}, 6) + 0 AS anomaly_minus_normal,
round({a('y = 1 AND h = 1')} - {a('y = 1 AND h = 0')}, 6) + 0 AS tp_minus_fn, round({a('y = 0 AND h = 1')} - {a('y = 0 AND h = 0')}, 6) + 0 AS fp_minus_tn FROM sc GROUP BY 1"""


DIFFS = ["anomaly_minus_normal", "tp_minus_fn", "fp_minus_tn"]


@query("G44_error_features", f"WITH {SCORED} {_diff('score')} UNION ALL {_diff('k')}")
def g44(spark, d):
    return rr(m.error_feature_differences(scored(spark, d), ["dataset"], "y", "h", ["score", "k"]), ["dataset", "feature"], DIFFS)


@query("K05_top_differences", f"""WITH {SCORED}, x AS ({_diff('score')} UNION ALL {_diff('k')}), t AS (UNPIVOT x ON {', '.join(DIFFS)} INTO NAME difference VALUE delta),
k AS (SELECT *, row_number() OVER (PARTITION BY dataset, difference ORDER BY abs(delta) DESC, feature)::INTEGER AS place FROM t) SELECT dataset, feature, difference, delta, place FROM k WHERE place <= 15""")
def k05(spark, d):
    x = rr(m.error_feature_differences(scored(spark, d), ["dataset"], "y", "h", ["score", "k"]), ["dataset", "feature"], DIFFS)
    tall = x.unpivot(["dataset", "feature"], DIFFS, "difference", "delta")
    return top_k(tall, ["dataset", "difference"], [F.desc(F.abs("delta")), F.asc("feature")], 15, "place")


FORE = f"""s AS (SELECT event_id, user_id, ts, value AS forecast, lead(value, 1) {U} AS target_2, lead(value, 5) {U} AS target_10, lead(value, 15) {U} AS target_30,
abs(value - lag(value) {U}) AS ramp FROM events),
tall AS (SELECT 2 AS horizon, event_id, forecast, target_2 AS actual, ramp FROM s UNION ALL SELECT 10, event_id, forecast, target_10, ramp FROM s UNION ALL SELECT 30, event_id, forecast, target_30, ramp FROM s),
f AS (SELECT *, forecast - actual AS e FROM tall WHERE actual IS NOT NULL)"""


def forecasts(spark, d):
    e = events(spark, d).select("user_id", "ts", "event_id", "value")
    t = w.temporal_features(e, by_user(), ["value"], kinds=("abs_diff",))
    t = w.row_leads(t, by_user(), "value", LEADS)
    return t.select("event_id", F.col("value").alias("forecast"), F.col("value__abs_diff").alias("ramp"), F.inline(F.array(*[
        F.struct(F.lit(int(n.split("_")[1])).alias("horizon"), F.col(n).alias("actual")) for n in LEADS]))).filter(F.col("actual").isNotNull())


@query("G45_regression_errors", f"""WITH {FORE} SELECT horizon, count(*) AS rows, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(1 - sum(e * e) / (var_pop(actual) * count(*)), 6) AS r2 FROM f GROUP BY 1""")
def g45(spark, d):
    return rr(m.regression_errors(forecasts(spark, d), ["horizon"], "actual", "forecast"), ["horizon", "rows"], ["mae", "rmse", "r2"])


@query("G46_forecast_accuracy", f"""WITH {FORE}, p AS (SELECT *, abs(e / nullif(actual, 0)) * 100 AS pct FROM f) SELECT horizon, count(*) AS rows, round(avg(abs(e)), 5) AS mae, round(avg(pct), 5) AS mape, round(avg(e), 5) + 0 AS mean_error,
round(max(abs(e)), 5) AS max_abs_error, round(stddev_pop(e), 5) AS std_error, round(100 * avg((abs(e) <= 0.05::DOUBLE * abs(actual))::INT), 5) AS within_5_pct, round(100 * avg((abs(e) <= 0.1::DOUBLE * abs(actual))::INT), 5) AS within_10_pct FROM p GROUP BY 1""")
def g46(spark, d):
    return rr(m.forecast_accuracy(forecasts(spark, d), ["horizon"], "actual", "forecast"), ["horizon", "rows"],
              ["mae", "mape", "mean_error", "max_abs_error", "std_error", "within_5_pct", "within_10_pct"], 5)


BIN = "CASE WHEN ramp <= 2 THEN '0-2 MW' WHEN ramp <= 5 THEN '2-5 MW' WHEN ramp <= 10 THEN '5-10 MW' WHEN ramp <= 20 THEN '10-20 MW' WHEN ramp <= 50 THEN '20-50 MW' WHEN ramp > 50 THEN '>50 MW' END"


@query("G47_ramp_errors", f"WITH {FORE} SELECT horizon, {BIN} AS bin, count(*) AS rows, round(avg(abs(e)), 6) AS mean_error, round(max(abs(e)), 6) AS max_error FROM f GROUP BY 1, 2")
def g47(spark, d):
    f = forecasts(spark, d).withColumn("abs_error", F.abs(F.col("forecast") - F.col("actual")))
    return rr(m.errors_by_bin(f, ["horizon"], m.right_closed_bin(F.col("ramp")), "abs_error"), ["horizon", "bin", "rows"], ["mean_error", "max_error"])


@query("G47_ramp_error_correlation", f"WITH {FORE} SELECT horizon, round(corr(ramp, abs(e)), 6) + 0 AS correlation FROM f GROUP BY 1")
def g47c(spark, d):
    f = forecasts(spark, d).withColumn("abs_error", F.abs(F.col("forecast") - F.col("actual")))
    return rr(pearson_of(f, [("ramp", "abs_error")], ["horizon"]), ["horizon"], ["correlation"])


@query("P15_ramp_bins", f"WITH s AS (SELECT event_id, abs(value - lag(value) {U}) AS ramp FROM events) SELECT event_id, {BIN} AS bin FROM s")
def p15(spark, d):
    e = events(spark, d).select("user_id", "ts", "event_id", "value")
    t = w.temporal_features(e, by_user(), ["value"], kinds=("abs_diff",))
    return t.select("event_id", m.right_closed_bin(F.col("value__abs_diff")).alias("bin"))


@query("K04_top_errors", f"""WITH {FORE}, k AS (SELECT horizon, event_id, round(abs(e), 6) AS abs_error, row_number() OVER (PARTITION BY horizon ORDER BY round(abs(e), 6) DESC, event_id)::INTEGER AS place FROM f) SELECT * FROM k WHERE place <= 20""")
def k04(spark, d):
    f = forecasts(spark, d).select("horizon", "event_id", r(F.abs(F.col("forecast") - F.col("actual"))).alias("abs_error"))
    return top_k(f, ["horizon"], [F.desc("abs_error"), F.asc("event_id")], 20, "place")


@query("G48_fold_summary", """WITH f AS (SELECT l_returnflag AS model, year(l_shipdate) AS fold, avg(abs(l_extendedprice - 1500 * l_quantity)) AS mae, sqrt(avg((l_extendedprice - 1500 * l_quantity) ** 2)) AS rmse FROM lineitem GROUP BY 1, 2)
SELECT model, """ + ", ".join(f"round({fn}({x}), 3) AS {x}_{n}" for x in ("mae", "rmse") for n, fn in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"))) + " FROM f GROUP BY 1")
def g48(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("model"), F.year("l_shipdate").alias("fold"), "l_extendedprice", (1500 * F.col("l_quantity")).alias("guess"))
    folds = m.regression_errors(li, ["model", "fold"], "l_extendedprice", "guess")
    return rr(m.fold_summary(folds, ["model"], ["mae", "rmse"]), ["model"], [f"{x}_{n}" for x in ("mae", "rmse") for n in ("mean", "std", "min")], 3)


@query("G49_candidate_robustness", """WITH s AS (SELECT l_returnflag AS candidate, l_linestatus AS sample, avg(l_discount) AS metric, max(l_linenumber) + CASE l_returnflag WHEN 'A' THEN 3 ELSE 0 END AS size FROM lineitem GROUP BY 1, 2),
p AS (SELECT candidate, avg(metric) AS mean, stddev_pop(metric) AS std, max(metric) - min(metric) AS difference, max(size)::INTEGER AS size, max(metric) FILTER (sample = 'O') AS o FROM s GROUP BY 1)
SELECT candidate, round(o, 9) AS "O", round(o - (SELECT o FROM p WHERE candidate = 'A'), 9) + 0 AS "O_delta", round(mean, 9) AS mean, round(std, 9) AS std, round(difference, 9) AS difference, size, round(mean - (SELECT mean FROM p WHERE candidate = 'A'), 9) + 0 AS mean_delta,
round((1 - size / (SELECT size FROM p WHERE candidate = 'A')) * 100, 6) AS reduction_pct FROM p""")
def g49(spark, d):
    li = table(spark, d, "lineitem")
    s = li.groupBy(F.col("l_returnflag").alias("candidate"), F.col("l_linestatus").alias("sample")).agg(F.avg("l_discount").alias("metric"), F.max("l_linenumber").alias("size"))
    s = s.withColumn("size", F.col("size") + F.when(F.col("candidate") == "A", 3).otherwise(0))
    x = m.candidate_robustness(s, "candidate", "sample", ["O", "F"], "metric", "size", "A")
    return x.select("candidate", "size", *[r(c, 9).alias(c) for c in ("mean", "std", "difference", "mean_delta", "O", "O_delta")], r("reduction_pct").alias("reduction_pct"))
