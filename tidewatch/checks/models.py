from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.checks.common import by_user, events, one_stream, r
from tidewatch.checks.events_labels import LABELS, episodes, multilabel
from tidewatch.checks.metrics import PROB, probabilities, rr
from tidewatch.checks.registry import query
from tidewatch.checks.windows import U
from tidewatch.operators import columns as co, correlate as c, splits as sp, windows as w
from tidewatch.operators.series import Series
from tidewatch.plans import classifier as cl, detector as dt, forecast as fc
from tidewatch.sources.tables import pin, small_table, table

C = F.col
TARGETS = {2: "target_2", 10: "target_10", 30: "target_30"}
FEATS = ["value", "value_lag_1", "value_lag_2", "value_lag_5", "value_lag_10", "hour", "minute", "day_of_week", "day_of_month"]
S = f"s AS (SELECT event_id, value, lag(value, 10) {U} AS warm, lead(value) {U} AS target_2, lead(value, 5) {U} AS target_10, lead(value, 15) {U} AS target_30 FROM events), t AS (SELECT * FROM s WHERE warm IS NOT NULL AND target_30 IS NOT NULL)"


def supervised(spark, d):
    e = events(spark, d).select("user_id", "ts", "event_id", "value")
    x = w.supervised_rows(e, by_user(), "value", [1, 2, 5, 10], {"target_2": 1, "target_10": 5, "target_30": 15})
    return w.calendar(x, "ts")


@query("A01_least_squares", f"WITH {S} " + " UNION ALL ".join(f"SELECT {h} AS horizon, round(regr_slope({t}, value), 6) + 0 AS slope, round(regr_intercept({t}, value), 5) AS intercept FROM t" for h, t in TARGETS.items()))
def a01(spark, d):
    models = fc.fit_horizons(supervised(spark, d), ["value"], TARGETS)
    x = fc.coefficients_table(spark, models)
    g = x.groupBy("horizon").agg(F.max(F.when(C("feature") == "value", C("coefficient"))).alias("slope"), F.max(F.when(C("feature") != "value", C("coefficient"))).alias("intercept"))
    return g.select("horizon", r("slope").alias("slope"), r("intercept", 5).alias("intercept"))


@query("A01_all_features")
def a01_all(spark, d):
    return fc.coefficients_table(spark, fc.fit_horizons(supervised(spark, d), FEATS, TARGETS))


SETS = {"lags": FEATS[:5], "calendar": FEATS}


def _grid(spark, d, names):
    models = {k: v for k, v in fc.regressors().items() if k in names}
    return fc.benchmark(supervised(spark, d), one_stream(), SETS, list(TARGETS.values()), models)


@query("A02_random_forest")
def a02(spark, d):
    return _grid(spark, d, ["RandomForest"])


@query("A03_boosted_trees")
def a03(spark, d):
    return _grid(spark, d, ["GradientBoosting"])


@query("A04_benchmark_grid")
def a04(spark, d):
    return fc.best_per_target(_grid(spark, d, list(fc.regressors())))


@query("A05_leakage_safe_comparison")
def a05(spark, d):
    x = supervised(spark, d).withColumn("net power output", C("target_2") * 0.9 + C("value") * 0.1)
    return fc.leakage_safe_comparison(x, one_stream(), [*FEATS[:5], "net power output"], list(TARGETS.values()), fc.regressors())


PREDS = f"{S}, f AS (" + " UNION ALL ".join(f"SELECT {h} AS horizon, event_id, value, {t} AS target, value * (SELECT regr_slope({t}, value) FROM t) + (SELECT regr_intercept({t}, value) FROM t) AS forecast FROM t" for h, t in TARGETS.items()) + ")"


@query("A06_batch_scoring", f"WITH {PREDS} SELECT event_id, " + ", ".join(f"round(max(forecast) FILTER (horizon = {h}), 5) AS forecast_{h}" for h in TARGETS) + " FROM f GROUP BY 1")
def a06(spark, d):
    x = supervised(spark, d)
    s = fc.score_horizons(x, fc.fit_horizons(x, ["value"], TARGETS))
    return s.select("event_id", *[r(f"forecast_{h}", 5).alias(f"forecast_{h}") for h in TARGETS])


@query("A06_row_and_horizon_errors", f"WITH {PREDS}, g AS (SELECT 'horizon' AS align, horizon, forecast, target AS actual FROM f UNION ALL SELECT 'row', horizon, forecast, value FROM f) SELECT align, horizon, count(*) AS rows, round(avg(abs(forecast - actual)), 5) AS mae, round(sqrt(avg((forecast - actual) ** 2)), 5) AS rmse FROM g GROUP BY 1, 2")
def a06e(spark, d):
    from tidewatch.operators.metrics import regression_errors

    x = supervised(spark, d)
    s = fc.score_horizons(x, fc.fit_horizons(x, ["value"], TARGETS))
    both = [fc.forecast_errors(s, TARGETS, "value", a).withColumn("align", F.lit(a)) for a in ("horizon", "row")]
    e = regression_errors(both[0].unionByName(both[1]), ["align", "horizon"], "actual", "forecast")
    return rr(e, ["align", "horizon", "rows"], ["mae", "rmse"], 5)


@query("A04_temporal_robustness")
def a04_folds(spark, d):
    from tidewatch.operators.metrics import fold_summary

    f = fc.temporal_robustness(supervised(spark, d), one_stream(), FEATS, TARGETS)
    return fold_summary(f, ["horizon"], ["mae", "rmse", "r2"])


FOLD_SQL = f"""WITH {S.replace("t AS (SELECT * FROM s", "t AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos, count(*) OVER () AS n FROM s").replace("SELECT event_id, value, lag", "SELECT event_id, ts, value, lag", 1)},
fo AS (SELECT * FROM (VALUES (1, 0.6, 0.8), (2, 0.7, 0.9), (3, 0.8, 1.0)) q(fold, a, b)),
h AS (SELECT 2 AS horizon, pos, n, value, target_2 AS y FROM t UNION ALL SELECT 10, pos, n, value, target_10 FROM t UNION ALL SELECT 30, pos, n, value, target_30 FROM t),
co AS (SELECT fold, horizon, regr_slope(y, value) AS m, regr_intercept(y, value) AS c FROM h, fo WHERE pos < floor(n * a::DOUBLE) GROUP BY 1, 2),
er AS (SELECT fold, horizon, m * value + c - y AS e FROM h JOIN co USING (horizon) JOIN fo USING (fold) WHERE pos >= floor(n * a::DOUBLE) AND pos < floor(n * b::DOUBLE))
SELECT fold, horizon, count(*) AS rows, round(avg(abs(e)), 5) AS mae, round(sqrt(avg(e * e)), 5) AS rmse FROM er GROUP BY 1, 2"""


@query("A04_fold_errors", FOLD_SQL)
def a04_fold_errors(spark, d):
    return rr(fc.temporal_robustness(supervised(spark, d), one_stream(), ["value"], TARGETS), ["fold", "horizon", "rows"], ["mae", "rmse"], 5)


# ---- detector -------------------------------------------------------------------------------------

KINDS = ["value", "value__diff", "value__abs_diff", "value__std"]


def _temporal(spark, d):
    e = events(spark, d).select("user_id", "ts", "event_id", "value", (C("event_type") == "error").cast("int").alias("label"))
    x = w.temporal_features(e, by_user(), ["value"], 72 * 3600, kinds=("diff", "abs_diff", "std"))
    return x.select("event_id", "ts", "label", *KINDS)


def _split(x):
    """Days 1 to 15 train, 16 to 21 and the rest test. The features are stored once."""
    day = F.dayofmonth("ts")
    return pin(x.withColumn("sample", F.when(day < 16, "train").when(day < 22, "test1").otherwise("test2")))


def _samples(spark, d):
    x = _split(_temporal(spark, d))
    return x.filter("sample = 'train'"), {n: x.filter(C("sample") == n) for n in ("test1", "test2")}


@query("A07_forest_fit")
def a07(spark, d):
    train, _ = _samples(spark, d)
    forest = dt.fit_forest(train, KINDS, ["event_id"])
    return forest.predict(train).groupBy("status").agg(F.count(F.lit(1)).alias("rows"))


@query("A08_forest_scores")
def a08(spark, d):
    train, tests = _samples(spark, d)
    forest, both = dt.fit_forest(train, KINDS, ["event_id"]), None
    for name, rows in tests.items():
        one = forest.predict(rows).select(F.lit(name).alias("sample"), "event_id", "decision_score", "anomaly_score", "prediction", "status")
        both = one if both is None else both.unionByName(one)
    return both


@query("A09_family_ablation")
def a09(spark, d):
    subsets = {"original": KINDS[:1], "plus_diff": KINDS[:2], "plus_abs_diff": [KINDS[0], KINDS[2]], "plus_std": [KINDS[0], KINDS[3]], "all": KINDS}
    return dt.compare_subsets(_split(_temporal(spark, d)), "sample", "train", subsets, ["event_id"], "label")


DERIVED = ("diff", "abs_diff", "std")


def _two_signals(spark, d):
    e = events(spark, d).select("user_id", "ts", "event_id", "value", F.get_json_object("props", "$.k").cast("double").alias("k"), (C("event_type") == "error").cast("int").alias("label"))
    return w.temporal_features(e, by_user(), ["value", "k"], kinds=DERIVED)


def _associations(x):
    """Families of derived features: association of each feature with a score."""
    a = c.score_association(x, co.matching(x, suffixes=("__diff", "__abs_diff", "__std")), "value")
    fam = F.regexp_extract("feature", r"__(.*)$", 1)
    return a.select("feature", fam.alias("family"), r(F.abs("spearman_r"), 9).alias("abs_spearman_r"), r(F.abs("pearson_r"), 9).alias("abs_pearson_r"))


def _candidates(spark, x, recipe):
    originals = small_table(spark, [("value",), ("k",)], "feature STRING")
    return dt.reduced_candidates(_associations(x), originals, "family", ["abs_spearman_r", "abs_pearson_r"], list(DERIVED), recipe)


@query("A19_reduced_candidates")
def a19(spark, d):
    return _candidates(spark, _two_signals(spark, d), dt.CANDIDATES)


@query("A10_candidate_evaluation")
def a10(spark, d):
    """The manifests of A19 and the originals alone. The events have few signals, so a tenth of the usual
    number of features per family is taken."""
    x = _split(_two_signals(spark, d))
    subsets = {"original": ["value", "k"]}
    # one row per candidate and feature
    for m in _candidates(spark, x, {n: tuple(k // 10 for k in v) for n, v in dt.CANDIDATES.items()}).orderBy("candidate", "feature").collect():
        subsets.setdefault(m.candidate, []).append(m.feature)
    return dt.compare_subsets(x, "sample", "train", subsets, ["event_id"], "label")


# ---- classifier ----------------------------------------------------------------------------------


@query("A11_standardised", "WITH m AS (SELECT avg(value) AS a, stddev_pop(value) AS s FROM events) SELECT event_id, round((value - a) / s, 6) + 0 AS value FROM events, m")
def a11(spark, d):
    e = events(spark, d).select("event_id", "value")
    return cl.scale(e, cl.scaling(e, ["value"])).select("event_id", r("value").alias("value"))


def _labelled(spark, d):
    x = multilabel(spark, d).select("event_id", "user_id", "ts", "value", C("k").cast("double").alias("k"), F.hour("ts").alias("hour"), *LABELS, "split")
    feats = ["value", "k", "hour"]
    train = x.filter("split = 'train'")
    params = cl.scaling(train, feats)
    return cl.vectors(cl.scale(x, params), feats)


def _classified(spark, d, balanced):
    x = _labelled(spark, d)
    models = cl.fit_labels(x.filter("split = 'train'"), LABELS, balanced, iterations=1000)
    return cl.score_labels(x.filter("split <> 'train'"), models, ["event_id", "split"], LABELS)


@query("A12_balanced_classifiers")
def a12(spark, d):
    return _classified(spark, d, True)


@query("A13_unweighted_classifiers")
def a13(spark, d):
    return _classified(spark, d, False)


def _calibrated(spark, d):
    p = probabilities(spark, d)
    return cl.Calibrators(p, ["quality", "toxic"]).apply(p)


# Newton steps from zero; the penalty is half the squared slope.
NEWTON = f"""{PROB}, fold AS (SELECT label, p, sum(y) AS s, count(*) AS n FROM prob GROUP BY 1, 2),
nt(it, label, a, b) AS (SELECT 0, label, 0::DOUBLE, 0::DOUBLE FROM (SELECT DISTINCT label FROM fold) UNION ALL
SELECT it + 1, label, a - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) FROM (
SELECT it, label, a, b, sum(n * q - s) AS g0, sum((n * q - s) * p) + b AS g1, sum(n * q * (1 - q)) AS h00, sum(n * q * (1 - q) * p) AS h01, sum(n * q * (1 - q) * p * p) + 1 AS h11
FROM (SELECT it, label, a, b, p, s, n, 1 / (1 + exp(-(a + b * p))) AS q FROM nt JOIN fold USING (label) WHERE it < 30) GROUP BY it, label, a, b)),
sig AS (SELECT row_id, label, y, p, least(greatest(1 / (1 + exp(-(a + b * p))), 1e-7), 1 - 1e-7) AS sigmoid FROM prob JOIN nt USING (label) WHERE it = 30)"""


@query("A14_sigmoid_calibration", f"WITH RECURSIVE {NEWTON} SELECT row_id, label, round(p, 6) AS p, round(sigmoid, 6) AS sigmoid FROM sig")
def a14(spark, d):
    return _calibrated(spark, d).select("row_id", "label", r("p").alias("p"), r("sigmoid").alias("sigmoid"))


# Isotonic fit in closed form: the largest over starts i <= k of the least mean of i..j over j >= k.
ISO = f"""WITH {PROB}, g AS (SELECT label, p, sum(y) AS s, count(*) AS n FROM prob GROUP BY 1, 2), o AS (SELECT *, row_number() OVER w AS k, sum(s) OVER w AS cs, sum(n) OVER w AS cn FROM g WINDOW w AS (PARTITION BY label ORDER BY p)),
pr AS (SELECT a.label, a.k AS i, b.k AS j, (b.cs - a.cs + a.s) / (b.cn - a.cn + a.n) AS m FROM o a JOIN o b ON a.label = b.label AND b.k >= a.k),
mn AS (SELECT label, i, j AS k, min(m) OVER (PARTITION BY label, i ORDER BY j DESC) AS lo FROM pr), ft AS (SELECT label, k, max(lo) AS v FROM mn GROUP BY 1, 2)
SELECT row_id, prob.label, round(prob.p, 6) AS p, round(least(greatest(v, 1e-7), 1 - 1e-7), 6) AS isotonic FROM prob JOIN o ON prob.label = o.label AND prob.p = o.p JOIN ft ON ft.label = o.label AND ft.k = o.k"""


@query("A15_isotonic_calibration", ISO)
def a15(spark, d):
    return _calibrated(spark, d).select("row_id", "label", r("p").alias("p"), r("isotonic").alias("isotonic"))


CHOSEN = f"""WITH RECURSIVE {NEWTON}, iso AS ({ISO.replace(PROB + ", ", "").replace("round(prob.p, 6) AS p, round(least(greatest(v, 1e-7), 1 - 1e-7), 6)", "least(greatest(v, 1e-7), 1 - 1e-7)")}),
tall AS (SELECT row_id, label, y, 'sigmoid' AS method, sigmoid AS q FROM sig UNION ALL SELECT row_id, label, y, 'isotonic', isotonic FROM iso JOIN prob USING (row_id, label)),
loss AS (SELECT label, method, avg((q - y) ** 2) AS brier, avg(-(y * ln(q) + (1 - y) * ln(1 - q))) AS log_loss FROM tall GROUP BY 1, 2),
best AS (SELECT label, method FROM loss QUALIFY row_number() OVER (PARTITION BY label ORDER BY brier, log_loss, method) = 1)
SELECT row_id, label, y, round(q, 6) AS calibrated FROM tall JOIN best USING (label, method)"""


@query("A16_calibrated_table", CHOSEN)
def a16(spark, d):
    x = _calibrated(spark, d)
    return cl.calibrated_table(x, cl.choose_method(cl.calibration_metrics(x))).select("row_id", "label", "y", r("calibrated").alias("calibrated"))


@query("A17_positional_validation")
def a17(spark, d):
    p = sp.positional_split(probabilities(spark, d), Series(["label"], ["row_id"], cell=F.floor(C("row_id") / 65536)), 0.6, ("fit", "validation"))
    return cl.validate_calibration(p, "split", ["quality", "toxic"])


@query("A17_episode_validation")
def a17e(spark, d):
    e = events(spark, d).select("event_id", "value", (C("event_type") == "error").cast("int").alias("y"))
    s = sp.half_guard_split(episodes(spark, d), one_stream(), "ts", "scenario", C("scenario").isNotNull()).select("event_id", "split")
    x = e.join(s, "event_id").select("event_id", "split", F.lit("error").alias("label"), "y", (C("value") / (C("value") + 20)).alias("p"))
    return cl.validate_calibration(x, "split", ["error"])


@query("A17_final_validation")
def a17f(spark, d):
    return cl.final_validation(_classified(spark, d, True), "split", LABELS)


# ---- the published scoring case: 119 features, three linear models -----------------------------------

WIDE = 56  # lags of two tags: 2 x 57 columns, 4 calendar features and a constant make 119


def wide_rows(spark, d):
    e = events(spark, d).select("user_id", "ts", "event_id", "value", F.get_json_object("props", "$.k").cast("double").alias("k"))
    x = w.calendar(w.row_lags(e, by_user(), ["value", "k"], range(1, WIDE + 1)), "ts").withColumn("one", F.lit(1.0))
    feats = ["value", "k", *[f"{c}_lag_{i}" for c in ("value", "k") for i in range(1, WIDE + 1)], "hour", "minute", "day_of_week", "day_of_month", "one"]
    return x.fillna(0.0, feats), feats


def wide_models(feats):
    return {h: fc.LinearModel(tuple(feats), tuple([1.0 / h] * len(feats)), float(h)) for h in (2, 10, 30)}


WIDE_U = f"OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN {WIDE} PRECEDING AND CURRENT ROW)"


@query("A06_scoring_119_features", f"""WITH x AS (SELECT event_id, sum(value) {WIDE_U} + sum(CAST(json_extract(props, '$.k') AS DOUBLE)) {WIDE_U} + hour(ts) + minute(ts) + isodow(ts) - 1 + day(ts) + 1 AS s FROM events)
SELECT event_id, {", ".join(f"round(s / {h} + {h}, 4) AS forecast_{h}" for h in (2, 10, 30))} FROM x""")
def a06_wide(spark, d):
    x, feats = wide_rows(spark, d)
    return fc.score_horizons(x, wide_models(feats)).select("event_id", *[r(f"forecast_{h}", 4).alias(f"forecast_{h}") for h in (2, 10, 30)])

