"""Forecasting: fit per horizon, batch scoring, benchmark grid and temporal folds."""
from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import metrics
from tidewatch.operators.columns import leaking
from tidewatch.operators.series import Series
from tidewatch.operators.splits import FOLDS, Cuts
from tidewatch.operators.topk import top_k
from tidewatch.plans import trees as tr
from tidewatch.sources.tables import pin, small_table


@dataclass(frozen=True)
class LinearModel:
    """Coefficients of one horizon: small, so scoring is a column expression."""

    features: tuple[str, ...]
    coefficients: tuple[float, ...]
    intercept: float

    def column(self):
        terms = [F.col(f).cast("double") * F.lit(float(c)) for f, c in zip(self.features, self.coefficients)]
        return reduce(lambda a, b: a + b, terms, F.lit(float(self.intercept)))


def _assemble(df: DataFrame, features: list[str], target: str) -> DataFrame:
    rows = df.select(*[F.col(f).cast("double").alias(f) for f in features], F.col(target).cast("double").alias("label")).dropna()
    return VectorAssembler(inputCols=features, outputCol="features").transform(rows).select("features", "label")


def fit_linear(df: DataFrame, features: list[str], target: str) -> LinearModel:
    """Ordinary least squares by the normal equations: one pass, one F x F matrix."""
    m = LinearRegression(solver="normal", regParam=0.0, standardization=False).fit(_assemble(df, features, target))
    return LinearModel(tuple(features), tuple(float(x) for x in m.coefficients), float(m.intercept))


def fit_horizons(df: DataFrame, features: list[str], targets: dict[int, str]) -> dict[int, LinearModel]:
    rows = df.select(*dict.fromkeys([*features, *targets.values()])).persist()
    models = {h: fit_linear(rows, features, t) for h, t in targets.items()}
    rows.unpersist()
    return models


def coefficients_table(spark, models: dict[int, LinearModel]) -> DataFrame:
    rows = [(h, f, c) for h, m in models.items() for f, c in [*zip(m.features, m.coefficients), ("(intercept)", m.intercept)]]
    return small_table(spark, rows, "horizon INT, feature STRING, coefficient DOUBLE")


def score_horizons(df: DataFrame, models: dict[int, LinearModel], prefix: str = "forecast_") -> DataFrame:
    """All horizons in one projection."""
    return df.withColumns({f"{prefix}{h}": m.column() for h, m in models.items()})


def forecast_errors(scored: DataFrame, horizons: dict[int, str], actual_row: str, align: str = "horizon", prefix: str = "forecast_") -> DataFrame:
    """Tall (horizon, actual, forecast). `horizon` pairs a forecast with the value it predicts;
    `row` pairs it with the value of its own row, as replay figures do."""
    items = [F.struct(F.lit(h).alias("horizon"), F.col(t if align == "horizon" else actual_row).alias("actual"), F.col(f"{prefix}{h}").alias("forecast")) for h, t in horizons.items()]
    return scored.select(F.inline(F.array(*items))).filter(F.col("actual").isNotNull() & F.col("forecast").isNotNull())


# fixed values: trees, iterations, rate and leaves of the benchmarked models
def regressors(trees: int = 200, iterations: int = 300, seed: int = 42) -> dict[str, object]:
    return {
        "LinearRegression": LinearRegression(solver="normal", regParam=0.0),
        "RandomForest": tr.Forest(trees=trees, seed=seed),
        "GradientBoosting": tr.Boosting(iterations=iterations, rate=0.05, leaves=31),
    }


def benchmark(df: DataFrame, series: Series, feature_sets: dict[str, list[str]], targets: list[str], models: dict[str, object], fraction: float = 0.8) -> DataFrame:
    """Error metrics of every feature set, target and model on a chronological hold-out.

    All models learn from all rows before the cut, tree models in one job, and are measured on all rows after it.
    """
    cuts, out = Cuts(df, series, [fraction]), None
    columns = list(dict.fromkeys([c for feats in feature_sets.values() for c in feats] + targets))
    train, test = df.filter(cuts.before(fraction)), df.filter(~cuts.before(fraction))
    grown = {(s, t, m): (feats, t, spec) for s, feats in feature_sets.items() for t in targets for m, spec in models.items() if isinstance(spec, (tr.Forest, tr.Boosting))}
    if grown:
        test = pin(test.select(*columns))
    predicted = tr.predictions(train, test, columns, grown) if grown else {}
    for set_name, feats in feature_sets.items():
        for target in targets:
            for name, est in models.items():
                if (set_name, target, name) in predicted:
                    scored = predicted[set_name, target, name]
                else:
                    scored = est.fit(_assemble(train, feats, target)).transform(_assemble(test, feats, target))
                m = metrics.regression_errors(scored, [], "label", "prediction")
                one = m.select(F.lit(set_name).alias("feature_set"), F.lit(target).alias("target"), F.lit(name).alias("model"), "rows", "mae", "rmse", "r2")
                out = one if out is None else out.unionByName(one)
    return out


def best_per_target(bench: DataFrame) -> DataFrame:
    return top_k(bench, ["target"], [F.asc("rmse"), F.asc("mae"), F.asc("model"), F.asc("feature_set")], 1)


def leakage_safe_comparison(df: DataFrame, series: Series, features: list[str], targets: list[str], models: dict[str, object]) -> DataFrame:
    """Benchmark with and without the columns whose names leak, side by side."""
    safe = [f for f in features if f not in leaking(features)]
    both = benchmark(df, series, {"all": features, "safe": safe}, targets, models)
    a = both.filter("feature_set = 'all'").select("target", "model", F.col("rmse").alias("rmse_all"), F.col("r2").alias("r2_all"))
    b = both.filter("feature_set = 'safe'").select("target", "model", F.col("rmse").alias("rmse_safe"), F.col("r2").alias("r2_safe"))
    return a.join(b, ["target", "model"]).withColumn("rmse_change", F.col("rmse_safe") - F.col("rmse_all"))


def temporal_robustness(df: DataFrame, series: Series, features: list[str], targets: dict[int, str]) -> DataFrame:
    """Linear model per expanding fold and horizon: metrics per fold."""
    cuts, out = Cuts(df, series, sorted({f for fold in FOLDS for f in fold})), None
    for i, (a, b) in enumerate(FOLDS, 1):
        models = fit_horizons(df.filter(cuts.before(a)), features, targets)
        tall = forecast_errors(score_horizons(df.filter(cuts.between(a, b)), models), targets, "value")
        one = metrics.regression_errors(tall, ["horizon"], "actual", "forecast").withColumn("fold", F.lit(i))
        out = one if out is None else out.unionByName(one)
    return out
