"""Multi-label classifier: scaling, one-vs-rest fits, calibration and its honest validation."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import metrics
from tidewatch.operators.topk import top_k
from tidewatch.plans import logistic as lg
from tidewatch.plans import pooling as po
from tidewatch.sources.tables import pin

EPS = 1e-7


def scaling(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column (one pass); a constant column keeps scale 1."""
    row = df.agg(*[f(c).alias(f"{n}_{i}") for i, c in enumerate(cols) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return {c: (float(row[f"m_{i}"]), float(row[f"s_{i}"]) or 1.0) for i, c in enumerate(cols)}


def scale(df: DataFrame, params: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in params.items()})


def vectors(df: DataFrame, cols: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=cols, outputCol="_x").transform(df)


def fit_labels(df: DataFrame, labels: list[str], balanced: bool, iterations: int = 100, c: float = 1.0, tolerance: float = 1e-8) -> lg.Logistic:
    """A logistic regression of each label on `_x`, all in the same passes (see `logistic.fit`).

    `balanced` weighs both classes equally, `c` is the inverse strength on the summed loss. Labels with one class are left out.
    """
    return lg.fit(df, "_x", labels, balanced, iterations, c, tolerance)


def score_labels(df: DataFrame, models: lg.Logistic, ids: list[str], truth: list[str]) -> DataFrame:
    """Tall (ids, label, y, p): every metric is then a group by label."""
    found = df.withColumn("_p", models.probabilities(F.col("_x")))
    items = [F.struct(F.lit(x).alias("label"), F.col(x).cast("int").alias("y"), F.col("_p")[i].alias("p")) for i, x in enumerate(models.labels)]
    return found.select(*ids, F.inline(F.array(*items)))


def clip(p: Column) -> Column:
    # least and greatest skip nulls, so a missing probability is kept missing here
    return F.when(p.isNotNull(), F.least(F.greatest(p, F.lit(EPS)), F.lit(1 - EPS)))


class Calibrators:
    """Sigmoid and isotonic calibration of all labels, fitted on (label, score) sums in the same passes."""

    def __init__(self, fit_rows: DataFrame, labels: list[str]):
        known = fit_rows.filter(F.col("label").isin(labels) & F.col("p").isNotNull() & F.col("y").isNotNull())
        folded = pin(known.groupBy("label", "p").agg(F.sum(F.col("y").cast("double")).alias("total"), F.count(F.lit(1)).cast("double").alias("weight")))
        counts = {r["label"]: (r["pos"], r["n"]) for r in folded.groupBy("label").agg(F.sum("total").alias("pos"), F.sum("weight").alias("n")).collect()}
        self.labels = [x for x in labels if x in counts and 0 < counts[x][0] < counts[x][1]]
        both = folded.filter(F.col("label").isin(self.labels))
        self.sigmoid = po.sigmoids(both, self.labels) if self.labels else {}
        self.isotonic = {}
        if self.labels:
            blocks = po.isotonic_blocks(both).orderBy("label", "low").toPandas()
            for x, part in blocks.groupby("label"):
                self.isotonic[x] = (part[["low", "high"]].to_numpy().ravel(), np.repeat((part["total"] / part["weight"]).to_numpy(), 2))

    def sigmoid_column(self, p: str = "p") -> Column:
        out = F.lit(None).cast("double")
        for x, (a, b) in self.sigmoid.items():
            z = F.lit(a) + F.lit(b) * F.col(p)
            out = F.when(F.col("label") == x, clip(1 / (1 + F.exp(-z)))).otherwise(out)
        return out

    def apply(self, df: DataFrame) -> DataFrame:
        """Columns `sigmoid` and `isotonic` next to the raw score; null where no calibrator is.
        One pass for all labels: isotonic steps are interpolated per Arrow batch."""
        steps = self.isotonic

        @F.pandas_udf("double")
        def isotonic(label: pd.Series, p: pd.Series) -> pd.Series:
            out = pd.Series(np.nan, index=p.index)
            for x, at in label.groupby(label).groups.items():
                if x in steps:
                    out.loc[at] = np.interp(p.loc[at], *steps[x])
            return out

        raw = F.nanvl(isotonic(F.col("label"), F.col("p")), F.lit(None).cast("double"))
        return df.withColumns({"sigmoid": self.sigmoid_column(), "_iso": raw}).withColumn("isotonic", clip(F.col("_iso"))).drop("_iso")


def calibration_metrics(df: DataFrame, group: list[str] = ("label",)) -> DataFrame:
    """Brier, log loss, AUC and average precision per label and method (raw, sigmoid, isotonic)."""
    group = list(group)
    methods = F.array(*[F.struct(F.lit(n).alias("method"), F.col(c).alias("q")) for n, c in (("raw", "p"), ("sigmoid", "sigmoid"), ("isotonic", "isotonic"))])
    tall = df.select(*group, "y", F.inline(methods)).filter(F.col("q").isNotNull())
    on = [*group, "method"]
    return metrics.probability_losses(tall, on, "y", "q").join(metrics.ranking(tall, on, "y", "q").drop("positives", "negatives"), on)


def choose_method(table: DataFrame) -> DataFrame:
    """Best calibrator per label by Brier score, then log loss."""
    return top_k(table.filter(F.col("method") != "raw"), ["label"], [F.asc("brier"), F.asc("log_loss"), F.asc("method")], 1).select("label", F.col("method").alias("chosen"))


def calibrated_table(df: DataFrame, chosen: DataFrame) -> DataFrame:
    """Calibrated probability by the label's chosen method, null without a calibrator.
    `chosen` holds one row per label."""
    out = df.join(F.broadcast(chosen), "label", "left")
    return out.withColumn("calibrated", F.when(F.col("chosen") == "sigmoid", F.col("sigmoid")).when(F.col("chosen") == "isotonic", F.col("isotonic"))).drop("chosen")


def validate_calibration(df: DataFrame, split: str, labels: list[str], fit="fit", test="validation") -> DataFrame:
    """Calibrators fitted on one part of the rows and measured on another."""
    cal = Calibrators(df.filter(F.col(split) == fit), labels)
    return calibration_metrics(cal.apply(df.filter(F.col(split) == test)))


def final_validation(df: DataFrame, split: str, labels: list[str], fit="validation", test="test") -> DataFrame:
    """Raw, sigmoid and isotonic scores of the rows that neither the classifier nor a calibrator has seen, with their class counts.

    Scores are clipped before calibrators are fitted and applied; labels without a calibrator are measured by their raw scores only.
    """
    rows = pin(df.withColumn("p", clip(F.col("p"))))
    seen, unseen = rows.filter(F.col(split) == fit), rows.filter(F.col(split) == test)
    counts = unseen.groupBy("label").agg(F.sum("y").cast("long").alias("positives"), F.sum(1 - F.col("y")).cast("long").alias("negatives"))
    return calibration_metrics(Calibrators(seen, labels).apply(unseen)).join(counts, "label")
