"""A hot series cut into chunks gives the same rows as one window over the whole series."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import metrics, topk, windows as w
from tidewatch.operators.quantiles import value_cell
from tidewatch.operators.series import CHUNK, Series


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(7)
    n = 900
    key = np.where(rng.random(n) < 0.5, 0, rng.integers(1, 8, n))
    # bursts: half of the rows fall into two hours, the rest is spread over ten days
    sec = np.where(rng.random(n) < 0.5, rng.integers(0, 7200, n), rng.integers(0, 864000, n))
    pdf = pd.DataFrame({
        "k": key, "id": np.arange(n), "ts": pd.Timestamp("2024-03-01") + pd.to_timedelta(sec, unit="s"),
        "v": np.round(rng.normal(50, 20, n), 2), "hit": rng.integers(0, 4, n) > 0,
    })
    return spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz")).cache()


def plain(**kw):
    return Series(["k"], ["ts", "id"], target_rows=1 << 40, **kw)


def hot(target, **kw):
    return Series(["k"], ["ts", "id"], target_rows=target, **kw)


def same(a, b, keys=("id",)):
    x = a.toPandas().sort_values(list(keys)).reset_index(drop=True)
    y = b.toPandas().sort_values(list(keys)).reset_index(drop=True)[x.columns]
    pd.testing.assert_frame_equal(x, y, check_dtype=False)


OPERATORS = {
    "lags": lambda d, s: w.row_lags(d, s, ["v"], [1, 2, 5, 10]),
    "leads": lambda d, s: w.row_leads(d, s, "v", {"a": 1, "b": 15}),
    "supervised": lambda d, s: w.supervised_rows(d, s, "v", [1, 10], {"t": 15}),
    "features": lambda d, s: w.temporal_features(d, s, ["v"], 3600),
    "features_no_gap": lambda d, s: w.temporal_features(d, s, ["v"]),
    "sequences": lambda d, s: w.sequence_ids(d, s, 1800),
    "exact_sequences": lambda d, s: w.sequence_ids(d, s, 60, exact=True),
    "intervals": lambda d, s: w.intervals(d, s),
    "streaks": lambda d, s: w.streaks(d, s, F.col("hit")),
    "positions": lambda d, s: w.positions(d, s, "p", "n"),
    "readiness": lambda d, s: w.readiness(d, s, 60.0, ["v"], ["v"]),
}


@pytest.mark.parametrize("name", OPERATORS)
@pytest.mark.parametrize("target", [3, 40])
def test_chunks_equal_whole_series(rows, name, target):
    op = OPERATORS[name]
    same(op(rows, hot(target)), op(rows, plain()))


def test_islands_and_single_series(rows):
    label = rows.withColumn("label", F.col("hit").cast("int"))
    same(w.islands(label, hot(25), "label"), w.islands(label, plain(), "label"), ("k", "segment"))
    whole, cut = Series([], ["ts", "id"]), Series([], ["ts", "id"], target_rows=30)
    same(w.positions(rows, cut, "p"), w.positions(rows, whole, "p"))
    same(w.streaks(rows, cut, F.col("hit")), w.streaks(rows, whole, F.col("hit")))
    same(topk.evenly_spaced(rows, cut, 100), topk.evenly_spaced(rows, whole, 100))


def test_hot_series_is_really_cut(rows):
    chunks = hot(40).frame(rows, before=2).df.filter(F.col("k") == 0).select(CHUNK).distinct().count()
    assert chunks > 3


def test_measured_series_is_reused(rows):
    s = hot(40).measured(rows)
    same(w.streaks(w.row_lags(rows, s, ["v"], [3]), s, F.col("hit")), w.streaks(w.row_lags(rows, plain(), ["v"], [3]), plain(), F.col("hit")))


def test_order_by_value_is_cut_too(rows):
    cut = Series(["k"], ["v", "id"], cell=value_cell(F.col("v"), 8), target_rows=20)
    whole = Series(["k"], ["v", "id"], cell=value_cell(F.col("v")))
    same(w.positions(rows, cut, "p"), w.positions(rows, whole, "p"))


def test_ranking_with_hot_label(rows, monkeypatch):
    df = rows.select(F.lit("a").alias("label"), F.col("hit").cast("int").alias("y"), F.col("v").alias("p"))
    want = metrics.ranking(df, ["label"], "y", "p").first()
    import tidewatch.operators.series as series

    init = series.Series.__init__
    monkeypatch.setattr(series.Series, "__init__", lambda self, *a, **k: init(self, *a, **{**k, "target_rows": 9}))
    got = metrics.ranking(df, ["label"], "y", "p").first()
    assert got.roc_auc == pytest.approx(want.roc_auc) and got.average_precision == pytest.approx(want.average_precision)


def test_no_look_ahead(rows):
    """Row t keeps its features when later rows are removed."""
    cut = rows.filter(F.col("ts") < F.lit("2024-03-04").cast("timestamp_ntz"))
    full = w.temporal_features(rows, plain(), ["v"], 3600).filter(F.col("ts") < F.lit("2024-03-04").cast("timestamp_ntz"))
    same(w.temporal_features(cut, plain(), ["v"], 3600), full)


@pytest.mark.parametrize("target", [20, 70])
def test_one_second_holds_a_whole_series(rows, target):
    """All rows of a series in one cell: the cell itself is cut, by the order key."""
    burst = rows.withColumn("ts", F.when(F.col("k") == 0, F.lit("2024-03-01 00:00:00").cast("timestamp_ntz")).otherwise(F.col("ts")))
    cut = Series(["k"], ["ts", "id"], target_rows=target)
    sizes = [r["count"] for r in cut.frame(burst).df.filter(F.col("k") == 0).groupBy(CHUNK).count().collect()]
    assert len(sizes) > 3 and max(sizes) <= 3 * target
    same(w.positions(burst, cut, "p"), w.positions(burst, plain(), "p"))
    same(w.streaks(burst, cut, F.col("hit")), w.streaks(burst, plain(), F.col("hit")))
    same(w.row_lags(burst, cut, ["v"], [1, 5]), w.row_lags(burst, plain(), ["v"], [1, 5]))


def test_equal_order_values_in_one_cell(rows):
    flat = rows.withColumn("v", F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.lit(1.0)))
    cut = Series([], ["v", "id"], cell=value_cell(F.coalesce(F.col("v"), F.lit(0.0)), 8), target_rows=50)
    same(w.positions(flat, cut, "p"), w.positions(flat, Series([], ["v", "id"], cell=F.lit(0)), "p"))
