from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import names as n, rules as ru, times as tm
from tidewatch.operators import joins as j, splits as sp, windows as w
from tidewatch.operators.series import Series


def series(spark, seconds, values=None):
    rows = [(i, datetime(2024, 1, 1) + timedelta(seconds=s), float(v)) for i, (s, v) in enumerate(zip(seconds, values or range(len(seconds))))]
    return spark.createDataFrame(rows, "id LONG, ts TIMESTAMP_NTZ, v DOUBLE")


S = Series([], ["ts", "id"])


def test_warm_up_nulls(spark):
    t = w.temporal_features(series(spark, range(12)), S, ["v"], 1.0).orderBy("id").toPandas()
    assert t["v__diff"].isna().tolist() == [True] + [False] * 11
    assert t["v__std"].isna().tolist() == [True] * 4 + [False] * 8


def test_gap_rules(spark):
    gap = series(spark, [0, 1, 2, 7, 8])
    ids = lambda d, exact: [r.sequence_id for r in w.sequence_ids(d, S, 1.0, exact).orderBy("id").collect()]
    assert ids(gap, False) == [0, 0, 0, 1, 1] and ids(gap, True) == [1, 1, 1, 2, 2]
    short = series(spark, [0, 1, 1.5, 2.5])
    assert ids(short, False) == [0, 0, 0, 0] and ids(short, True) == [1, 1, 2, 2]


def test_yearless_date_is_a_monday_in_1900(spark):
    r = spark.createDataFrame([("03/05 10:02:00",)], "s STRING").select(tm.yearless(F.col("s")).alias("t"))
    got = w.calendar(r, "t").first()
    assert got.t.year == 1900 and got.day_of_week == 0


@pytest.mark.parametrize("state,streak,level", [("NORMAL", 3, "LEVEL_3"), ("normal", 0, "LEVEL_1"), ("ANOMALY", 2, "LEVEL_2"), ("UNAVAILABLE", 0, "LEVEL_2"), ("INSUFFICIENT_HISTORY", 5, "LEVEL_3")])
def test_decision_levels(spark, state, streak, level):
    df = spark.createDataFrame([(state, streak)], "s STRING, n INT")
    assert df.select(ru.decision_level(F.col("s"), F.col("n")).alias("l")).first().l == level


def test_unknown_state_is_an_error(spark):
    df = spark.createDataFrame([("ODD", 0)], "s STRING, n INT")
    with pytest.raises(Exception, match="unknown anomaly state"):
        df.select(ru.decision_level(F.col("s"), F.col("n"))).collect()


def test_episode_splits(spark):
    minutes = [("two", 0), ("two", 1), ("three", 10), ("three", 11), ("three", 12), ("six", 20), ("six", 21), ("six", 22), ("six", 23), ("six", 24), ("six", 25)]
    rows = [(i, datetime(2024, 1, 1) + timedelta(minutes=m), s) for i, (s, m) in enumerate(minutes)]
    df = spark.createDataFrame(rows, "id LONG, ts TIMESTAMP_NTZ, scenario STRING")
    ep = F.col("scenario").isNotNull()
    half = [r.split for r in sp.half_guard_split(df, S, "ts", "scenario", ep).orderBy("id").collect()]
    assert half == ["fit", "validation", "fit", "guard", "validation", "fit", "fit", "fit", "guard", "validation", "validation"]
    last = [r.split for r in sp.last_minute_split(df, S, "ts", "scenario", ep).orderBy("id").collect()]
    assert last == ["train", "calibration", "train", "guard", "calibration", "train", "train", "train", "train", "guard", "calibration"]


def test_minute_owner_latest_then_override(spark):
    t = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    cat = spark.createDataFrame([("A", 1, t(0), t(2)), ("B", 2, t(2), t(4))], "scenario STRING, place INT, a TIMESTAMP_NTZ, b TIMESTAMP_NTZ")
    pos = spark.createDataFrame([(t(i),) for i in (1, 2, 3)], "minute TIMESTAMP_NTZ")
    own = {r.minute.minute: r.scenario for r in j.minute_tags(cat, pos, "place", "a", "b").collect()}
    assert own == {1: "A", 2: "B", 3: "B"}
    over = spark.createDataFrame([(t(2), "C", 9), (t(9), "C", 9)], "minute TIMESTAMP_NTZ, scenario STRING, place INT")
    own = {r.minute.minute: r.scenario for r in j.minute_tags(cat, pos, "place", "a", "b", over).collect()}
    assert own == {1: "A", 2: "C", 3: "B", 9: "C"}


def test_merged_windows(spark):
    t = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    df = spark.createDataFrame([(t(a), t(b)) for a, b in ((0, 10), (2, 3), (10, 12), (20, 21))], "a TIMESTAMP_NTZ, b TIMESTAMP_NTZ")
    got = sorted((r.a.minute, r.b.minute) for r in j.merged_windows(df, "a", "b").collect())
    assert got == [(0, 12), (20, 21)]


def test_names(spark):
    df = spark.createDataFrame([("Power output\n（MW）",), ("Steam  flow (t/h)",), ("x_LAG_5",), ("a-b c__abs_diff_1s",)], "s STRING")
    r = df.select(n.unit(F.col("s")).alias("u"), n.signal_name(F.col("s")).alias("g"), n.lag_step(F.col("s")).alias("k"), n.lag_base(F.col("s")).alias("b"),
                  n.display_name(F.col("s")).alias("d"), n.base_feature(F.col("s")).alias("base"), n.transformation(F.col("s")).alias("t")).collect()
    assert (r[0].u, r[0].g, r[0].d) == ("MW", "Power output", "power output")
    assert (r[1].u, r[1].d) == ("t/h", "steam flow")
    assert (r[2].k, r[2].b) == (5, "x") and r[0].k is None
    assert (r[3].base, r[3].t, r[2].t) == ("a-b c", "abs_diff_1s", "unknown")
