import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import joins as j, windows as w
from tidewatch.operators.series import Series
from tidewatch.streaming import adapter as ad, features as ft, replay as rp

NAMES = ["a", "b"]


def message(step, minute, values=None, source="s", stamp=None):
    ts = stamp if stamp is not None else str(pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=minute))
    return (ts, source, step, {"a": str(step), "b": "1.5"} if values is None else values)


def table(spark, rows):
    return spark.createDataFrame(rows, "timestamp STRING, source STRING, step LONG, features MAP<STRING, STRING>")


GOOD = [message(i, 2 * i) for i in range(25)]


def later(start_step, start_minute, n):
    return [message(start_step + i, start_minute + 2 * i) for i in range(n)]


CASES = {
    "good": GOOD,
    "duplicate_time": [*later(0, 0, 6), message(6, 10), *later(7, 12, 12)],
    "late_time": [*later(0, 0, 6), message(6, 4), *later(7, 12, 12)],
    "cadence_break": [*later(0, 0, 6), *later(6, 14, 12)],
    "missing_key": [*later(0, 0, 4), message(4, 8, {"a": "1"}), *later(5, 10, 12)],
    "boolean": [*later(0, 0, 4), message(4, 8, {"a": "true", "b": "1"}), *later(5, 10, 12)],
    "not_finite": [*later(0, 0, 4), message(4, 8, {"a": "NaN", "b": "1"}), *later(5, 10, 12)],
    "bad_time": [*later(0, 0, 4), message(4, 8, stamp="soon"), *later(5, 3, 13)],
    "no_features": [*later(0, 0, 4), (*message(4, 8)[:3], None), *later(5, 10, 12)],
    "extra_key": [message(i, 2 * i, {"a": "1", "b": "2", "c": "3"}) for i in range(12)],
}


def by_hand(rows):
    """Plain replay of the rules, for comparison."""
    last, n, out = None, 0, []
    for ts, _, step, feats in rows:
        t = pd.to_datetime(ts, errors="coerce")
        if pd.isna(t):
            last, n, kind = None, 0, "invalid_timestamp"
        elif last is not None and t <= last:
            n, kind = 0, "timestamp_order"
        else:
            ok = last is None or t - last == pd.Timedelta(minutes=2)
            last = t
            if not ok:
                kind = "cadence"
            elif feats is None:
                kind = "malformed_features"
            elif not {"a", "b"} <= set(feats):
                kind = "missing_raw"
            elif any(v in ("true", "false") for v in (feats["a"], feats["b"])):
                kind = "invalid_values"
            elif not all(np.isfinite(float(feats[k])) for k in NAMES):
                kind = "non_finite"
            else:
                kind = None
            n = n + 1 if kind is None else 0
        out.append((step, "INVALID_INPUT" if kind else "READY" if n >= 11 else "NOT_READY", kind))
    return out


@pytest.mark.parametrize("case", CASES)
def test_adapter_batch_rules(spark, case):
    got = ad.adapt_batch(ad.parse(table(spark, CASES[case]), NAMES), NAMES).orderBy("step")
    assert [(r.step, r.status, r.failure) for r in got.collect()] == by_hand(CASES[case])


def test_adapter_with_hot_source(spark):
    rows = [x for case in CASES.values() for x in [(t, "hot", 1000 * k + s, f) for k, (t, _, s, f) in enumerate(case)]]
    rows = sorted(rows, key=lambda r: r[2])
    parsed = ad.parse(table(spark, rows), NAMES)
    cut = ad.adapt_batch(parsed, NAMES, target_rows=5, cell=F.floor(F.col("step") / 10))
    got = [(r.step, r.status, r.failure) for r in cut.orderBy("step").collect()]
    assert [x[1:] for x in got] == [x[1:] for x in by_hand(rows)] and len(got) == len(rows)


def test_adapter_stream_equals_batch(spark, tmp_path):
    rows = []
    for k, (name, case) in enumerate(CASES.items()):
        rows += [(t, name, s, f) for t, _, s, f in case]
    df = table(spark, rows).withColumn("part", F.floor(F.col("step") / 7))
    for p in range(4):  # several triggers
        df.filter(F.col("part") == p).drop("part").coalesce(1).write.mode("append").json(str(tmp_path))
    stream = spark.readStream.schema(table(spark, []).schema).option("maxFilesPerTrigger", 1).json(str(tmp_path))
    got = rp.run_to_table(ad.adapt_stream(ad.parse(stream, NAMES), NAMES)).toPandas().sort_values(["source", "step"]).reset_index(drop=True)
    want = ad.adapt_batch(ad.parse(table(spark, rows), NAMES), NAMES).toPandas().sort_values(["source", "step"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(got[want.columns], want, check_dtype=False)


def walk(spark, n=60):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"k": rng.integers(0, 3, n), "id": np.arange(n), "v": rng.normal(0, 5, n)})
    return spark.createDataFrame(pdf)


@pytest.mark.parametrize("chunk", [7, 60])
def test_stream_features_do_not_depend_on_chunks(spark, tmp_path, chunk):
    df = walk(spark).cache()
    for a in range(0, 60, chunk):
        df.filter((F.col("id") >= a) & (F.col("id") < a + chunk)).coalesce(1).write.mode("append").json(str(tmp_path))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).json(str(tmp_path))
    got = rp.run_to_table(ft.stream_temporal_features(stream, "k", ["id"], ["id"], ["v"]))
    want = w.temporal_features(df, Series(["k"], ["id"], cell=F.col("id")), ["v"])
    e = j.equivalence(want, got, ["id"], {f"v__{k}": 1e-9 for k in ft.KINDS}).first()
    assert e.equivalent and e.matched_rows == 60


def test_chunks_without_carried_rows_differ(spark):
    """Negative case: features of a part alone are not those of the whole series."""
    df = walk(spark)
    s = Series(["k"], ["id"], cell=F.col("id"))
    alone = w.temporal_features(df.filter("id >= 30"), s, ["v"])
    whole = w.temporal_features(df, s, ["v"]).filter("id >= 30")
    assert not j.equivalence(whole, alone, ["id"], {"v__std": 1e-9}).first().equivalent


def test_malformed_message_forgets_the_time(spark):
    from tidewatch.sources import messages as ms

    good = [f'{{"timestamp": "2024-01-01 00:{2 * i:02d}:00", "source": "s", "step": {i}, "features": {{"a": 1, "b": true}}}}' for i in range(2)]
    df = spark.createDataFrame([(x,) for x in [*good, "no json at all"]], "payload STRING")
    got = ad.adapt_batch(ad.parse(ms.decode(df), NAMES), NAMES)
    assert sorted((r.source or "", r.failure) for r in got.collect()) == [("", "malformed_message"), ("s", "invalid_values"), ("s", "invalid_values")]
