from __future__ import annotations

import os

from pyspark.sql import functions as F

from tidewatch.checks.common import by_user, events, r
from tidewatch.checks.registry import query
from tidewatch.checks.rules import DEC
from tidewatch.checks.windows import U
from tidewatch.functions import rules
from tidewatch.operators import joins as j, windows as w
from tidewatch.plans import forecast as fc
from tidewatch.sources import messages as ms
from tidewatch.sources.tables import shared_dir
from tidewatch.streaming import adapter as ad, features as ft, replay as rp, scoring as sc

C = F.col
NAMES = ["top", "mean"]

# Messages: one per event type and hour with two features; an hour without events is a gap,
# a mean above 60 arrives as Infinity and one below 3 as a boolean.
MSG = """h AS (SELECT event_type AS source, date_trunc('hour', ts)::TIMESTAMP AS ts, round(max(value), 6) AS top, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2),
m AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ts) AS step, lag(ts) OVER (PARTITION BY source ORDER BY ts) AS prev FROM h),
f AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(prev) <> 3600000000 THEN 'cadence' WHEN mean < 3 THEN 'invalid_values' WHEN mean > 60 THEN 'non_finite' END AS failure FROM m),
g AS (SELECT *, sum((failure IS NOT NULL)::INT) OVER (PARTITION BY source ORDER BY step) AS seg FROM f),
k AS (SELECT *, sum((failure IS NULL)::INT) OVER (PARTITION BY source, seg ORDER BY step) AS run FROM g),
st AS (SELECT *, CASE WHEN failure IS NOT NULL THEN 'INVALID_INPUT' WHEN run >= 11 THEN 'READY' ELSE 'NOT_READY' END AS status,
 CASE WHEN failure IS NULL AND run >= 11 THEN lag(top, 10) OVER (PARTITION BY source ORDER BY step) END AS top_lag_10, CASE WHEN failure IS NULL AND run >= 11 THEN mean END AS now FROM k)"""


def messages(spark, d):
    h = events(spark, d).groupBy(C("event_type").alias("source"), F.date_trunc("hour", "ts").alias("ts")).agg(r(F.max("value")).alias("top"), r(F.avg("value")).alias("mean"))
    h = w.positions(h, w.Series(["source"], ["ts"]), "step").withColumn("step", C("step") + 1)
    text = F.when(C("mean") > 60, "Infinity").when(C("mean") < 3, "true").otherwise(C("mean").cast("string"))
    body = F.struct(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), "source", "step", F.create_map(F.lit("top"), C("top").cast("string"), F.lit("mean"), text).alias("features"))
    return h.select("source", "ts", F.to_json(body).alias("payload"))


def parsed(df):
    return ad.parse(ms.decode(df.select("payload")), NAMES)


def adapted_stream(spark, d, slices=3, files=None):
    path = os.path.join(shared_dir(spark), "messages")
    rp.replay(messages(spark, d), path, "ts", "source", slices)
    return ad.adapt_stream(parsed(rp.payload_stream(spark, path, files)), NAMES, 3600.0)


@query("S09_stream_source", "SELECT event_id, user_id, ts, event_type, value FROM events")
def s09(spark, d):
    return rp.run_to_table(event_stream(spark, d)).select("event_id", "user_id", "ts", "event_type", "value")


@query("S10_replay_in_order", "SELECT user_id, count(*) AS messages, 0::BIGINT AS out_of_order FROM events GROUP BY 1")
def s10(spark, d):
    out = os.path.join(shared_dir(spark), "received")
    rp.run_batches(sliced_events(spark, d, 4, 3), lambda b, i: b.select("user_id", "ts", "event_id").withColumn("batch", F.lit(i)).write.mode("overwrite").parquet(f"{out}/part={i}"))
    got = spark.read.parquet(out)
    fr = by_user().frame(got, before=1)
    fr = fr.with_columns({"late": (F.lag("batch").over(fr.window()) > C("batch")).cast("int")})
    return fr.rows().groupBy("user_id").agg(F.count(F.lit(1)).alias("messages"), F.coalesce(F.sum("late"), F.lit(0)).cast("long").alias("out_of_order"))


ADAPT = f"WITH {MSG} SELECT source, step, status, failure, top_lag_10, now AS mean FROM st"


@query("T01_adapter_batch", ADAPT)
def t01_batch(spark, d):
    return ad.adapt_batch(parsed(messages(spark, d)), NAMES, 3600.0).select("source", "step", "status", "failure", "top_lag_10", "mean")


@query("T01_adapter_stream", ADAPT)
def t01_stream(spark, d):
    return rp.run_to_table(adapted_stream(spark, d, 3, 4)).select("source", "step", "status", "failure", "top_lag_10", "mean")


@query("T02_late_messages", f"""WITH h AS (SELECT event_type AS source, event_id AS step, date_trunc('hour', ts)::TIMESTAMP AS ts FROM events),
l AS (SELECT *, max(ts) OVER (PARTITION BY source ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM h)
SELECT source, step, CASE WHEN ts <= last THEN 'timestamp_order' WHEN epoch_us(ts) - epoch_us(last) <> 3600000000 THEN 'cadence' ELSE 'none' END AS failure FROM l""")
def t02(spark, d):
    # every event as a message stamped with its hour: repeats within an hour are late
    e = events(spark, d).select(C("event_type").alias("source"), C("event_id").alias("step"), F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
                                F.create_map(F.lit("top"), C("value").cast("string"), F.lit("mean"), F.lit("1")).alias("features"))
    x = ad.adapt_batch(ad.parse(e, NAMES), NAMES, 3600.0)
    return x.select("source", "step", F.coalesce("failure", F.lit("none")).alias("failure"))


@query("T03_cadence_breaks", f"WITH {MSG} SELECT source, count(*) FILTER (failure = 'cadence') AS cadence_breaks, count(*) FILTER (status = 'READY') AS ready FROM st GROUP BY 1")
def t03(spark, d):
    x = ad.adapt_batch(parsed(messages(spark, d)), NAMES, 3600.0)
    return x.groupBy("source").agg(F.count(F.when(C("failure") == "cadence", 1)).alias("cadence_breaks"), F.count(F.when(C("status") == "READY", 1)).alias("ready"))


WINDOWED = f"""SELECT event_id, round(value - lag(value) {U}, 6) + 0 AS diff, round(value - 2 * lag(value) {U} + lag(value, 2) {U}, 6) + 0 AS diff2, round(CASE WHEN count(*) OVER w = 5 THEN avg(value) OVER w END, 6) AS mean,
round(CASE WHEN count(*) OVER w = 5 THEN stddev_samp(value) OVER w END, 6) AS std, round(CASE WHEN count(*) OVER w = 5 THEN value - avg(value) OVER w END, 6) + 0 AS deviation
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"""
OUT = ["diff", "diff2", "mean", "std", "deviation"]


def event_stream(spark, d):
    return rp.table_stream(spark, d, "events").select("user_id", "ts", "event_id", "event_type", C("value").cast("double").alias("value"))


@query("T04_stream_features", WINDOWED)
def t04(spark, d):
    s = ft.stream_temporal_features(event_stream(spark, d), "user_id", ["ts", "event_id"], ["event_id"], ["value"])
    return rp.run_to_table(s).select("event_id", *[r(f"value__{k}").alias(k) for k in OUT])


def sliced_events(spark, d, slices, files):
    """Events as a payload stream in several triggers."""
    path = os.path.join(shared_dir(spark), "events")
    e = events(spark, d)
    rp.replay(e.select("user_id", "ts", F.to_json(F.struct("user_id", "event_id", "value", "event_type", C("ts").cast("string").alias("ts"))).alias("payload")), path, "ts", "user_id", slices)
    s = rp.payload_stream(spark, path, files)
    return s.select(F.inline(F.array(F.from_json("payload", "user_id BIGINT, event_id BIGINT, value DOUBLE, event_type STRING, ts TIMESTAMP_NTZ"))))


@query("T05_stream_features_in_chunks", WINDOWED)
def t05(spark, d):
    s = ft.stream_temporal_features(sliced_events(spark, d, 4, 3), "user_id", ["ts", "event_id"], ["event_id"], ["value"])
    return rp.run_to_table(s).select("event_id", *[r(f"value__{k}").alias(k) for k in OUT])


@query("T06_stream_scoring", """SELECT event_id, h AS horizon, round(0.5 * value + h, 6) AS predicted_value FROM events, (VALUES (2), (10), (30)) t(h)""")
def t06(spark, d):
    base = shared_dir(spark)
    models = {h: fc.LinearModel(("value",), (0.5,), float(h)) for h in (2, 10, 30)}
    handle = sc.score_and_store(models, ["event_id"], "ts", "user_id", "event_type", "value", f"{base}/measurements", f"{base}/predictions")
    rp.run_batches(sliced_events(spark, d, 3, 4), handle)
    p = spark.read.parquet(f"{base}/predictions")
    return p.select("event_id", C("prediction_horizon_minutes").alias("horizon"), r("predicted_value").alias("predicted_value"))


@query("T06_stream_measurements", "SELECT ts AS timestamp, user_id AS source_id, event_type AS parameter_id, value, 'GOOD' AS quality_status FROM events")
def t06m(spark, d):
    base = shared_dir(spark)
    models = {2: fc.LinearModel(("value",), (0.5,), 2.0)}
    rp.run_batches(event_stream(spark, d), sc.score_and_store(models, ["event_id"], "ts", "user_id", "event_type", "value", f"{base}/measurements", f"{base}/predictions"))
    return spark.read.parquet(f"{base}/measurements").drop("measurement_id", "batch")


@query("T07_stream_decisions", f"WITH {DEC} SELECT event_id, streak, level FROM l")
def t07(spark, d):
    s = sliced_events(spark, d, 3, 4)
    state = F.when(C("event_type") == "error", "ANOMALY").when(C("event_type") == "view", "anomaly").when(C("event_type") == "signup", "INSUFFICIENT_HISTORY").when(C("event_type") == "click", "UNAVAILABLE").otherwise("NORMAL")
    x = ft.stream_decisions(s.withColumn("state", state), "user_id", ["ts", "event_id"], "state")
    return rp.run_to_table(x).select("event_id", "streak", "level")


@query("T08_status_counters", f"WITH {MSG} SELECT status, coalesce(failure, 'none') AS failure, count(*) AS messages FROM st GROUP BY 1, 2")
def t08(spark, d):
    out = os.path.join(shared_dir(spark), "counters")
    statuses = rp.run_to_table(adapted_stream(spark, d)).select("status", F.coalesce("failure", F.lit("none")).alias("failure"))
    path = os.path.join(shared_dir(spark), "statuses")
    statuses.write.parquet(path)
    counts = ft.status_counts(spark.readStream.schema(statuses.schema).option("maxFilesPerTrigger", 2).parquet(path), ["status", "failure"])
    rp.run_batches(counts, lambda b, i: b.write.mode("overwrite").parquet(out), "complete")
    return spark.read.schema("status STRING, failure STRING, messages BIGINT").parquet(out)


@query("T09_batch_equals_stream", "SELECT count(*) AS matched_rows, 0::BIGINT AS left_only, 0::BIGINT AS right_only, 0::BIGINT AS different_rows, true AS equivalent FROM events")
def t09(spark, d):
    cols = [f"value__{k}" for k in ft.KINDS]
    s = ft.stream_temporal_features(sliced_events(spark, d, 3, 5), "user_id", ["ts", "event_id"], ["event_id"], ["value"])
    batch = w.temporal_features(events(spark, d).select("user_id", "ts", "event_id", "value"), by_user(), ["value"])
    e = j.equivalence(batch, rp.run_to_table(s), ["event_id"], {c: 1e-9 for c in cols})
    return e.select("matched_rows", "left_only", "right_only", "different_rows", "equivalent")


@query("T10_latest_state", "SELECT user_id, arg_max(event_id, ts) AS event_id, max(ts) AS ts, arg_max(value, ts) AS value FROM events GROUP BY 1")
def t10(spark, d):
    keep = sc.LatestRows(os.path.join(shared_dir(spark), "latest"), ["user_id"], ["ts", "event_id"])
    s = sliced_events(spark, d, 3, 4).select("user_id", "event_id", "ts", "value")
    rp.run_batches(s, keep.handle)
    return keep.read(spark, s.schema)


NEWEST = "QUALIFY row_number() OVER (PARTITION BY {} ORDER BY ts DESC, event_id DESC) = 1"


def latest_tables(spark, stream, handlers):
    """Run a stream into latest-row tables, all from the same batches: name -> (rows of a batch, keys)."""
    base = shared_dir(spark)
    keep = {n: (take, sc.LatestRows(f"{base}/{n}", keys, ["ts", "event_id"])) for n, (take, keys) in handlers.items()}
    rp.run_batches(stream, sc.several(*[lambda b, i, take=take, rows=rows: rows.handle(take(b), i) for take, rows in keep.values()]))
    return {n: rows.read(spark, take(stream).schema) for n, (take, rows) in keep.items()}


def latest_runtime(spark, d):
    """Latest measurement per source and parameter, and latest forecast per source and horizon, of one stream."""
    models = {h: fc.LinearModel(("value",), (0.5,), float(h)) for h in (2, 10, 30)}
    measured = lambda b: b.select("user_id", "event_type", "event_id", "ts", "value")
    horizons = lambda b: fc.score_horizons(b, models).select("user_id", "event_id", "ts", F.inline(F.array(*[
        F.struct(F.lit(h).alias("horizon"), C(f"forecast_{h}").alias("predicted_value")) for h in models])))
    return latest_tables(spark, sliced_events(spark, d, 3, 4), {
        "measurements": (measured, ["user_id", "event_type"]), "predictions": (horizons, ["user_id", "horizon"])})


@query("T10_latest_measurements", f"SELECT user_id, event_type, event_id, ts, value FROM events {NEWEST.format('user_id, event_type')}")
def t10_measurements(spark, d):
    return latest_runtime(spark, d)["measurements"]


@query("T10_latest_predictions", f"""SELECT user_id, event_id, ts, h AS horizon, round(0.5 * value + h, 6) AS predicted_value
FROM (SELECT * FROM events {NEWEST.format('user_id')}), (VALUES (2), (10), (30)) t(h)""")
def t10_predictions(spark, d):
    return latest_runtime(spark, d)["predictions"].withColumn("predicted_value", r("predicted_value"))


@query("T10_latest_decisions", f"WITH {DEC} SELECT user_id, event_id, ts, streak, level FROM l JOIN events USING (event_id) {NEWEST.format('user_id')}")
def t10_decisions(spark, d):
    state = F.when(C("event_type") == "error", "ANOMALY").when(C("event_type") == "view", "anomaly").when(C("event_type") == "signup", "INSUFFICIENT_HISTORY").when(C("event_type") == "click", "UNAVAILABLE").otherwise("NORMAL")
    x = ft.stream_decisions(sliced_events(spark, d, 3, 4).withColumn("state", state), "user_id", ["ts", "event_id"], "state")
    decided = lambda b: b.select("user_id", "event_id", "ts", "streak", "level")
    return latest_tables(spark, x, {"decisions": (decided, ["user_id"])})["decisions"]
