from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.checks.common import TAGS, TAGS_HOURLY, by_type, by_user, events, one_stream, r, tags_hourly
from tidewatch.checks.registry import query
from tidewatch.operators import metrics, windows as w
from tidewatch.operators.series import Series

LEADS = {"target_2": 1, "target_10": 5, "target_30": 15}
U = "OVER (PARTITION BY user_id ORDER BY ts, event_id)"


@query("persistence_forecast", f"""
WITH s AS (SELECT user_id, value, lag(value, 10) {U} AS warm, lead(value, 1) {U} AS target_2,
                  lead(value, 5) {U} AS target_10, lead(value, 15) {U} AS target_30 FROM events),
t AS (SELECT * FROM s WHERE warm IS NOT NULL AND target_30 IS NOT NULL),
tall AS (SELECT 2 AS horizon, target_2 AS actual, value AS forecast FROM t
         UNION ALL SELECT 10, target_10, value FROM t UNION ALL SELECT 30, target_30, value FROM t)
SELECT horizon, count(*) AS rows, round(avg(abs(forecast - actual)), 6) AS mae,
       round(sqrt(avg((forecast - actual) ** 2)), 6) AS rmse,
       round(1 - sum((forecast - actual) ** 2) / (var_pop(actual) * count(*)), 6) AS r2
FROM tall GROUP BY horizon""")
def persistence_forecast(spark, d):
    rows = w.supervised_rows(events(spark, d).select("user_id", "ts", "event_id", "value"), by_user(), "value", [1, 2, 5, 10], LEADS)
    tall = rows.select(F.inline(F.array(*[
        F.struct(F.lit(int(n.split("_")[1])).alias("horizon"), F.col(n).alias("actual"), F.col("value").alias("forecast"))
        for n in LEADS])))
    m = metrics.regression_errors(tall, ["horizon"], "actual", "forecast")
    return m.select("horizon", "rows", r("mae").alias("mae"), r("rmse").alias("rmse"), r("r2").alias("r2"))


@query("W01_row_lags", "SELECT event_id, " + ", ".join(f"lag(value, {k}) {U} AS value_lag_{k}" for k in (1, 2, 5, 10)) + " FROM events")
def w01(spark, d):
    e = events(spark, d).select("user_id", "ts", "event_id", "value")
    return w.row_lags(e, by_user(), ["value"], [1, 2, 5, 10]).select("event_id", *[f"value_lag_{k}" for k in (1, 2, 5, 10)])


@query("W02_row_leads", "SELECT event_id, " + ", ".join(f"lead(value, {k}) {U} AS {n}" for n, k in LEADS.items()) + " FROM events")
def w02(spark, d):
    e = events(spark, d).select("user_id", "ts", "event_id", "value")
    return w.row_leads(e, by_user(), "value", LEADS).select("event_id", *LEADS)


GAP = 6 * 3600
SEQ = f"""g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) {U} > {GAP}000000 THEN 1 ELSE 0 END AS brk FROM events),
q AS (SELECT *, (sum(brk) {U})::BIGINT AS sequence_id FROM g)"""
UQ = "OVER (PARTITION BY user_id, sequence_id ORDER BY ts, event_id)"
UR = "OVER (PARTITION BY user_id, sequence_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"


@query("W03_first_difference", f"""WITH {SEQ} SELECT event_id, round(value - lag(value) {UQ}, 6) + 0 AS diff,
round(abs(value - lag(value) {UQ}), 6) AS abs_diff FROM q""")
def w03(spark, d):
    e = events(spark, d).select("user_id", "ts", "event_id", "value")
    t = w.temporal_features(e, by_user(), ["value"], gap_seconds=GAP, kinds=("diff", "abs_diff"))
    return t.select("event_id", r("value__diff").alias("diff"), r("value__abs_diff").alias("abs_diff"))


@query("W04_second_difference", f"""WITH {SEQ} SELECT event_id,
round(value - 2 * lag(value, 1) {UQ} + lag(value, 2) {UQ}, 6) + 0 AS diff2 FROM q""")
def w04(spark, d):
    e = events(spark, d).select("user_id", "ts", "event_id", "value")
    t = w.temporal_features(e, by_user(), ["value"], gap_seconds=GAP, kinds=("diff2",))
    return t.select("event_id", r("value__diff2").alias("diff2"))


def _rolling(name, kind, expr, gap):
    part = UR if gap else "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
    src = f"WITH {SEQ} SELECT" if gap else "SELECT"

    @query(name, f"""{src} event_id, round(CASE WHEN count(value) {part} = 5 THEN {expr.format(w=part)} END, 6) + 0 AS {kind}
FROM {'q' if gap else 'events'}""")
    def run(spark, d):
        e = events(spark, d).select("user_id", "ts", "event_id", "value")
        t = w.temporal_features(e, by_user(), ["value"], gap_seconds=GAP if gap else None, kinds=(kind,))
        return t.select("event_id", r(f"value__{kind}").alias(kind))


_rolling("W05_rolling_mean", "mean", "avg(value) {w}", False)
_rolling("W06_rolling_std", "std", "stddev_samp(value) {w}", True)
_rolling("W07_rolling_deviation", "deviation", "value - avg(value) {w}", False)


@query("W08_gap_sequences", f"WITH {SEQ} SELECT event_id, sequence_id FROM q")
def w08(spark, d):
    return w.sequence_ids(events(spark, d).select("user_id", "ts", "event_id"), by_user(), GAP).select("event_id", "sequence_id")


@query("W09_exact_cadence_sequences", f"""WITH {TAGS_HOURLY}, h AS (SELECT hour FROM tags WHERE error IS NOT NULL),
g AS (SELECT hour, CASE WHEN epoch_us(hour) - lag(epoch_us(hour)) OVER (ORDER BY hour) <> 3600000000 THEN 1 ELSE 0 END AS brk FROM h)
SELECT hour, (1 + sum(brk) OVER (ORDER BY hour))::BIGINT AS sequence_id FROM g""")
def w09(spark, d):
    h = tags_hourly(spark, d).filter(F.col("error").isNotNull()).select("hour")
    return w.sequence_ids(h, Series([], ["hour"]), 3600.0, exact=True)


@query("W10_gap_report", f"""WITH g AS (SELECT user_id, lag(ts) {U} AS previous_ts, ts AS current_ts FROM events)
SELECT user_id, previous_ts, current_ts, (epoch_us(current_ts) - epoch_us(previous_ts)) / 1e6 AS gap_s FROM g
WHERE epoch_us(current_ts) - epoch_us(previous_ts) > {GAP}000000""")
def w10(spark, d):
    return w.gap_report(events(spark, d), by_user(), GAP)


@query("W11_label_islands", f"""WITH l AS (SELECT *, (event_type = 'error')::INTEGER AS label FROM events),
c AS (SELECT *, CASE WHEN lag(label) {U} = label THEN 0 ELSE 1 END AS brk FROM l),
s AS (SELECT *, (sum(brk) {U})::BIGINT AS segment FROM c)
SELECT user_id, segment, label, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS rows,
       (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS duration_s FROM s GROUP BY 1, 2, 3""")
def w11(spark, d):
    e = events(spark, d).withColumn("label", (F.col("event_type") == "error").cast("int"))
    return w.islands(e, by_user(), "label")


@query("W12_positive_minute_blocks", """WITH m AS (SELECT DISTINCT date_trunc('minute', ts)::TIMESTAMP AS b FROM events WHERE event_type = 'error'),
g AS (SELECT b, CASE WHEN epoch_us(b) - lag(epoch_us(b)) OVER (ORDER BY b) = 60000000 THEN 0 ELSE 1 END AS brk FROM m),
s AS (SELECT b, (sum(brk) OVER (ORDER BY b))::BIGINT AS block FROM g)
SELECT block, min(b) AS first_bucket, max(b) AS last_bucket, count(*) AS buckets FROM s GROUP BY block""")
def w12(spark, d):
    e = events(spark, d).filter(F.col("event_type") == "error").select(F.date_trunc("minute", "ts").alias("minute"))
    return w.bucket_blocks(e, [], "minute", 60)


@query("W13_bucket_continuity", """WITH m AS (SELECT DISTINCT event_type, date_trunc('hour', ts)::TIMESTAMP AS b FROM events),
g AS (SELECT event_type, CASE WHEN epoch_us(b) - lag(epoch_us(b)) OVER (PARTITION BY event_type ORDER BY b) = 3600000000 THEN 0 ELSE 1 END AS brk FROM m)
SELECT event_type, count(*) AS buckets, (sum(brk) - 1)::BIGINT AS breaks, sum(brk) = 1 AS continuous FROM g GROUP BY 1""")
def w13(spark, d):
    e = events(spark, d).select("event_type", F.date_trunc("hour", "ts").alias("hour"))
    return w.continuity(e, ["event_type"], "hour", 3600)


@query("W14_episode_gaps", """WITH p AS (SELECT event_id, ts AS s, ts + INTERVAL 30 MINUTE AS e FROM events WHERE event_type = 'purchase'),
g AS (SELECT event_id, round((epoch_us(s) - lag(epoch_us(e)) OVER (ORDER BY s, event_id)) / 6e7 - 1, 9) + 0 AS gap_minutes FROM p)
SELECT event_id, gap_minutes, (SELECT min(gap_minutes) FROM g) AS min_gap FROM g""")
def w14(spark, d):
    p = events(spark, d).filter(F.col("event_type") == "purchase").select(
        "event_id", F.col("ts").alias("s"), (F.col("ts") + F.expr("INTERVAL 30 MINUTES")).alias("e"))
    g = w.episode_gaps(p, "s", "e", "event_id").select("event_id", r("gap_minutes", 9).alias("gap_minutes"))
    return g.withColumn("min_gap", g.agg(F.min("gap_minutes")).scalar())


@query("W15_second_in_minute", """WITH m AS (SELECT event_id, event_type, ts, date_trunc('minute', ts)::TIMESTAMP AS minute FROM events),
p AS (SELECT *, row_number() OVER (PARTITION BY event_type, minute ORDER BY ts, event_id) - 1 AS place,
             min(minute) OVER (PARTITION BY event_type) AS first_minute FROM m)
SELECT event_id, place, minute + to_seconds(place + CASE WHEN minute = first_minute AND place < 60 THEN 1 ELSE 0 END) AS second_ts FROM p""")
def w15(spark, d):
    e = events(spark, d).select("event_id", "event_type", "ts")
    return w.seconds_in_minute(e, Series(["event_type"], ["ts"]), "event_id").select("event_id", "place", "second_ts")


@query("W18_error_streak", f"""WITH x AS (SELECT *, (event_type IN ('error', 'view'))::INTEGER AS hit FROM events),
s AS (SELECT *, sum(1 - hit) {U} AS resets FROM x)
SELECT event_id, (sum(hit) OVER (PARTITION BY user_id, resets ORDER BY ts, event_id))::BIGINT AS streak FROM s""")
def w18(spark, d):
    e = events(spark, d).select("user_id", "ts", "event_id", "event_type")
    return w.streaks(e, by_user(), F.col("event_type").isin("error", "view")).select("event_id", "streak")


@query("W19_row_readiness", f"""WITH {TAGS_HOURLY}, h AS (SELECT hour, error, view FROM tags WHERE click IS NOT NULL),
s AS (SELECT *, CASE WHEN epoch_us(hour) - lag(epoch_us(hour)) OVER (ORDER BY hour) = 3600000000 THEN 1 ELSE 0 END AS ok,
        (view IS NOT NULL AND error IS NOT NULL)::INTEGER AS fin, row_number() OVER (ORDER BY hour) AS n FROM h),
t AS (SELECT *, min(ok) OVER (ORDER BY hour ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS steps,
        (fin = 1 AND lag(error, 1) OVER (ORDER BY hour) IS NOT NULL AND lag(error, 2) OVER (ORDER BY hour) IS NOT NULL AND lag(error, 5) OVER (ORDER BY hour) IS NOT NULL AND lag(error, 10) OVER (ORDER BY hour) IS NOT NULL)::INT AS vals FROM s)
SELECT hour, CASE WHEN n <= 10 THEN 'WARMUP_INCOMPLETE' WHEN steps = 0 OR vals = 0 THEN 'BLOCKED' ELSE 'READY' END AS row_status FROM t""")
def w19(spark, d):
    h = tags_hourly(spark, d).filter(F.col("click").isNotNull()).select("hour", "error", "view")
    return w.readiness(h, Series([], ["hour"]), 3600.0, ["error", "view"], ["error"]).select("hour", "row_status")


@query("W20_ramp", f"SELECT event_id, round(value - lag(value) {U}, 6) + 0 AS ramp, round(abs(value - lag(value) {U}), 6) AS abs_ramp FROM events")
def w20(spark, d):
    e = events(spark, d).select("user_id", "ts", "event_id", "value")
    t = w.temporal_features(e, by_user(), ["value"], kinds=("diff", "abs_diff"))
    return t.select("event_id", r("value__diff").alias("ramp"), r("value__abs_diff").alias("abs_ramp"))


@query("W21_extreme_changes", f"""WITH {TAGS_HOURLY}, tall AS (
{" UNION ALL ".join(f"SELECT '{t}' AS feature, hour, {t} AS current, lag({t}) OVER (ORDER BY hour) AS previous, epoch_us(hour) - lag(epoch_us(hour)) OVER (ORDER BY hour) AS dt FROM tags" for t in TAGS)}),
k AS (SELECT feature, hour, round(previous, 6) AS previous, round(current, 6) AS current,
 round(current - previous, 6) + 0 AS change, round(abs(current - previous), 6) AS abs_change, row_number() OVER (PARTITION BY feature ORDER BY abs(current - previous) DESC, hour) AS change_rank
 FROM tall WHERE dt <= 3600000000 AND previous IS NOT NULL AND current IS NOT NULL)
SELECT * REPLACE (change_rank::INTEGER AS change_rank) FROM k WHERE change_rank <= 20""")
def w21(spark, d):
    x = w.extreme_changes(tags_hourly(spark, d), Series([], ["hour"]), TAGS, 3600.0, 20)
    return x.select("feature", "hour", r("previous").alias("previous"), r("current").alias("current"), r("change").alias("change"), r("abs_change").alias("abs_change"), "change_rank")


@query("W22_interval_check", f"""WITH g AS (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) {U} AS dt FROM events)
SELECT user_id, count(*) AS rows, count(*) FILTER (dt <= 0) AS not_increasing, count(*) FILTER (dt <> 3600000000) AS off_cadence FROM g GROUP BY 1""")
def w22(spark, d):
    return w.interval_check(events(spark, d), by_user(), 3600.0)


@query("W23_positional_split", """WITH p AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS position, count(*) OVER () AS n FROM events)
SELECT event_id, position, CASE WHEN position < floor(n * 0.8) THEN 'train' ELSE 'test' END AS split FROM p""")
def w23(spark, d):
    p = w.positions(events(spark, d).select("ts", "event_id"), one_stream(), "position", "n")
    return p.select("event_id", "position", F.when(F.col("position") < F.floor(F.col("n") * 0.8), "train").otherwise("test").alias("split"))


@query("W24_rebased_series", """SELECT event_id, TIMESTAMP '2030-05-01 00:00:00' + (ts - min(ts) OVER (PARTITION BY user_id)) AS rebased_ts,
weekday(TIMESTAMP '2030-05-01 00:00:00' + (ts - min(ts) OVER (PARTITION BY user_id)))::INTEGER AS wd FROM events""".replace("weekday(", "(isodow(").replace(")::INTEGER AS wd", ") - 1)::INTEGER AS wd"))
def w24(spark, d):
    e = w.rebase(events(spark, d).select("event_id", "user_id", "ts"), ["user_id"], "ts", F.expr("TIMESTAMP_NTZ '2030-05-01 00:00:00'"))
    return w.calendar(e, "rebased_ts").select("event_id", "rebased_ts", F.col("day_of_week").alias("wd"))
