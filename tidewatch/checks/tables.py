"""Scans, sinks, projections, equi-joins, sets, top-k, scalar functions and contracts."""
from __future__ import annotations

import os

from pyspark.sql import functions as F

from tidewatch.checks.common import MEASURES, TAGS, TAGS_HOURLY, by_user, events, one_stream, r, tags_hourly
from tidewatch.checks.metrics import PROB, SCORED, probabilities, scored
from tidewatch.checks.registry import query
from tidewatch.checks.windows import LEADS, U
from tidewatch.functions import families as fam, names as n, times as tm
from tidewatch.operators import columns as co, contracts as ct, correlate as c, joins as j, metrics as m, profile as p, topk as k, windows as w
from tidewatch.operators.series import Series
from tidewatch.sources import messages as ms, sinks, tables as t
from tidewatch.sources.tables import small_table, shared_dir, table

C = F.col

# ---- sources and sinks -------------------------------------------------------------------------


@query("S01_delimited_scan", "SELECT event_id, ts, user_id, event_type, value FROM events")
def s01(spark, d):
    e = events(spark, d).select("event_id", "ts", "user_id", "event_type", "value")
    path = os.path.join(shared_dir(spark), "csv")
    e.write.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path)
    return t.read_delimited(spark, path, e.schema, timestampNTZFormat="yyyy-MM-dd HH:mm:ss.SSSSSS")


@query("S02_directory_scan", "SELECT 'customer.parquet' AS source_file, c_custkey AS id, c_acctbal AS balance FROM customer UNION ALL SELECT 'supplier.parquet', s_suppkey, s_acctbal FROM supplier")
def s02(spark, d):
    a = t.read_parts(spark, [f"{d}/customer.parquet"]).select("source_file", C("c_custkey").alias("id"), C("c_acctbal").alias("balance"))
    b = t.read_parts(spark, [f"{d}/supplier.parquet"]).select("source_file", C("s_suppkey").alias("id"), C("s_acctbal").alias("balance"))
    return a.unionByName(b)


@query("S03_schema_scan", " UNION ALL ".join(f"SELECT {i} AS ordinal, '{c}' AS column_name, '{y}' AS data_type, count({c}) AS present FROM events" for i, (c, y) in enumerate(
    [("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"), ("event_type", "string"), ("value", "double"), ("props", "string")])))
def s03(spark, d):
    e = events(spark, d)
    present = e.agg(*[F.count(c).alias(c) for c in e.columns]).select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), C(c).alias("present")) for c in e.columns])))
    return t.schema_table(e).join(present, "column_name")


@query("S04_pruned_scan", "SELECT l_returnflag, count(*) AS rows, round(sum(l_tax), 4) AS tax FROM lineitem GROUP BY 1")
def s04(spark, d):
    return t.scan(table(spark, d, "lineitem"), ["l_returnflag", "l_tax"]).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("rows"), r(F.sum("l_tax"), 4).alias("tax"))


@query("S05_filtered_scan", "SELECT event_id, ts, value FROM events WHERE event_type = 'error' AND value > 50 ORDER BY ts DESC, event_id DESC LIMIT 100")
def s05(spark, d):
    return t.scan(events(spark, d), ["event_id", "ts", "value"], [C("event_type") == "error", C("value") > 50], [F.desc("ts"), F.desc("event_id")], 100)


@query("S06_append_measurements", "SELECT ts AS timestamp, user_id AS source_id, event_type AS parameter_id, value, 'GOOD' AS quality_status, 1::BIGINT AS ids FROM events")
def s06(spark, d):
    path = os.path.join(shared_dir(spark), "measurements")
    rows = sinks.measurement_rows(events(spark, d), "ts", "user_id", "event_type", "value", F.lit("GOOD"))
    for _ in range(2):  # the batch is run again after a failure
        sinks.append(rows, path, batch_id=0)
    x = spark.read.parquet(path).drop("batch")
    per = x.groupBy("measurement_id").agg(F.count(F.lit(1)).alias("ids"))
    return x.join(per, "measurement_id").drop("measurement_id")


@query("S07_prediction_rows", "SELECT event_id, h AS prediction_horizon_minutes, round(value + h, 6) AS predicted_value, 'm' AS model_name, 'FORECAST' AS prediction_type FROM events, (VALUES (2), (10), (30)) t(h)")
def s07(spark, d):
    e = events(spark, d).select("event_id", *[(C("value") + h).alias(f"f{h}") for h in (2, 10, 30)])
    x = sinks.prediction_rows(e, ["event_id"], {2: "f2", 10: "f10", 30: "f30"}, "m")
    return x.drop("prediction_id").withColumn("predicted_value", r("predicted_value"))


@query("S08_alarm_rows", """SELECT event_id, 'DSS_DECISION' AS event_type, CASE WHEN value > 100 THEN 'DSS_LEVEL_3' ELSE 'DSS_LEVEL_2' END AS alarm_code, CASE WHEN value > 100 THEN 'CRITICAL' ELSE 'WARNING' END AS severity, 'ACTIVE' AS status FROM events WHERE value > 20""")
def s08(spark, d):
    level = F.when(C("value") > 100, "LEVEL_3").when(C("value") > 20, "LEVEL_2").otherwise("LEVEL_1")
    e = events(spark, d).withColumn("level", level)
    return sinks.alarm_rows(e, ["event_id"], "level", F.lit("X"), "value", "event_type").drop("description", "event_row_id")


@query("S11_decode_messages", "SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k, user_id AS step, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, false AS corrupt FROM events")
def s11(spark, d):
    e = events(spark, d).withColumn("k", F.get_json_object("props", "$.k"))
    x = e.select("event_id", F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.lit("s").alias("source"), C("user_id").alias("step"), F.create_map(F.lit("k"), "k").alias("features"))).alias("payload"))
    return ms.feature_columns(ms.decode(x), ["k"]).select("event_id", "k", "step", "timestamp", "corrupt")


@query("S11_corrupt_messages", "SELECT count(*) AS rows, count(*) AS corrupt FROM documents")
def s11c(spark, d):
    x = ms.decode(table(spark, d, "documents").select(C("text").alias("payload")))
    return x.agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(C("corrupt"), 1)).alias("corrupt"))


@query("S12_partitioned_result", "SELECT event_type, count(*) AS rows, round(sum(value), 4) AS total FROM events GROUP BY 1")
def s12(spark, d):
    path = os.path.join(shared_dir(spark), "by_type")
    sinks.write_partitioned(events(spark, d), path, ["event_type"])
    return spark.read.parquet(path).groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"), r(F.sum("value"), 4).alias("total"))


@query("S13_latest_snapshot", "SELECT user_id, max(ts) AS ts, arg_max(event_id, ts) AS event_id, arg_max(value, ts) AS value FROM events GROUP BY 1")
def s13(spark, d):
    path = os.path.join(shared_dir(spark), "latest")
    e = events(spark, d).select("user_id", "ts", "event_id", "value")
    sinks.snapshot(e, ["user_id"], ["ts", "event_id"], path)
    return spark.read.schema(e.schema).parquet(path)


@query("S14_manifest_read", "SELECT (row_number() OVER (ORDER BY p_name) - 1)::INTEGER AS feature_order, p_name AS feature FROM (SELECT DISTINCT p_name FROM part)")
def s14(spark, d):
    path = os.path.join(shared_dir(spark), "manifest")
    # a manifest is the ordered list of feature names: bounded by the column count
    names = table(spark, d, "part").select("p_name").distinct().agg(F.sort_array(F.collect_list("p_name")).alias("feature_names"))
    names.coalesce(1).write.json(path)
    return t.read_manifest(spark, path)


@query("S15_registry_inventory", """SELECT 'events' AS dataset, 'series' AS role, 'ACTIVE' AS status, count(*) AS rows FROM events UNION ALL SELECT 'lineitem', 'measures', 'ACTIVE', count(*) FROM lineitem
UNION ALL SELECT 'orders', 'fact', 'ACTIVE', count(*) FROM orders""")
def s15(spark, d):
    cat = t.registry_table(spark, [("events", f"{d}/events.parquet", "series", "ACTIVE"), ("lineitem", f"{d}/lineitem.parquet", "measures", "ACTIVE"), ("orders", f"{d}/orders.parquet", "fact", "ACTIVE")])
    one = None
    for name in ("events", "lineitem", "orders"):
        x = table(spark, d, name).agg(F.count(F.lit(1)).alias("rows")).withColumn("dataset", F.lit(name))
        one = x if one is None else one.unionByName(x)
    return cat.join(one, "dataset").select("dataset", "role", "status", "rows")


# ---- projections and filters -----------------------------------------------------------------


@query("P01_manifest_projection", "SELECT value, event_id, event_type FROM events")
def p01(spark, d):
    return co.by_manifest(events(spark, d), ["value", "event_id", "event_type"])


@query("P03_numeric_columns", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem")
def p03(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(*co.numeric_columns(li))


LAGGED = f"lg AS (SELECT event_id, ts, value, " + ", ".join(f"lag(value, {x}) {U} AS value_lag_{x}" for x in (1, 2, 5, 10)) + f", lead(value) {U} AS target_2 FROM events)"


def lagged(spark, d):
    e = events(spark, d).select("user_id", "ts", "event_id", "value")
    return w.supervised_rows(e, by_user(), "value", [1, 2, 5, 10], {"target_2": 1}, drop_incomplete=False)


@query("P04_feature_set", f"WITH {LAGGED} SELECT hour(ts)::INTEGER AS hour, value, value_lag_1, value_lag_2, value_lag_5, value_lag_10 FROM lg")
def p04(spark, d):
    x = w.calendar(lagged(spark, d), "ts")
    return x.select(*co.feature_set(x.columns, ["hour"], ["value", "value", "absent"], ["target_2"]))


@query("P05_leakage_columns", "SELECT l_orderkey, l_quantity FROM lineitem")
def p05(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_quantity", C("l_tax").alias("Net power\noutput (MW)"), C("l_discount").alias("Unit  Efficiency"))
    return li.drop(*co.leaking(li.columns))


@query("P06_drop_incomplete", f"WITH {LAGGED} SELECT event_id FROM lg WHERE value_lag_10 IS NOT NULL AND target_2 IS NOT NULL")
def p06(spark, d):
    return co.drop_incomplete(lagged(spark, d), ["value_lag_10", "target_2"]).select("event_id")


@query("P07_finite_rows", "SELECT event_id, round(1 / value, 6) AS inverse FROM events WHERE value <> 0")
def p07(spark, d):
    # a zero reading gives an infinite inverse
    e = events(spark, d).withColumn("inverse", F.when(C("value") == 0, float("inf")).otherwise(F.try_divide(F.lit(1.0), C("value"))))
    return co.finite_rows(e, ["inverse"]).select("event_id", r("inverse").alias("inverse"))


@query("P08_lenient_number", "SELECT doc_id, TRY_CAST(CASE WHEN doc_id % 3 = 0 THEN lang ELSE n_chars::VARCHAR END AS DOUBLE) AS v FROM documents")
def p08(spark, d):
    x = table(spark, d, "documents").select("doc_id", F.when(C("doc_id") % 3 == 0, C("lang")).otherwise(C("n_chars").cast("string")).alias("s"))
    return x.select("doc_id", co.lenient_double("s").alias("v"))


@query("P09_strict_number", "SELECT doc_id, CAST(n_chars::VARCHAR AS DOUBLE) AS v FROM documents")
def p09(spark, d):
    return table(spark, d, "documents").select("doc_id", C("n_chars").cast("string").alias("s")).select("doc_id", co.strict_double("s").alias("v"))


@query("P10_time_range", "SELECT event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05 06:00:00' AND TIMESTAMP '2024-01-07 18:30:00'")
def p10(spark, d):
    lit = lambda s: F.lit(s).cast("timestamp_ntz")
    return t.scan(events(spark, d), ["event_id"], [C("ts").between(lit("2024-01-05 06:00:00"), lit("2024-01-07 18:30:00"))])


@query("P11_membership", "SELECT event_id FROM events WHERE event_type IN ('error', 'signup')")
def p11(spark, d):
    return t.scan(events(spark, d), ["event_id"], [C("event_type").isin("error", "signup")])


@query("P12_substring", "SELECT doc_id FROM documents WHERE contains(text, '+')")
def p12(spark, d):
    return t.scan(table(spark, d, "documents"), ["doc_id"], [C("text").contains("+")])


@query("P13_replay_columns", "SELECT event_id AS id, 'replay' AS source, row_number() OVER (ORDER BY ts, event_id) AS step FROM events")
def p13(spark, d):
    e = w.positions(events(spark, d).select("event_id", "ts"), one_stream(), "step").withColumn("step", C("step") + 1)
    return co.stack_with_constants(e, {"source": "replay"}, {"event_id": "id"}).select("id", "source", "step")


@query("P14_glue_columns", "SELECT event_id, value, event_type, round(value * 2, 6) AS twice FROM events")
def p14(spark, d):
    e = events(spark, d)
    return co.glue(e.select("event_id", "ts", "value", "event_type"), e.select("event_id", "ts", r(C("value") * 2).alias("twice")), ["event_id", "ts"]).drop("ts")


@query("P16_schema_routing", """WITH g AS (SELECT user_id, list(DISTINCT event_type) AS f FROM events WHERE value > 60 GROUP BY 1)
SELECT user_id, CASE WHEN list_has_all(f, ['click', 'error', 'view']) THEN 'first' WHEN list_has_all(f, ['purchase']) THEN 'second' ELSE 'rejected' END AS domain FROM g""")
def p16(spark, d):
    # keys of a map are event types: bounded
    g = events(spark, d).filter("value > 60").groupBy("user_id", "event_type").agg(F.max("value").alias("v"))
    g = g.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias("f"))
    return g.select("user_id", F.coalesce(co.route(C("f"), {"first": ["click", "error", "view"], "second": ["purchase"]}), F.lit("rejected")).alias("domain"))


# ---- joins --------------------------------------------------------------------------------------


@query("J01_star_join", """SELECT l_orderkey, l_linenumber, l_partkey, o_orderpriority, c_mktsegment, n_name, r_name FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey
LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def j01(spark, d):
    g = lambda x: table(spark, d, x)
    fact = g("lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    dims = [(g("orders").select("o_orderkey", "o_custkey", "o_orderpriority"), "l_orderkey", "o_orderkey"), (g("customer").select("c_custkey", "c_nationkey", "c_mktsegment"), "o_custkey", "c_custkey"),
            (g("nation"), "c_nationkey", "n_nationkey"), (g("region"), "n_regionkey", "r_regionkey")]
    return j.star_join(fact, dims).select("l_orderkey", "l_linenumber", "l_partkey", "o_orderpriority", "c_mktsegment", "n_name", "r_name")


@query("J02_one_to_one_join", f"WITH {TAGS_HOURLY}, v AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, count(*) AS n FROM events GROUP BY 1) SELECT hour, label, n FROM tags JOIN v USING (hour)")
def j02(spark, d):
    v = events(spark, d).groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return tags_hourly(spark, d).select("hour", "label").join(v, "hour")


@query("J02_duplicate_keys", "SELECT 'orders' AS side, o_orderdate AS day, count(*) AS copies FROM orders GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'lineitem', l_shipdate, count(*) FROM lineitem GROUP BY 2 HAVING count(*) > 1")
def j02d(spark, d):
    return j.duplicate_keys({"orders": table(spark, d, "orders").withColumnRenamed("o_orderdate", "day"), "lineitem": table(spark, d, "lineitem").withColumnRenamed("l_shipdate", "day")}, ["day"])


@query("J03_label_left_join", "SELECT lang, count(*) AS rows, count(*) FILTER (quality IS NULL) AS unlabelled FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def j03(spark, d):
    x = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    return x.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(C("quality").isNull(), 1)).alias("unlabelled"))


@query("J04_metadata_join", "SELECT p_partkey, coalesce(q.orders, 0)::BIGINT AS orders, p_brand FROM part LEFT JOIN (SELECT l_partkey, count(*) AS orders FROM lineitem GROUP BY 1) q ON p_partkey = l_partkey")
def j04(spark, d):
    q = table(spark, d, "lineitem").groupBy(C("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("orders"))
    return table(spark, d, "part").select("p_partkey", "p_brand").join(q, "p_partkey", "left").fillna(0, ["orders"])


def _label_r(spark, d, cond, tags):
    h = tags_hourly(spark, d).filter(cond)
    return c.label_correlation(h, tags, "label").select("feature", r("correlation").alias("r"))


def _label_r_sql(tags, cond):
    from tidewatch.checks.profile import corr_sql

    return " UNION ALL ".join(f"SELECT '{x}' AS feature, round({corr_sql(x, 'label')}, 6) + 0 AS r FROM tags WHERE {cond}" for x in tags)


@query("J05_full_outer", f"WITH {TAGS_HOURLY}, a AS ({_label_r_sql(['click', 'view'], 'day(hour) < 16')}), b AS ({_label_r_sql(['view', 'signup'], 'day(hour) >= 16')}) SELECT feature, a.r AS r_first, b.r AS r_second FROM a FULL JOIN b USING (feature)")
def j05(spark, d):
    a = _label_r(spark, d, F.dayofmonth("hour") < 16, ["click", "view"]).withColumnRenamed("r", "r_first")
    return a.join(_label_r(spark, d, F.dayofmonth("hour") >= 16, ["view", "signup"]).withColumnRenamed("r", "r_second"), "feature", "full")


@query("J06_lookup_default", "SELECT event_id, CASE event_type WHEN 'error' THEN 'fault' WHEN 'view' THEN 'read' ELSE 'other' END AS meaning FROM events")
def j06(spark, d):
    return j.lookup(events(spark, d).select("event_id", "event_type"), "event_type", {"error": "fault", "view": "read"}, "meaning", "other").select("event_id", "meaning")


@query("J11_key_differences", """SELECT o_orderkey AS k, 'missing' AS side FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT DISTINCT l_orderkey, 'extra' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)""")
def j11(spark, d):
    return j.key_differences(table(spark, d, "orders").select(C("o_orderkey").alias("k")), table(spark, d, "lineitem").select(C("l_orderkey").alias("k")), ["k"])


@query("J15_rows_per_parameter", "SELECT c_custkey, count(o_orderkey) AS rows FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def j15(spark, d):
    # facts are counted per key first, so a hot customer is one row in the join
    o = table(spark, d, "orders").groupBy(C("o_custkey").alias("c_custkey")).agg(F.count("o_orderkey").alias("rows"))
    return table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left").fillna(0, ["rows"])


PATHS = f"""aa AS (SELECT event_id, round(value * 0.1, 6) AS v FROM events WHERE event_type <> 'view'), bb AS (SELECT event_id, round(value * 0.1, 6) + CASE WHEN event_id % 7 = 0 THEN 0.5 ELSE 0 END AS v FROM events WHERE event_type <> 'click')"""


def _paths(spark, d):
    e = events(spark, d)
    v = F.round(C("value") * 0.1, 6)
    return (e.filter("event_type <> 'view'").select("event_id", v.alias("v")),
            e.filter("event_type <> 'click'").select("event_id", (v + F.when(C("event_id") % 7 == 0, 0.5).otherwise(0.0)).alias("v")))


@query("J16_aligned_comparison", f"WITH {PATHS} SELECT event_id, CASE WHEN bb.v IS NULL THEN 'left_only' WHEN aa.v IS NULL THEN 'right_only' ELSE 'both' END AS side, round(abs(aa.v - bb.v), 6) AS v_diff FROM aa FULL JOIN bb USING (event_id)")
def j16(spark, d):
    a, b = _paths(spark, d)
    return j.aligned_differences(a, b, ["event_id"], ["v"]).withColumn("v_diff", r("v_diff"))


@query("D16_prediction_equivalence", f"""WITH {PATHS}, f AS (SELECT aa.v AS x, bb.v AS y FROM aa FULL JOIN bb USING (event_id))
SELECT count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS matched_rows, count(*) FILTER (y IS NULL) AS left_only, count(*) FILTER (x IS NULL) AS right_only, count(*) FILTER (abs(x - y) > 1e-10) AS different_rows, round(max(abs(x - y)), 6) AS max_v_diff, false AS equivalent FROM f""")
def d16(spark, d):
    a, b = _paths(spark, d)
    return j.equivalence(a, b, ["event_id"], {"v": 1e-10}).withColumn("max_v_diff", r("max_v_diff"))


# Two replays of the same steps: the second has another time, step, actual or forecast in some rows.
RUNS = """ra AS (SELECT event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, value AS actual, value * 0.5 AS forecast FROM events),
rb AS (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN ts + INTERVAL 1 SECOND WHEN event_id % 50 = 1 THEN NULL ELSE ts END AS ts, step + (event_id % 60 = 0)::INT AS step,
 actual + CASE WHEN event_id % 70 = 0 THEN 1e-9 WHEN event_id % 70 = 1 THEN 1e-14 ELSE 0 END AS actual, forecast + CASE WHEN event_id % 80 = 0 THEN 1e-3 ELSE 0 END AS forecast FROM ra WHERE event_id % 90 <> 0)"""


@query("D16_replay_equivalence", f"""WITH {RUNS}, f AS (SELECT ra.event_id AS a, rb.event_id AS b, ra.ts IS DISTINCT FROM rb.ts AS t, ra.step IS DISTINCT FROM rb.step AS s, abs(ra.actual - rb.actual) > 1e-12 AS x,
 abs(ra.forecast - rb.forecast) > 1e-10 AS y FROM ra FULL JOIN rb USING (event_id))
SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS matched_rows, count(*) FILTER (b IS NULL) AS left_only, count(*) FILTER (a IS NULL) AS right_only,
 count(*) FILTER (b IS NOT NULL AND (t OR s OR x OR y)) AS different_rows, count(*) FILTER (b IS NOT NULL AND t) AS different_ts, count(*) FILTER (b IS NOT NULL AND s) AS different_step,
 count(*) FILTER (b IS NOT NULL AND x) AS different_actual, count(*) FILTER (b IS NOT NULL AND y) AS different_forecast, false AS equivalent FROM f""")
def d16_replay(spark, d):
    a = w.positions(events(spark, d), by_user(), "step").select("event_id", "ts", (C("step") + 1).alias("step"), C("value").alias("actual"), (C("value") * 0.5).alias("forecast"))
    i = C("event_id")
    b = a.filter(i % 90 != 0).select(
        "event_id", F.when(i % 50 == 0, C("ts") + F.expr("INTERVAL 1 SECOND")).when(i % 50 != 1, C("ts")).alias("ts"), (C("step") + (i % 60 == 0).cast("int")).alias("step"),
        (C("actual") + F.when(i % 70 == 0, 1e-9).when(i % 70 == 1, 1e-14).otherwise(0.0)).alias("actual"), (C("forecast") + F.when(i % 80 == 0, 1e-3).otherwise(0.0)).alias("forecast"))
    e = j.equivalence(a, b, ["event_id"], {"actual": 1e-12, "forecast": 1e-10}, exact=["ts", "step"])
    return e.drop("max_actual_diff", "max_forecast_diff")


# ---- sets, ranks and leaders ------------------------------------------------------------------


@query("U01_union_parts", "SELECT event_id, 'a' AS part FROM events WHERE value < 10 UNION ALL SELECT event_id, 'b' FROM events WHERE value >= 5")
def u01(spark, d):
    e = events(spark, d)
    return e.filter("value < 10").select("event_id", F.lit("a").alias("part")).unionByName(e.filter("value >= 5").select(F.lit("b").alias("part"), "event_id"))


@query("U02_set_difference", "(SELECT p_name AS v, 'left_only' AS side FROM part WHERE p_size < 10 EXCEPT SELECT p_name, 'left_only' FROM part WHERE p_brand = 'Brand#2') UNION ALL (SELECT p_name, 'right_only' FROM part WHERE p_brand = 'Brand#2' EXCEPT SELECT p_name, 'right_only' FROM part WHERE p_size < 10)")
def u02(spark, d):
    pt = table(spark, d, "part")
    return co.set_difference(pt.filter("p_size < 10").select(C("p_name").alias("v")), pt.filter("p_brand = 'Brand#2'").select(C("p_name").alias("v")))


@query("U04_ordered_distinct", "SELECT event_type, user_id, min(event_id) AS first_place FROM events GROUP BY 1, 2")
def u04(spark, d):
    return co.ordered_distinct(events(spark, d), ["event_type", "user_id"], "event_id")


@query("W16_rank_first", "SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS family_rank FROM part")
def w16(spark, d):
    return k.rank_first(table(spark, d, "part"), ["p_brand"], "p_retailprice", ["p_partkey"], "family_rank").select("p_partkey", "family_rank")


@query("W17_rank_min", "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS size_rank FROM part")
def w17(spark, d):
    return k.rank_min(table(spark, d, "part"), ["p_brand"], "p_size", "size_rank", descending=False).select("p_partkey", "size_rank")


@query("K01_latest_measurement", "SELECT * FROM events ORDER BY event_id DESC LIMIT 1")
def k01(spark, d):
    return k.latest(events(spark, d), [F.desc("event_id")])


@query("K02_latest_predictions", "SELECT event_id, ts, h AS horizon FROM events, (VALUES (2), (10), (30)) t(h) ORDER BY ts DESC, h LIMIT 3")
def k02(spark, d):
    x = sinks.prediction_rows(events(spark, d).select("event_id", "ts", "value"), ["event_id", "ts"], {2: "value", 10: "value", 30: "value"}, "m")
    return k.latest(x, [F.desc("ts"), F.asc("prediction_horizon_minutes")], 3).select("event_id", "ts", C("prediction_horizon_minutes").alias("horizon"))


@query("K03_recent_events", "SELECT event_id, ts, value FROM events WHERE event_type = 'error' AND user_id > 10 ORDER BY ts DESC, event_id DESC LIMIT 25")
def k03(spark, d):
    return t.scan(events(spark, d), ["event_id", "ts", "value"], [C("event_type") == "error", C("user_id") > 10], [F.desc("ts"), F.desc("event_id")], 25)


@query("K06_family_top_k", "SELECT p_brand, p_partkey, place FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_retailprice DESC, p_partkey)::INTEGER AS place FROM part) WHERE place <= 10")
def k06(spark, d):
    return k.top_k(table(spark, d, "part"), ["p_brand"], [F.desc("p_size"), F.desc("p_retailprice"), F.asc("p_partkey")], 10, "place").select("p_brand", "p_partkey", "place")


MODELS = "md AS (SELECT l_linestatus AS target, l_returnflag AS model, round(avg(abs(l_extendedprice - 1500 * l_quantity)), 3) AS mae, round(sqrt(avg((l_extendedprice - 1500 * l_quantity) ** 2)), 3) AS rmse FROM lineitem GROUP BY 1, 2)"


def _models(spark, d):
    li = table(spark, d, "lineitem").withColumn("guess", 1500 * C("l_quantity"))
    e = m.regression_errors(li, ["l_linestatus", "l_returnflag"], "l_extendedprice", "guess")
    return e.select(C("l_linestatus").alias("target"), C("l_returnflag").alias("model"), r("mae", 3).alias("mae"), r("rmse", 3).alias("rmse"))


@query("K07_best_model", f"WITH {MODELS} SELECT target, model, mae, rmse FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY rmse, mae, model) AS i FROM md) WHERE i = 1")
def k07(spark, d):
    return k.top_k(_models(spark, d), ["target"], [F.asc("rmse"), F.asc("mae"), F.asc("model")], 1)


@query("K08_closest_candidate", """WITH p AS (SELECT p_brand AS candidate, round(avg(p_retailprice), 4) AS price, round(stddev_pop(p_retailprice), 4) AS std, count(*) AS n FROM part GROUP BY 1),
x AS (SELECT *, CASE WHEN candidate = 'Brand#2' THEN 0.0 ELSE round(abs(price - (SELECT price FROM p WHERE candidate = 'Brand#2')), 4) END AS diff FROM p), y AS (SELECT * FROM x WHERE candidate <> 'Brand#2')
SELECT candidate, price, std, n, diff, rank() OVER (ORDER BY diff)::INTEGER AS closeness_rank, CASE WHEN row_number() OVER (ORDER BY diff, std, n, candidate) = 1 THEN 'SELECTED_COMPACT_REFERENCE' ELSE 'NOT_SELECTED' END AS selection_status FROM y
UNION ALL SELECT candidate, price, std, n, 0.0, 0, 'FULL_REFERENCE' FROM x WHERE candidate = 'Brand#2'""")
def k08(spark, d):
    x = table(spark, d, "part").groupBy(C("p_brand").alias("candidate")).agg(r(F.avg("p_retailprice"), 4).alias("price"), r(F.stddev_pop("p_retailprice"), 4).alias("std"), F.count(F.lit(1)).alias("n"))
    return k.closest_to_reference(x, "candidate", "Brand#2", "price", ["std", "n"]).withColumn("diff", r("abs_difference", 4)).drop("abs_difference")


@query("K11_best_calibrator", f"""WITH {PROB}, x AS (SELECT label, 'raw' AS method, y, p FROM prob UNION ALL SELECT label, 'half', y, 0.25 + p / 2 FROM prob), l AS (SELECT label, method, round(avg((p - y) ** 2), 6) AS brier,
round(avg(-CASE WHEN y = 1 THEN ln(least(greatest(p, 1e-7), 1 - 1e-7)) ELSE ln(1 - least(greatest(p, 1e-7), 1 - 1e-7)) END), 6) AS log_loss FROM x GROUP BY 1, 2)
SELECT label, method, brier, log_loss FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY brier, log_loss, method) AS i FROM l) WHERE i = 1""")
def k11(spark, d):
    q = probabilities(spark, d)
    x = q.withColumn("method", F.lit("raw")).unionByName(q.withColumn("p", 0.25 + C("p") / 2).withColumn("method", F.lit("half")))
    l = m.probability_losses(x, ["label", "method"], "y", "p").select("label", "method", r("brier").alias("brier"), r("log_loss").alias("log_loss"))
    return k.top_k(l, ["label"], [F.asc("brier"), F.asc("log_loss"), F.asc("method")], 1)


@query("K12_evenly_spaced", """WITH ps AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS position, count(*) OVER () AS n FROM events), g AS (SELECT DISTINCT (i * ((SELECT count(*) FROM events) - 1)) // 999 AS position FROM range(1000) t(i))
SELECT event_id, position FROM ps JOIN g USING (position)""")
def k12(spark, d):
    return k.evenly_spaced(events(spark, d).select("event_id", "ts"), one_stream(), 1000).select("event_id", "position")


# ---- remaining aggregates ----------------------------------------------------------------------


@query("G51_time_coverage", "SELECT event_type, count(*) AS rows, min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT ts) AS timestamps FROM events GROUP BY 1")
def g51(spark, d):
    return events(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count_distinct("ts").alias("timestamps"))


@query("G52_load_means", "WITH u AS (SELECT l_returnflag, unnest([struct_pack(load := 'l_quantity', v := l_quantity), struct_pack(load := 'l_extendedprice', v := l_extendedprice), struct_pack(load := 'l_discount', v := l_discount), struct_pack(load := 'l_tax', v := l_tax)], recursive := true) FROM lineitem) SELECT l_returnflag, load, round(avg(v), 4) AS mean FROM u GROUP BY 1, 2")
def g52(spark, d):
    from tidewatch.operators.quantiles import unpivot

    return unpivot(table(spark, d, "lineitem"), ["l_returnflag"], MEASURES, "load", "v").groupBy("l_returnflag", "load").agg(r(F.avg("v"), 4).alias("mean"))


@query("G53_tag_families", f"WITH {TAGS_HOURLY} SELECT hour, round(list_avg([click, view]), 6) AS pair_mean, round(list_sum([error, purchase, signup]), 6) AS family_sum FROM tags")
def g53(spark, d):
    return tags_hourly(spark, d).select("hour", r(fam.family_mean(["click", "view"])).alias("pair_mean"), r(fam.family_sum(["error", "purchase", "signup"])).alias("family_sum"))


@query("G53_map_families", "WITH mg AS (SELECT user_id, date_trunc('hour', ts)::TIMESTAMP AS hour, event_type, max(value) AS v FROM events GROUP BY 1, 2, 3) SELECT user_id, hour, round(sum(v) FILTER (event_type IN ('view', 'error', 'purchase') AND v BETWEEN 1 AND 100), 6) AS family_sum FROM mg GROUP BY 1, 2")
def g53m(spark, d):
    return _messages(spark, d).select("user_id", "hour", r(fam.map_family_sum(C("f"), "(?i)^(VIEW|err.*|pur.*)$")).alias("family_sum"))


@query("G54_interval_histogram", f"WITH {TAGS_HOURLY}, h AS (SELECT (epoch_us(hour) - lag(epoch_us(hour)) OVER (ORDER BY hour)) / 1e6 AS s FROM tags WHERE view IS NOT NULL) SELECT s AS interval_s, CASE WHEN s % 3600 = 0 THEN (s::BIGINT // 3600) || ' hour(s)' END AS text, count(*) AS rows FROM h WHERE s IS NOT NULL GROUP BY 1, 2")
def g54(spark, d):
    x = w.intervals(tags_hourly(spark, d).filter("view IS NOT NULL").select("hour"), Series([], ["hour"])).filter("interval_s IS NOT NULL")
    return x.groupBy("interval_s", tm.duration_text(C("interval_s")).alias("text")).agg(F.count(F.lit(1)).alias("rows"))


@query("J14_two_matrices", """WITH pr AS (SELECT *, l_extendedprice * (1 - l_discount) AS revenue FROM lineitem), a AS (SELECT corr(l_quantity, l_extendedprice) AS q, corr(l_extendedprice, revenue) AS e, corr(l_quantity, revenue) AS v FROM pr WHERE l_linestatus = 'O'),
b AS (SELECT corr(l_quantity, l_extendedprice) AS q, corr(l_extendedprice, revenue) AS e, corr(l_quantity, revenue) AS v FROM pr WHERE l_linestatus = 'F'),
u AS (SELECT 'l_quantity' AS feature_1, 'l_extendedprice' AS feature_2, a.q AS r_o, b.q AS r_f FROM a, b UNION ALL SELECT 'l_extendedprice', 'revenue', a.e, b.e FROM a, b UNION ALL SELECT 'l_quantity', 'revenue', a.v, b.v FROM a, b)
SELECT feature_1, feature_2, round(r_o, 6) AS r_o, round(r_f, 6) AS r_f FROM u WHERE abs(r_o) >= 0.95 OR abs(r_f) >= 0.95""")
def j14(spark, d):
    li = table(spark, d, "lineitem").withColumn("revenue", C("l_extendedprice") * (1 - C("l_discount")))
    cols = ["l_quantity", "l_extendedprice", "revenue"]
    one = lambda s, a: c.pearson_pairs(li.filter(C("l_linestatus") == s).select(*cols), cols).select("feature_1", "feature_2", r("correlation").alias(a))
    x = one("O", "r_o").join(one("F", "r_f"), ["feature_1", "feature_2"])
    return x.filter((F.abs("r_o") >= 0.95) | (F.abs("r_f") >= 0.95))


# ---- scalar functions ----------------------------------------------------------------------------


@query("F_text_functions", """SELECT p_partkey AS id, trim(regexp_replace(lower(p_name || ' #' || p_size), '[^a-z0-9]+', ' ', 'g')) AS words, replace(lower(p_name), ' ', '_') AS snake, p_name AS display,
least(p_name, p_type) || '~' || greatest(p_name, p_type) AS pair, p_brand || '+' || p_type AS codes FROM part""")
def f_text(spark, d):
    h = F.concat(F.upper("p_name"), F.lit("\n（t/h）"))
    return table(spark, d, "part").select(
        C("p_partkey").alias("id"), n.words(F.concat("p_name", F.lit(" #"), C("p_size").cast("string"))).alias("words"), n.snake(C("p_name")).alias("snake"), n.display_name(h).alias("display"),
        F.concat(F.least("p_name", "p_type"), F.lit("~"), F.greatest("p_name", "p_type")).alias("pair"), n.codes_text(n.codes_of(F.concat("p_brand", F.lit("+"), "p_type"))).alias("codes"))


@query("F_date_functions", """SELECT event_id, hour(ts)::INTEGER AS hour, minute(ts)::INTEGER AS minute, (isodow(ts) - 1)::INTEGER AS day_of_week, day(ts)::INTEGER AS day_of_month,
strptime('1900/' || strftime(ts, '%m/%d %H:%M:%S'), '%Y/%m/%d %H:%M:%S') AS yearless FROM events""")
def f_date(spark, d):
    e = w.calendar(events(spark, d).select("event_id", "ts"), "ts")
    return e.select("event_id", "hour", "minute", "day_of_week", "day_of_month", tm.yearless(F.date_format("ts", "MM/dd HH:mm:ss")).cast("timestamp_ntz").alias("yearless"))


@query("F_map_functions", "SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k, true AS has_k FROM events")
def f_map(spark, d):
    x = events(spark, d).withColumn("m", F.from_json("props", "MAP<STRING, STRING>"))
    return x.select("event_id", F.element_at("m", "k").try_cast("double").alias("k"), (F.size(F.array_except(F.array(F.lit("k")), F.map_keys("m"))) == 0).alias("has_k"))


# ---- contracts --------------------------------------------------------------------------------------


def checks_sql(body, **counts):
    rows = " UNION ALL ".join(f"SELECT '{k}' AS \"check\", ({v})::BIGINT AS violations" for k, v in counts.items())
    return f"WITH {body}, z AS ({rows}) SELECT *, violations = 0 AS passed FROM z"


# every check has something to find: broken values, targets and repeated rows are put in by expression
@query("D01_forecast_contract", checks_sql(f"""{LAGGED}, f AS (SELECT event_id, user_id, lg.ts, lg.value, CASE WHEN event_id % 89 = 0 THEN 'Infinity'::DOUBLE ELSE value_lag_10 END AS value_lag_10,
    CASE WHEN event_id % 97 = 0 THEN target_2 + 1 ELSE target_2 END AS target_2 FROM lg JOIN (SELECT event_id, user_id FROM events) USING (event_id)), g AS (SELECT * FROM f UNION ALL SELECT * FROM f WHERE event_id % 83 = 0),
    e AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dt FROM g)""",
    missing_timestamp="0", not_increasing="SELECT count(*) FROM e WHERE dt <= 0", null_values="SELECT count(*) FROM g WHERE value_lag_10 IS NULL OR target_2 IS NULL", infinite_values="SELECT count(*) FROM g WHERE isinf(value_lag_10)",
    non_numeric_columns="0", off_cadence="SELECT count(*) FROM e WHERE dt <> 120000000", row_count="SELECT count(*) FROM f WHERE event_id % 83 = 0", duplicate_rows="SELECT count(*) FROM f WHERE event_id % 83 = 0"))
def d01(spark, d):
    x = _faulty(spark, d)
    return ct.series_contract(x.unionByName(x.filter(C("event_id") % 83 == 0)), by_user(), ["value", "value_lag_10", "target_2"], 120.0, expected_rows=x.count(),
                              unique=x.columns)


def _faulty(spark, d):
    x = lagged(spark, d).select("event_id", "user_id", "ts", "value", "value_lag_10", "target_2")
    return x.withColumns({"value_lag_10": F.when(C("event_id") % 89 == 0, F.lit(float("inf"))).otherwise(C("value_lag_10")),
                          "target_2": F.when(C("event_id") % 97 == 0, C("target_2") + 1).otherwise(C("target_2"))})


@query("D01_target_alignment", checks_sql(f"""{LAGGED}, f AS (SELECT *, CASE WHEN event_id % 97 = 0 THEN target_2 + 1 ELSE target_2 END AS t FROM lg JOIN (SELECT event_id, user_id FROM events) USING (event_id)),
    o AS (SELECT t, lead(value, 1) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ahead FROM f)""", misaligned_target_2="SELECT count(*) FROM o WHERE t IS DISTINCT FROM ahead"))
def d01_alignment(spark, d):
    return ct.series_contract(_faulty(spark, d), by_user(), ["value"], aligned={"target_2": ("value", 1)}).filter("check = 'misaligned_target_2'")


@query("D02_label_contract", checks_sql(f"{TAGS_HOURLY}, h AS (SELECT *, epoch_us(hour) - lag(epoch_us(hour)) OVER (ORDER BY hour) AS dt FROM tags)", missing_timestamp="0", not_increasing="0",
    null_values="SELECT count(*) FROM h WHERE click IS NULL OR view IS NULL", infinite_values="0", non_numeric_columns="0", off_cadence="SELECT count(*) FROM h WHERE dt <> 3600000000", bad_label="0"))
def d02(spark, d):
    return ct.series_contract(tags_hourly(spark, d), Series([], ["hour"]), ["click", "view"], 3600.0, label="label", strict=False)


# the hourly labels with faults: a missing hour, infinite values, labels of 2, rows that repeat and hours that come twice
FAULTY_TAGS = f"""{TAGS_HOURLY}, holed AS (SELECT CASE WHEN hour(hour) = 3 AND day(hour) = 2 THEN NULL ELSE hour END AS hour, CASE WHEN hour(hour) = 5 THEN 'Infinity'::DOUBLE ELSE click END AS click, view,
 CASE WHEN hour(hour) = 7 THEN 2 ELSE label END AS label FROM tags),
faulty AS (SELECT * FROM holed UNION ALL SELECT * FROM holed WHERE hour(hour) = 9 UNION ALL SELECT hour, click, -1.0, label FROM holed WHERE hour(hour) = 11), stepped AS (SELECT *, epoch_us(hour) - lag(epoch_us(hour)) OVER (ORDER BY hour NULLS FIRST) AS dt FROM faulty)"""


@query("D02_faulty_labels", checks_sql(FAULTY_TAGS, missing_timestamp="SELECT count(*) FROM faulty WHERE hour IS NULL", not_increasing="SELECT count(*) FROM stepped WHERE dt <= 0",
    null_values="SELECT count(*) FROM faulty WHERE click IS NULL OR view IS NULL", infinite_values="SELECT count(*) FROM faulty WHERE click = 'Infinity'::DOUBLE", non_numeric_columns="0",
    off_cadence="SELECT count(*) FROM stepped WHERE dt <> 3600000000", bad_label="SELECT count(*) FROM faulty WHERE label NOT IN (0, 1)",
    duplicate_rows="SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM faulty)) FROM faulty",
    duplicate_time="SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT hour FROM faulty)) FROM faulty"))
def d02_faulty(spark, d):
    at = F.hour("hour")
    x = tags_hourly(spark, d).select(F.when((at == 3) & (F.dayofmonth("hour") == 2), None).otherwise(C("hour")).alias("hour"),
                                     F.when(at == 5, F.lit(float("inf"))).otherwise(C("click")).alias("click"), "view", F.when(at == 7, 2).otherwise(C("label")).alias("label"))
    x = x.unionByName(x.filter(at == 9)).unionByName(x.filter(at == 11).withColumn("view", F.lit(-1.0)))
    return ct.series_contract(x, Series([], ["hour"]), ["click", "view"], 3600.0, label="label", unique=x.columns, unique_time=True)


@query("D03_candidate_contract", checks_sql(f"{TAGS_HOURLY}", missing_columns="1", extra_columns="2", null_keys="0", null_values="SELECT count(*) FROM tags WHERE click IS NULL OR error IS NULL OR view IS NULL", infinite_values="0", bad_label="0", duplicate_keys="0"))
def d03(spark, d):
    return ct.candidate_contract(tags_hourly(spark, d), ["click", "error", "view", "absent"], ["hour"], "label")


@query("D04_file_contract", f"""WITH e AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS dt FROM events)
SELECT event_type, count(*) AS rows, 0::BIGINT AS null_values, 0::BIGINT AS infinite_values, count(*) FILTER (dt <= 0) AS not_increasing, count(*) FILTER (dt <> 1000000) AS off_cadence, count(*) FILTER (dt <= 0) + count(*) FILTER (dt <> 1000000) = 0 AS passed FROM e GROUP BY 1""")
def d04(spark, d):
    return ct.grouped_contract(events(spark, d), "event_type", Series(["event_type"], ["ts", "event_id"]), ["value"], 1.0)


@query("D05_model_ready_contract", """WITH s AS (SELECT CASE WHEN day(ts) < 16 THEN 'train' WHEN day(ts) < 22 THEN 'test1' ELSE 'test2' END AS dataset, * FROM events), e AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY dataset ORDER BY ts, event_id) AS dt FROM s)
SELECT dataset, count(*) AS rows, 0::BIGINT AS null_values, 0::BIGINT AS infinite_values, count(*) FILTER (dt <= 0) AS not_increasing, count(*) FILTER (dt <> 1000000) AS off_cadence, count(*) FILTER (dt <= 0) + count(*) FILTER (dt <> 1000000) = 0 AS passed FROM e GROUP BY 1""")
def d05(spark, d):
    x = events(spark, d).withColumn("dataset", F.when(F.dayofmonth("ts") < 16, "train").when(F.dayofmonth("ts") < 22, "test1").otherwise("test2"))
    return ct.grouped_contract(x, "dataset", Series(["dataset"], ["ts", "event_id"]), ["value"], 1.0)


@query("D06_record_contract", """SELECT event_id, (CASE WHEN event_id % 11 = 0 THEN 'bad_timestamp;' ELSE '' END) || (CASE WHEN event_type = 'error' THEN 'bad_value;' ELSE '' END) || (CASE WHEN user_id % 5 = 0 THEN 'blank_unit;' ELSE '' END) AS codes FROM events""")
def d06(spark, d):
    s = lambda x: F.lit(x)
    x = events(spark, d).select("event_id", F.when(C("event_id") % 11 == 0, "not a time").otherwise(C("ts").cast("string")).alias("timestamp"), F.when(C("event_type") == "error", "n/a").otherwise(C("value").cast("string")).alias("value"),
                               C("user_id").cast("string").alias("source_id"), s("p").alias("plant_id"), s("e").alias("equipment_id"), C("event_type").alias("parameter"), F.when(C("user_id") % 5 == 0, "  ").otherwise("MW").alias("unit"), s("GOOD").alias("quality"))
    v = ct.record_violations()
    return x.select("event_id", F.concat_ws("", F.transform(v, lambda y: F.concat(y, F.lit(";")))).alias("codes"))


def _messages(spark, d):
    """Feature map per user and hour: present event types and their mean values."""
    e = events(spark, d).groupBy("user_id", F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.max("value").alias("v"))
    text = F.when(C("v") > 100, "Infinity").when(C("v") < 1, "true").otherwise(C("v").cast("string"))
    # at most one entry per event type
    return e.groupBy("user_id", "hour").agg(F.map_from_entries(F.collect_list(F.struct("event_type", text.alias("t")))).alias("f"))


MSG = "mg AS (SELECT user_id, date_trunc('hour', ts)::TIMESTAMP AS hour, event_type, max(value) AS v FROM events GROUP BY 1, 2, 3), mm AS (SELECT user_id, hour, list(event_type ORDER BY event_type) AS f, bool_or(v < 1) AS nn, bool_or(v > 100) AS nf FROM mg GROUP BY 1, 2)"


@query("D07_message_contract", f"""WITH {MSG} SELECT user_id, hour, (CASE WHEN NOT list_has_all(f, ['click', 'view']) THEN 'missing_keys;' ELSE '' END) || (CASE WHEN NOT list_has_all(['click', 'view'], f) THEN 'extra_keys;' ELSE '' END) ||
(CASE WHEN nn THEN 'not_numeric;' ELSE '' END) || (CASE WHEN nf THEN 'not_finite;' ELSE '' END) AS codes FROM mm""")
def d07(spark, d):
    v = ct.message_violations(C("f"), ["click", "view"])
    return _messages(spark, d).select("user_id", "hour", F.concat_ws("", F.transform(v, lambda y: F.concat(y, F.lit(";")))).alias("codes"))


@query("D07_message_interval", f"""WITH {MSG}, iv AS (SELECT *, epoch_us(hour) - lag(epoch_us(hour)) OVER (PARTITION BY user_id ORDER BY hour) AS dt FROM mm)
SELECT user_id, hour, CASE WHEN dt <> 3600000000 THEN 'bad_interval' END AS code FROM iv""")
def d07_interval(spark, d):
    return ct.interval_violations(_messages(spark, d).select("user_id", "hour"), Series(["user_id"], ["hour"]), 3600.0).select("user_id", "hour", "code")


@query("D08_input_contract", checks_sql(f"{LAGGED}", missing_features="1", non_numeric="0", null_values="SELECT count(*) FROM lg WHERE value_lag_5 IS NULL", not_finite="0"))
def d08(spark, d):
    return ct.input_contract(lagged(spark, d), ["value", "value_lag_5", "absent"])


@query("D09_completeness", f"""WITH {MSG} SELECT user_id, hour, CASE WHEN list_has_all(f, ['click', 'view']) THEN 'READY' ELSE 'INCOMPLETE' END AS status, coalesce(list_aggregate(list_filter(['click', 'view'], lambda x: NOT list_contains(f, x)), 'string_agg', ';'), '') AS missing,
coalesce(list_aggregate(list_filter(f, lambda x: x NOT IN ('click', 'view')), 'string_agg', ';'), '') AS extra FROM mm""")
def d09(spark, d):
    return _messages(spark, d).select("user_id", "hour", *[v.alias(x) for x, v in ct.completeness(C("f"), ["click", "view"]).items()])


@query("D10_target_alignment", checks_sql(f"tt AS (SELECT event_id, user_id, lead(value) {U} AS a, lead(value, 5) {U} AS b FROM events)", target_2="0", shifted="SELECT count(*) FROM tt WHERE abs(a - b) > 1e-9 OR (a IS NULL) <> (b IS NULL)"))
def d10(spark, d):
    e = events(spark, d).select("user_id", "ts", "event_id", "value")
    x = w.row_leads(e, by_user(), "value", {"target_2": 1}).withColumn("shifted", C("target_2"))
    return ct.target_alignment(x, by_user(), "value", {"target_2": 1, "shifted": 5})


@query("D11_boundary_nulls", f"""WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) {U} > 21600000000 THEN 1 ELSE 0 END AS brk FROM events), q AS (SELECT *, sum(brk) {U} AS s FROM g), n AS (SELECT user_id, s, count(*) AS n FROM q GROUP BY 1, 2)
SELECT count(*) AS sequences, x.c AS column_name, sum(least(n, x.k))::BIGINT AS nulls, sum(least(n, x.k))::BIGINT AS expected, true AS passed FROM n, (VALUES ('value__diff', 1), ('value__std', 4)) x(c, k) GROUP BY x.c""")
def d11(spark, d):
    e = events(spark, d).select("user_id", "ts", "event_id", "value")
    x = w.temporal_features(e, by_user(), ["value"], 6 * 3600, kinds=("diff", "std"))
    x = w.sequence_ids(x, by_user(), 6 * 3600)
    return ct.boundary_nulls(x, ["user_id"], "sequence_id", {"value__diff": 1, "value__std": 4})


@query("D14_name_leakage", "SELECT p_partkey, p_name AS name, CASE WHEN p_name = 'red bolt' THEN 'is_target' ELSE 'target_token' END AS violation FROM part WHERE p_name = 'red bolt' OR contains(p_name, 'gear')")
def d14(spark, d):
    x = table(spark, d, "part").select("p_partkey", C("p_name").alias("name"))
    bad = ct.name_leakage(x.select("name").distinct(), "name", ["red bolt"], ["GEAR"])
    return x.join(bad, "name")
