"""Interval catalogue, labels, coverage, splits: attack branch on purchase intervals."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.checks.common import MEASURES, TAGS, by_user, events, one_stream, r
from tidewatch.checks.registry import query
from tidewatch.operators import contracts as ct, joins as j, labels as lb, splits as sp
from tidewatch.operators.series import Series
from tidewatch.operators.topk import argmax, best_labels, top_k
from tidewatch.sources.tables import table

C = F.col
LABELS = ["AP01", "AP02", "AP03", "AE01", "AE02", "AE99"]
# A purchase opens an interval of 5 minutes; its codes come from the payload number.
CAT = """cat AS (SELECT 'S' || event_id AS scenario_id, event_id AS place, ts AS start_ts, ts + INTERVAL 5 MINUTE AS end_ts,
 'AP0' || (1 + k % 3) || CASE WHEN k % 4 = 0 THEN '+AE0' || (1 + k // 4 % 2) ELSE '' END AS codes
 FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events WHERE event_type = 'purchase'))"""
POS = "pos AS (SELECT DISTINCT date_trunc('minute', ts)::TIMESTAMP AS minute FROM events WHERE event_type IN ('error', 'purchase'))"
OWN = """mins AS (SELECT cat.*, unnest(generate_series(date_trunc('minute', start_ts), date_trunc('minute', end_ts), INTERVAL 1 MINUTE))::TIMESTAMP AS minute FROM cat),
own AS (SELECT minute, arg_max(scenario_id, place) AS scenario_id, arg_max(codes, place) AS codes FROM mins WHERE minute IN (SELECT minute FROM pos) GROUP BY 1)"""
TAGGED = f"""{CAT}, {POS}, {OWN}, tagged AS (SELECT e.event_id, e.user_id, e.ts, e.value, e.event_type, CAST(json_extract(e.props, '$.k') AS INTEGER) AS k, own.scenario_id, own.codes,
 (own.scenario_id IS NOT NULL)::INTEGER AS attack FROM events e LEFT JOIN own ON date_trunc('minute', e.ts) = own.minute)"""


def catalogue(spark, d):
    e = events(spark, d).filter(C("event_type") == "purchase")
    k = F.get_json_object("props", "$.k").cast("int")
    ap = F.concat(F.lit("AP0"), (k % 3 + 1).cast("string"))
    codes = F.when(k % 4 == 0, F.concat(ap, F.lit("+AE0"), (F.floor(k / 4) % 2 + 1).cast("string"))).otherwise(ap)
    return e.select(F.concat(F.lit("S"), C("event_id").cast("string")).alias("scenario_id"), C("event_id").alias("place"),
                    C("ts").alias("start_ts"), (C("ts") + F.expr("INTERVAL 5 MINUTES")).alias("end_ts"), codes.alias("codes"))


def positive_minutes(spark, d):
    e = events(spark, d).filter(C("event_type").isin("error", "purchase"))
    return e.select(F.date_trunc("minute", "ts").alias("minute")).distinct()


def owners(spark, d, overrides=None):
    return j.minute_tags(catalogue(spark, d), positive_minutes(spark, d), "place", "start_ts", "end_ts", overrides)


def tagged(spark, d):
    e = events(spark, d).withColumn("k", F.get_json_object("props", "$.k").cast("int")).drop("props")
    t = j.tag_rows(e, "ts", owners(spark, d).select("minute", "scenario_id", "codes"))
    return t.withColumn("attack", C("scenario_id").isNotNull().cast("int"))


@query("J07_interval_join", """WITH p AS (SELECT event_id AS scenario, user_id, ts AS s, ts + INTERVAL 12 HOUR AS e FROM events WHERE event_type = 'purchase')
SELECT ev.event_id, p.scenario FROM events ev JOIN p ON ev.user_id = p.user_id AND ev.ts BETWEEN p.s AND p.e""")
def j07(spark, d):
    e = events(spark, d)
    p = e.filter(C("event_type") == "purchase").select(C("event_id").alias("scenario"), "user_id", C("ts").alias("s"), (C("ts") + F.expr("INTERVAL 12 HOURS")).alias("e"))
    return j.interval_join(e.select("event_id", "user_id", "ts"), p, "ts", "s", "e", ["user_id"], 12 * 3600).select("event_id", "scenario")


@query("J07_interval_hits", f"""WITH {CAT} SELECT scenario_id, start_ts, end_ts, (SELECT count(*) FROM events e WHERE e.ts BETWEEN start_ts AND end_ts) AS rows FROM cat""")
def j07_hits(spark, d):
    return j.interval_hits(events(spark, d).select("event_id", "ts"), catalogue(spark, d), "scenario_id", "ts", "start_ts", "end_ts")


@query("J08_interval_vs_minutes", f"""WITH {CAT}, {POS}, m AS (SELECT scenario_id, unnest(generate_series(date_trunc('minute', start_ts), date_trunc('minute', end_ts - INTERVAL 1 SECOND), INTERVAL 1 MINUTE))::TIMESTAMP AS minute FROM cat)
SELECT scenario_id, count(*) AS minutes, count(pos.minute) AS positive FROM m LEFT JOIN pos USING (minute) GROUP BY 1""")
def j08(spark, d):
    cat = catalogue(spark, d).withColumn("end_ts", C("end_ts") - F.expr("INTERVAL 1 SECOND"))
    m = j.interval_minutes(cat.select("scenario_id", "start_ts", "end_ts"), "start_ts", "end_ts")
    x = m.join(positive_minutes(spark, d).withColumn("hit", F.lit(1)), "minute", "left")
    return x.groupBy("scenario_id").agg(F.count(F.lit(1)).alias("minutes"), F.count("hit").alias("positive"))


@query("J09_minute_owner", f"WITH {TAGGED} SELECT event_id, coalesce(scenario_id, 'NORMAL') AS scenario_id, coalesce(codes, 'NORMAL') AS codes, attack FROM tagged")
def j09(spark, d):
    return tagged(spark, d).select("event_id", F.coalesce("scenario_id", F.lit("NORMAL")).alias("scenario_id"), F.coalesce("codes", F.lit("NORMAL")).alias("codes"), "attack")


@query("J10_minute_override", f"""WITH {CAT}, {POS}, {OWN}, ov AS (SELECT date_trunc('minute', ts)::TIMESTAMP AS minute, 'S' || min(event_id) AS scenario_id FROM events WHERE event_type = 'signup' GROUP BY 1),
o AS (SELECT minute, scenario_id FROM ov UNION ALL SELECT minute, scenario_id FROM own WHERE minute NOT IN (SELECT minute FROM ov))
SELECT e.event_id, coalesce(o.scenario_id, 'NORMAL') AS scenario_id FROM events e LEFT JOIN o ON date_trunc('minute', e.ts) = o.minute""")
def j10(spark, d):
    e = events(spark, d)
    ov = e.filter(C("event_type") == "signup").groupBy(F.date_trunc("minute", "ts").alias("minute")).agg(F.min("event_id").alias("place"))
    ov = ov.select("minute", F.concat(F.lit("S"), C("place").cast("string")).alias("scenario_id"), "place", F.lit("X").alias("codes"))
    t = j.tag_rows(e.select("event_id", "ts"), "ts", owners(spark, d, ov).select("minute", "scenario_id"))
    return t.select("event_id", F.coalesce("scenario_id", F.lit("NORMAL")).alias("scenario_id"))


@query("J17_uncovered_minutes", f"WITH {CAT}, {POS}, {OWN} SELECT minute FROM pos WHERE minute NOT IN (SELECT minute FROM mins)")
def j17(spark, d):
    return j.uncovered_minutes(positive_minutes(spark, d), catalogue(spark, d), "start_ts", "end_ts")


@query("G21_minute_label", "SELECT date_trunc('minute', ts)::TIMESTAMP AS minute, max((event_type = 'error')::INTEGER) AS label FROM events GROUP BY 1")
def g21(spark, d):
    return lb.minute_label(events(spark, d).withColumn("label", (C("event_type") == "error").cast("int")), "ts", "label")


@query("G22_stamp_repetition", """WITH s AS (SELECT date_trunc('minute', ts)::TIMESTAMP AS stamp, (event_type = 'error')::INTEGER AS label FROM events),
t AS (SELECT stamp, count(*) AS rows, count(DISTINCT label) AS n FROM s GROUP BY 1) SELECT rows, count(*) AS timestamps, count(*) FILTER (n > 1) AS mixed FROM t GROUP BY 1""")
def g22(spark, d):
    e = events(spark, d).select(F.date_trunc("minute", "ts").alias("stamp"), (C("event_type") == "error").cast("int").alias("label"))
    return lb.repetition_histogram(lb.stamp_repetition(e, "stamp", "label"))


@query("G23_odd_buckets", "SELECT date_trunc('hour', ts)::TIMESTAMP AS bucket, count(*) AS rows FROM events GROUP BY 1 HAVING count(*) <> 14")
def g23(spark, d):
    return lb.odd_buckets(events(spark, d), "ts", "hour", 14)


@query("G24_scenario_blocks", f"""WITH {TAGGED} SELECT scenario_id, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS rows, arg_min(codes, ts) AS codes, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS duration_s
FROM tagged WHERE scenario_id IS NOT NULL GROUP BY 1""")
def g24(spark, d):
    return lb.scenario_blocks(tagged(spark, d), "scenario_id", "ts", "codes")


@query("G25_class_distribution", f"WITH {TAGGED} SELECT attack, event_type, count(*) AS rows, round(100.0 * count(*) / (SELECT count(*) FROM tagged), 6) AS pct FROM tagged GROUP BY 1, 2")
def g25(spark, d):
    x = lb.distribution(tagged(spark, d), ["attack", "event_type"])
    return x.withColumn("pct", r("pct"))


def multilabel(spark, d):
    t = tagged(spark, d)
    t = t.withColumn("code_list", F.split(F.coalesce("codes", F.lit("")), r"\+"))
    t = lb.label_matrix(t, C("code_list"), LABELS)
    return t.withColumn("split", F.when(F.dayofmonth("ts") <= 18, "train").when(F.dayofmonth("ts") <= 24, "validation").otherwise("test"))


ML = TAGGED + ", ml AS (SELECT *, CASE WHEN day(ts) <= 18 THEN 'train' WHEN day(ts) <= 24 THEN 'validation' ELSE 'test' END AS split, " + ", ".join(
    f"coalesce(list_contains(string_split(codes, '+'), '{x}'), false)::INTEGER AS {x}" for x in LABELS) + " FROM tagged)"


@query("P02_label_matrix", f"WITH {ML} SELECT event_id, {', '.join(LABELS)} FROM ml")
def label_matrix(spark, d):
    from tidewatch.operators.columns import matching

    m = multilabel(spark, d)
    return m.select("event_id", *matching(m, prefixes=("AP", "AE")))


@query("G26_label_cardinality", f"WITH {ML} SELECT {' + '.join(LABELS)} AS labels_per_row, count(*) AS rows FROM ml GROUP BY 1")
def g26(spark, d):
    return lb.cardinality(multilabel(spark, d), LABELS)


@query("G27_label_coverage", f"WITH {ML}, u AS (" + " UNION ALL ".join(f"SELECT '{x}' AS label, " + ", ".join(
    f"coalesce(sum({x}) FILTER (split = '{s}'), 0)::BIGINT AS {s}" for s in ("train", "validation", "test")) + " FROM ml" for x in LABELS) +
    """) SELECT *, CASE WHEN train > 0 AND greatest(validation, test) > 0 THEN 'common' WHEN train > 0 THEN 'train_only' WHEN greatest(validation, test) > 0 THEN 'unseen_in_train' ELSE 'absent' END AS status FROM u""")
def g27(spark, d):
    return lb.coverage(multilabel(spark, d), "split", ["train", "validation", "test"], LABELS)


# Customers stand for scenarios, the order priorities of their orders for codes.
INC = """cs AS (SELECT DISTINCT o_custkey AS scenario, o_orderpriority || o_orderstatus || (o_orderkey % 500) AS code FROM orders), fq AS (SELECT code, count(*) AS scenarios FROM cs GROUP BY 1)"""


def incid(spark, d):
    o = table(spark, d, "orders")
    code = F.concat("o_orderpriority", "o_orderstatus", (C("o_orderkey") % 500).cast("string"))
    return lb.incidence(o.select(C("o_custkey").alias("scenario"), code.alias("code")), "scenario", "code")


@query("G28_code_incidence", f"WITH {INC} SELECT scenario, code, scenarios FROM cs JOIN fq USING (code)")
def g28(spark, d):
    return incid(spark, d)


@query("G28_mandatory_scenarios", f"WITH {INC} SELECT scenario, count(*) AS unique_codes FROM cs JOIN fq USING (code) WHERE scenarios = 1 GROUP BY 1")
def g28m(spark, d):
    return lb.mandatory_scenarios(incid(spark, d), "scenario")


@query("G29_holdout_eligible", f"WITH {INC} SELECT scenario, min(scenarios) AS rarest, count(*) AS codes FROM cs JOIN fq USING (code) GROUP BY 1 HAVING min(scenarios) >= 2")
def g29(spark, d):
    return lb.holdout_eligible(incid(spark, d), "scenario")


# Label scores of a row, from its payload and value.
SC = ["pa", "pb", "pc"]
SCORES = f"{TAGGED}, sc AS (SELECT *, k / 100.0::DOUBLE AS pa, 1 - k / 100.0::DOUBLE AS pb, round(least(value, 100) / 100, 4) AS pc FROM tagged), am AS (SELECT *, greatest(pa, pb, pc) AS top, CASE WHEN pa = greatest(pa, pb, pc) THEN 'pa' WHEN pb = greatest(pa, pb, pc) THEN 'pb' ELSE 'pc' END AS lab FROM sc)"


def scores(spark, d):
    t = tagged(spark, d).withColumns({"pa": C("k") / F.lit(100.0), "pb": 1 - C("k") / F.lit(100.0), "pc": F.round(F.least("value", F.lit(100.0)) / 100, 4)})
    best = argmax({x: C(x) for x in SC})
    return t.withColumn("_b", best).withColumns({"lab": C("_b.label"), "top": C("_b.score")}).drop("_b")


@query("K13_top_label", f"WITH {SCORES} SELECT event_id, lab, round(top, 6) AS top FROM am")
def k13(spark, d):
    return scores(spark, d).select("event_id", "lab", r("top").alias("top"))


FIVE = {"p0": "pa", "p1": "pb", "p2": "pc", "p3": "round(pa * pc, 6)", "p4": "pa", "p5": "round(1 - pc, 4)", "p6": "CASE WHEN k > 50 THEN pc END"}


@query("K13_top_five", f"""WITH {SCORES}, f AS ({" UNION ALL ".join(f"SELECT event_id, {i} AS o, '{x}' AS label, {e} AS score FROM sc" for i, (x, e) in enumerate(FIVE.items()))}),
k AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY score DESC, o)::INTEGER AS rank FROM f WHERE score IS NOT NULL)
SELECT event_id, rank, label, round(score, 6) AS score FROM k WHERE rank <= 5""")
def k13_five(spark, d):
    pa, pb, pc = (C(x) for x in SC)
    found = {"p0": pa, "p1": pb, "p2": pc, "p3": F.round(pa * pc, 6), "p4": pa, "p5": F.round(1 - pc, 4), "p6": F.when(C("k") > 50, pc)}
    x = scores(spark, d).select("event_id", F.inline(best_labels(found)))
    return x.withColumn("score", r("score"))


@query("K14_confident_normals", f"WITH {SCORES} SELECT event_id, lab, round(top, 6) AS top FROM am WHERE attack = 0 AND top >= 0.9")
def k14(spark, d):
    return scores(spark, d).filter((C("attack") == 0) & (C("top") >= 0.9)).select("event_id", "lab", r("top").alias("top"))


@query("G50_scenario_diagnostics", f"""WITH {SCORES}, n AS (SELECT scenario_id, lab, count(*) AS n, min(event_id) AS f FROM am WHERE attack = 1 GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER (PARTITION BY scenario_id) AS s, row_number() OVER (PARTITION BY scenario_id ORDER BY n DESC, f) AS k FROM n),
q AS (SELECT scenario_id, round(avg(top), 6) AS mean_max_score, round(max(top), 6) AS max_score, round(quantile_cont(top, 0.5), 6) AS median_max_score FROM am WHERE attack = 1 GROUP BY 1)
SELECT scenario_id, s::BIGINT AS rows, lab AS top_label, round(n / s, 6) AS top_share, mean_max_score, max_score, median_max_score FROM t JOIN q USING (scenario_id) WHERE k = 1""")
def g50(spark, d):
    x = lb.top_label_per_scenario(scores(spark, d).filter("attack = 1"), "scenario_id", "lab", "top", "event_id")
    return x.withColumns({c: r(c) for c in ("top_share", "mean_max_score", "max_score", "median_max_score")})


@query("K09_top_labels", f"""WITH {SCORES}, m AS (SELECT scenario_id, codes, label, round(avg(p), 6) AS p FROM (SELECT scenario_id, codes, 'pa' AS label, pa AS p FROM sc WHERE attack = 1 UNION ALL SELECT scenario_id, codes, 'pb', pb FROM sc WHERE attack = 1
 UNION ALL SELECT scenario_id, codes, 'pc', pc FROM sc WHERE attack = 1) GROUP BY 1, 2, 3), k AS (SELECT *, row_number() OVER (PARTITION BY scenario_id ORDER BY p DESC, label)::INTEGER AS place FROM m)
SELECT scenario_id, label, p, place, (label = 'pa' AND codes LIKE '%AP01%') OR (label = 'pb' AND codes LIKE '%AP02%') OR (label = 'pc' AND codes LIKE '%AP03%') AS hit FROM k WHERE place <= 3""")
def k09(spark, d):
    t = scores(spark, d).filter("attack = 1").unpivot(["scenario_id", "codes"], SC, "label", "p")
    m = t.groupBy("scenario_id", "codes", "label").agg(r(F.avg("p")).alias("p"))
    code = F.when(C("label") == "pa", "AP01").when(C("label") == "pb", "AP02").otherwise("AP03")
    return top_k(m, ["scenario_id"], [F.desc("p"), F.asc("label")], 3, "place").select("scenario_id", "label", "p", "place", F.contains("codes", code).alias("hit"))


# ---- splits ------------------------------------------------------------------------------

POSITION = "ps AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos, count(*) OVER () AS n FROM events)"


@query("L01_chronological_holdout", f"WITH {POSITION} SELECT event_id, CASE WHEN pos < floor(n * 0.8) THEN 'train' ELSE 'test' END AS split FROM ps")
def l01(spark, d):
    return sp.positional_split(events(spark, d).select("ts", "event_id"), one_stream(), 0.8).select("event_id", "split")


@query("L02_expanding_folds", f"""WITH {POSITION}, f AS (SELECT * FROM (VALUES (1, 0.6, 0.8), (2, 0.7, 0.9), (3, 0.8, 1.0)) t(fold, a, b)),
x AS (SELECT event_id, fold, CASE WHEN pos < floor(n * a::DOUBLE) THEN 'train' WHEN pos < floor(n * b::DOUBLE) THEN 'test' END AS role FROM ps, f) SELECT * FROM x WHERE role IS NOT NULL""")
def l02(spark, d):
    return sp.expanding_folds(events(spark, d).select("ts", "event_id"), one_stream()).select("event_id", "fold", "role")


ELAPSED = f"""{TAGGED}, b AS (SELECT min(epoch_us(ts)) AS a, max(epoch_us(ts)) - min(epoch_us(ts)) AS t FROM events),
el AS (SELECT tagged.*, CASE WHEN epoch_us(ts) - a < t * 0.6::DOUBLE THEN 'train' WHEN epoch_us(ts) - a < t * 0.8::DOUBLE THEN 'validation' ELSE 'test' END AS split FROM tagged, b)"""


@query("L03_elapsed_split", f"WITH {ELAPSED} SELECT event_id, split FROM el")
def l03(spark, d):
    return sp.elapsed_split(events(spark, d).select("event_id", "ts"), "ts").select("event_id", "split")


@query("L03_crossing_users", f"""WITH {ELAPSED}, g AS (SELECT user_id, split, count(*) AS n FROM el GROUP BY 1, 2) SELECT user_id, count(*) AS splits, sum(n)::BIGINT AS rows FROM g GROUP BY 1 HAVING count(*) > 1""")
def l03c(spark, d):
    return sp.crossing_groups(sp.elapsed_split(events(spark, d), "ts"), "user_id")


CUTS, PARTS = ["2024-01-15 00:00:00", "2024-01-22 12:00:00"], ["train", "validation", "test"]


@query("L04_timestamp_split", f"SELECT event_id, CASE WHEN ts < TIMESTAMP '{CUTS[0]}' THEN 'train' WHEN ts < TIMESTAMP '{CUTS[1]}' THEN 'validation' ELSE 'test' END AS split FROM events")
def l04(spark, d):
    return sp.timestamp_split(events(spark, d), "ts", CUTS, PARTS).select("event_id", "split")


@query("U03_split_overlap", f"""WITH s AS (SELECT user_id, CASE WHEN ts < TIMESTAMP '{CUTS[0]}' THEN 'train' WHEN ts < TIMESTAMP '{CUTS[1]}' THEN 'validation' ELSE 'test' END AS split FROM events)
SELECT user_id, count(DISTINCT split) AS parts FROM s GROUP BY 1 HAVING count(DISTINCT split) > 1""")
def u03(spark, d):
    s = sp.timestamp_split(events(spark, d), "ts", CUTS, PARTS)
    return sp.overlap({p: s.filter(C("split") == p) for p in PARTS}, ["user_id"])


# Episodes here: what a user does in an hour of errors; scenario = user and hour.
EPI = """ep AS (SELECT event_id, ts, user_id, value, 'E' || (user_id % 40) AS ep_id, date_trunc('minute', ts)::TIMESTAMP AS m, event_type = 'error' AS is_ep FROM events)"""


def episodes(spark, d):
    e = events(spark, d)
    return e.select("event_id", "ts", F.when(C("event_type") == "error", F.concat(F.lit("E"), (C("user_id") % 40).cast("string"))).alias("scenario"))


@query("L05_scenario_holdout", f"""WITH {EPI}, sp AS (SELECT min(ts) AS a, max(ts) AS b FROM ep WHERE is_ep AND ep_id IN ('E3', 'E7'))
SELECT event_id, CASE WHEN (is_ep AND ep_id IN ('E3', 'E7')) OR (NOT is_ep AND ts BETWEEN a AND b) THEN 'evaluation' ELSE 'train' END AS split FROM ep, sp""")
def l05(spark, d):
    return sp.holdout_by_scenario(episodes(spark, d), "ts", "scenario", C("scenario").isNull(), ["E3", "E7"]).select("event_id", "split")


HELD = f"""{TAGGED}, hs AS (SELECT scenario_id, min(ts) AS a, max(ts) AS b FROM tagged WHERE codes LIKE '%AE02%' GROUP BY 1)"""
GUARD = f"""WITH {HELD}, nr AS (SELECT DISTINCT event_id FROM tagged, hs WHERE attack = 0 AND ts BETWEEN a - INTERVAL 5 MINUTE AND b + INTERVAL 5 MINUTE)
SELECT event_id, CASE WHEN scenario_id IN (SELECT scenario_id FROM hs) OR event_id IN (SELECT event_id FROM nr) THEN 'evaluation' ELSE 'train' END AS split FROM tagged"""


def guard(spark, d):
    t = tagged(spark, d)
    held = t.filter(C("codes").contains("AE02")).groupBy("scenario_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return j.guard_split(t.select("event_id", "ts", "scenario_id", "attack"), "ts", held, "a", "b", 5, C("attack") == 0, "scenario_id", "scenario_id")


@query("J12_guard_window_rows", f"WITH x AS ({GUARD}) SELECT split, count(*) AS rows FROM x GROUP BY 1")
def j12(spark, d):
    return guard(spark, d).groupBy("split").agg(F.count(F.lit(1)).alias("rows"))


@query("L06_guarded_holdout", GUARD)
def l06(spark, d):
    return guard(spark, d).select("event_id", "split")


@query("L07_subset_split", f"WITH {EPI} SELECT event_id, CASE WHEN is_ep AND ep_id IN ('E1', 'E2', 'E5') THEN 'calibration' ELSE 'train' END AS split FROM ep")
def l07(spark, d):
    return sp.subset_split(episodes(spark, d), "scenario", ["E1", "E2", "E5"]).select("event_id", "split")


MIN_RANK = f"""{EPI}, mm AS (SELECT DISTINCT ep_id, m FROM ep WHERE is_ep), mr AS (SELECT *, row_number() OVER (PARTITION BY ep_id ORDER BY m) AS i, count(*) OVER (PARTITION BY ep_id) AS k FROM mm),
nn AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos, count(*) OVER () AS n FROM ep WHERE NOT is_ep)"""


@query("L08_last_minute_split", f"""WITH {MIN_RANK} SELECT event_id, CASE WHEN k < 2 THEN 'too_short' WHEN i = k THEN 'calibration' WHEN k >= 3 AND i = k - 1 THEN 'guard' ELSE 'train' END AS split FROM ep JOIN mr USING (ep_id, m) WHERE is_ep
UNION ALL SELECT event_id, CASE WHEN pos < floor(n * 0.8) THEN 'train' ELSE 'calibration' END FROM nn""")
def l08(spark, d):
    return sp.last_minute_split(episodes(spark, d), one_stream(), "ts", "scenario", C("scenario").isNotNull()).select("event_id", "split")


@query("L09_half_guard_split", f"""WITH {MIN_RANK}, q AS (SELECT event_id, i, k, least(greatest(1, k // 2), k - 2) AS fit FROM ep JOIN mr USING (ep_id, m) WHERE is_ep)
SELECT event_id, CASE WHEN k < 2 THEN 'too_short' WHEN k = 2 THEN CASE WHEN i = 1 THEN 'fit' ELSE 'validation' END WHEN i <= fit THEN 'fit' WHEN i = fit + 1 THEN 'guard' ELSE 'validation' END AS split FROM q
UNION ALL SELECT event_id, CASE WHEN pos < floor(n * 0.5) THEN 'fit' ELSE 'validation' END FROM nn""")
def l09(spark, d):
    return sp.half_guard_split(episodes(spark, d), one_stream(), "ts", "scenario", C("scenario").isNotNull()).select("event_id", "split")


@query("L10_calibration_positions", f"WITH {POSITION} SELECT event_id, CASE WHEN pos < floor(n * 0.6) THEN 'fit' ELSE 'validation' END AS split FROM ps")
def l10(spark, d):
    return sp.positional_split(events(spark, d).select("ts", "event_id"), one_stream(), 0.6, ("fit", "validation")).select("event_id", "split")


# ---- contracts on the targets ----------------------------------------------------------------

@query("D12_target_consistency", f"""WITH {TAGGED}, hv AS (SELECT DISTINCT date_trunc('minute', ts)::TIMESTAMP AS minute FROM tagged WHERE attack = 1), x AS (
SELECT 'positive_minutes_lost' AS "check", (SELECT count(*) FROM pos WHERE minute NOT IN (SELECT minute FROM hv)) AS violations UNION ALL SELECT 'minutes_added', (SELECT count(*) FROM hv WHERE minute NOT IN (SELECT minute FROM pos))
UNION ALL SELECT 'codes_differ', 0 UNION ALL SELECT 'normal_with_scenario', 0 UNION ALL SELECT 'odd_minutes', (SELECT count(*) FROM (SELECT count(*) AS n FROM tagged WHERE attack = 1 GROUP BY date_trunc('minute', ts)) WHERE n <> 60)) SELECT *, violations = 0 AS passed FROM x""")
def d12(spark, d):
    return ct.target_consistency(tagged(spark, d), "ts", "scenario_id", "attack", positive_minutes(spark, d), catalogue(spark, d), "codes", rows_per_minute=60)


@query("D13_multilabel_consistency", f"""WITH {ML}, x AS (SELECT attack, {' + '.join(LABELS)} AS n, coalesce(len(string_split(codes, '+')), 0) AS c FROM ml), y AS (
SELECT 'normal_with_label' AS "check", count(*) FILTER (attack = 0 AND n <> 0) AS violations FROM x UNION ALL SELECT 'attack_without_label', count(*) FILTER (attack = 1 AND n < 1) FROM x
UNION ALL SELECT 'label_code_mismatch', count(*) FILTER (attack = 1 AND n <> c) FROM x) SELECT *, violations = 0 AS passed FROM y""")
def d13(spark, d):
    return ct.multilabel_consistency(multilabel(spark, d), C("attack") == 1, LABELS, C("code_list"))


@query("D15_dataset_audit", f"""WITH {TAGGED} SELECT * FROM (SELECT 'rows' AS measure, count(*) AS value FROM tagged UNION ALL SELECT 'attack_rows', sum(attack)::BIGINT FROM tagged UNION ALL SELECT 'normal_rows', count(*) - sum(attack)::BIGINT FROM tagged
UNION ALL SELECT 'scenarios', count(DISTINCT scenario_id) FROM tagged UNION ALL SELECT 'missing_timestamps', 0 UNION ALL SELECT 'constant_features', 0 UNION ALL SELECT 'duplicate_keys', count(*) - count(DISTINCT event_id) FROM tagged)""")
def d15(spark, d):
    return ct.dataset_audit(tagged(spark, d), "ts", ["event_id"], "attack", "scenario_id", ["value", "k"])
