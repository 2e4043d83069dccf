from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.checks.common import MEASURES, by_user, events, r
from tidewatch.checks.profile import TALL, measures, STEADY
from tidewatch.checks.registry import query
from tidewatch.checks.windows import U
from tidewatch.functions import names as n, rules as ru
from tidewatch.operators import profile as p, windows as w
from tidewatch.operators.joins import lookup
from tidewatch.operators.quantiles import unpivot
from tidewatch.operators.topk import category_order
from tidewatch.sources.tables import small_table, table

ROLES = ["Process Measurement", "Setpoint", "Status / Switch", "Control / Assignment", "Equipment Condition", "Vibration / Equipment Condition",
         "Equipment / Pump Signal", "Derived / Calculated", "Requires Documentation", "Valve Position Command", "Valve Current Position",
         "Measured Flowrate", "Converted Flowrate", "Process Threshold", "Controller Output", "Output Power", "Electrical Load Demand",
         "Total Electrical Load Demand", "Scheduled Power Demand", "Frequency Deviation", "Internal Control-Logic Output"]
LIST = "[" + ", ".join(f"'{x}'" for x in ROLES) + "]"
# Parts stand for features: a role, a second role, two correlations and three distinct counts each.
FEATS = f"""f AS (SELECT p_partkey AS id, {LIST}[p_size % 21 + 1] AS role, {LIST}[p_partkey % 21 + 1] AS role_2,
CASE WHEN p_size % 10 = 3 THEN NULL ELSE ((p_partkey * 37) % 401 - 200) / 200.0 END AS r1, CASE WHEN p_size % 7 = 3 THEN NULL ELSE ((p_partkey * 37 + p_size) % 401 - 200) / 200.0 END AS r2,
p_size % 4 AS n1, p_partkey % 3 AS n2, p_partkey % 4 AS n3 FROM part)"""


def feats(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    roles = F.array(*[F.lit(x) for x in ROLES])
    return table(spark, d, "part").select(
        k.alias("id"), roles[(s % 21).cast("int")].alias("role"), roles[(k % 21).cast("int")].alias("role_2"),
        F.when(s % 10 != 3, ((k * 37) % 401 - 200) / F.lit(200.0)).alias("r1"), F.when(s % 7 != 3, ((k * 37 + s) % 401 - 200) / F.lit(200.0)).alias("r2"),
        (s % 4).alias("n1"), (k % 3).alias("n2"), (k % 4).alias("n3"))


C = F.col


def rule(name, sql, cols):
    """Register a row-wise rule over the feature table; `cols` makes its columns when run."""
    @query(name, f"WITH {FEATS} SELECT id, {sql} FROM f")
    def run(spark, d):
        return feats(spark, d).select("id", *[v.alias(k) for k, v in cols().items()])


NAMES = "nm AS (SELECT p_partkey AS id, replace(p_name, ' ', '_') AS name FROM part)"


def part_names(spark, d):
    return table(spark, d, "part").select(C("p_partkey").alias("id"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"))


@query("R01_leakage_role", f"""WITH {NAMES} SELECT id, CASE name WHEN 'blue_anvil' THEN 'timestamp' WHEN 'red_bolt' THEN 'forecast_target' ELSE 'candidate_feature' END AS role,
CASE WHEN name = 'blue_anvil' THEN 'none' WHEN name = 'red_bolt' THEN 'target' WHEN name IN ('hot_gear', 'hot_bolt') THEN 'review' ELSE 'low' END AS risk FROM nm""")
def r01(spark, d):
    args = (C("name"), "blue_anvil", "red_bolt", ["hot_gear", "hot_bolt"])
    return part_names(spark, d).select("id", ru.leakage_role(*args).alias("role"), ru.leakage_risk(*args).alias("risk"))


CATS = [("blue anvil", "Feedwater"), ("red bolt (MW)", "Power / Electrical"), ("hot gear", "Flue Gas"), ("unknown thing", "Blowdown")]


@query("R02_feature_categories", """WITH c AS (SELECT * FROM (VALUES ('blue anvil', 'Feedwater'), ('red bolt', 'Power / Electrical'), ('hot gear', 'Flue Gas'), ('unknown thing', 'Blowdown')) t(name, category)),
x AS (SELECT p_partkey AS id, p_name AS name FROM part)
SELECT name, coalesce(category, 'Uncategorised') AS category, 'data' AS side, count(*) AS features FROM x LEFT JOIN c USING (name) GROUP BY 1, 2
UNION ALL SELECT name, category, 'map_only', 0 FROM c WHERE name NOT IN (SELECT name FROM x)""")
def r02(spark, d):
    cats = small_table(spark, CATS, "raw STRING, category STRING").select(n.display_name(C("raw")).alias("name"), "category")
    # headers carry units and line breaks in the source; normalising brings both sides together
    data = table(spark, d, "part").select(n.display_name(F.concat(F.upper("p_name"), F.lit("\n（MW）"))).alias("name"))
    counted = lookup(data.groupBy("name").agg(F.count(F.lit(1)).alias("features")), "name", cats, "category", "Uncategorised")
    extra = cats.join(data, "name", "left_anti").withColumn("features", F.lit(0).cast("long")).withColumn("side", F.lit("map_only"))
    return counted.withColumn("side", F.lit("data")).unionByName(extra)


rule("R03_variability", "CASE n1 WHEN 1 THEN 'Constant' WHEN 2 THEN 'Two-State' ELSE 'Variable' END AS variability",
     lambda: dict(variability=ru.variability(C("n1"))))


def _p(a, b):
    return f"((role = '{a}' AND role_2 IN ({b})) OR (role_2 = '{a}' AND role IN ({b})))"


REL = "CASE " + " ".join([
    f"WHEN {_p('Valve Position Command', repr('Valve Current Position'))} THEN 'Command vs Actual Position'",
    f"WHEN {_p('Measured Flowrate', repr('Converted Flowrate'))} THEN 'Measured vs Converted Flowrate'",
    f"WHEN {_p('Setpoint', repr('Process Measurement'))} THEN 'Setpoint vs Process Measurement'",
    f"WHEN {_p('Process Threshold', repr('Process Measurement'))} THEN 'Threshold vs Process Measurement'",
    f"WHEN {_p('Controller Output', repr('Process Measurement'))} THEN 'Controller Output vs Process Measurement'",
    "WHEN " + _p("Output Power", "'Electrical Load Demand', 'Total Electrical Load Demand'") + " THEN 'Power Output vs Load Demand'",
    "WHEN " + _p("Scheduled Power Demand", "'Output Power', 'Electrical Load Demand'") + " THEN 'Scheduled Demand vs Actual/Load'",
    "WHEN " + _p("Frequency Deviation", "'Output Power', 'Electrical Load Demand', 'Total Electrical Load Demand'") + " THEN 'Frequency vs Power/Load'",
    "WHEN 'Internal Control-Logic Output' IN (role, role_2) AND role <> role_2 THEN 'Internal Control Logic vs Process Signal'",
    "WHEN role = role_2 THEN 'Same Role' ELSE 'Different Engineering Roles' END"])
def rel():
    return ru.role_relationship(C("role"), C("role_2"))


rule("R04_role_relationship", f"{REL} AS relationship",
     lambda: dict(relationship=rel()))
rule("R05_relationship_decision", f"CASE WHEN {REL} IN ('Same Role', 'Different Engineering Roles') THEN 'REVIEW' ELSE 'KEEP' END AS decision",
     lambda: dict(decision=ru.relationship_decision(rel())))
rule("R06_selection_decision", """CASE WHEN n2 = 1 AND n3 = 1 THEN 'EXCLUDE' WHEN n2 = 1 OR n3 = 1 THEN 'REVIEW' WHEN role = 'Requires Documentation' THEN 'DOCUMENT'
 WHEN role IN ('Vibration / Equipment Condition', 'Equipment Condition', 'Process Measurement', 'Status / Switch', 'Setpoint', 'Control / Assignment') THEN 'KEEP'
 WHEN role = 'Derived / Calculated' THEN 'REVIEW' WHEN role = 'Equipment / Pump Signal' THEN CASE WHEN n1 = 1 THEN 'EXCLUDE' ELSE 'KEEP' END ELSE 'REVIEW' END AS decision""",
     lambda: dict(decision=ru.selection_decision(C("role"), C("n2") == 1, C("n3") == 1, ru.variability(C("n1")))))
STAB = """CASE WHEN abs(r1) >= 0.95 AND abs(r2) >= 0.95 THEN CASE WHEN r1 * r2 < 0 THEN 'HIGH_BUT_SIGN_CHANGED' ELSE 'STABLE_HIGH_CORRELATION' END WHEN abs(r1) >= 0.95 AND abs(r2) < 0.95 THEN 'TEST1_SPECIFIC'
 WHEN abs(r2) >= 0.95 AND abs(r1) < 0.95 THEN 'TEST2_SPECIFIC' WHEN abs(r1) >= 0.8 AND abs(r2) >= 0.8 THEN 'MODERATE_STABLE' ELSE 'UNSTABLE' END"""
rule("R07_correlation_stability", f"{STAB} AS stability, round(abs(abs(r1) - abs(r2)), 6) AS difference, coalesce((r1 >= 0) = (r2 >= 0), false) AS same_direction",
     lambda: dict(stability=ru.stability_class(C("r1"), C("r2")), difference=r(F.abs(F.abs("r1") - F.abs("r2"))), same_direction=F.coalesce((C("r1") >= 0) == (C("r2") >= 0), F.lit(False))))
rule("R08_redundancy_assessment", """CASE WHEN role = role_2 THEN CASE WHEN role IN ('Process Measurement', 'Equipment / Pump Signal', 'Equipment Condition') THEN 'REDUNDANT_CANDIDATE' ELSE 'REVIEW' END
 ELSE 'RETAIN_BOTH_REVIEW' END AS decision""",
     lambda: dict(decision=ru.redundancy_assessment(C("role"), C("role_2"))))


@query("R09_representatives", f"""WITH {FEATS}, e AS (SELECT role AS node FROM f WHERE {STAB} = 'STABLE_HIGH_CORRELATION' UNION ALL SELECT role_2 FROM f WHERE {STAB} = 'STABLE_HIGH_CORRELATION'),
g AS (SELECT node, count(*) AS stable_connections FROM e GROUP BY 1), a AS (SELECT role AS node FROM f UNION SELECT role_2 FROM f)
SELECT node AS role, coalesce(stable_connections, 0) AS stable_connections, CASE WHEN node IN ('Setpoint', 'Control / Assignment', 'Status / Switch') THEN 'RETAIN_FOR_CONTEXT'
 WHEN node IN ('Process Measurement', 'Equipment Condition') THEN 'REPRESENTATIVE_CANDIDATE' WHEN node = 'Vibration / Equipment Condition' THEN 'RETAIN_FOR_DIAGNOSTICS' ELSE 'REVIEW' END AS status
FROM a LEFT JOIN g USING (node)""")
def r09(spark, d):
    f = feats(spark, d)
    stable = f.filter(ru.stability_class(C("r1"), C("r2")) == "STABLE_HIGH_CORRELATION")
    ends = stable.select(C("role").alias("role")).unionAll(stable.select(C("role_2").alias("role"))).groupBy("role").agg(F.count(F.lit(1)).alias("stable_connections"))
    every = f.select("role").union(f.select(C("role_2").alias("role"))).distinct()
    return every.join(ends, "role", "left").select("role", F.coalesce("stable_connections", F.lit(0)).cast("long").alias("stable_connections"), ru.representative_status(C("role")).alias("status"))


SIGN = "CASE WHEN r1 IS NULL OR r2 IS NULL THEN 'One dataset unavailable' WHEN r1 = 0 OR r2 = 0 THEN 'Weak/zero relationship' WHEN (r1 > 0) = (r2 > 0) THEN 'Consistent sign' ELSE 'Opposite signs' END"
STRENGTH = "CASE WHEN r1 IS NULL THEN 'Unavailable' WHEN abs(r1) >= 0.3 THEN 'Strong' WHEN abs(r1) >= 0.1 THEN 'Moderate' WHEN abs(r1) >= 0.05 THEN 'Weak' ELSE 'Very Weak' END"
DIFF = "abs(abs(r1) - abs(r2))"
rule("R10_label_relationship", f"""{SIGN} AS sign, {STRENGTH} AS strength, CASE WHEN r1 IS NULL OR r2 IS NULL THEN 'Single-dataset evidence' WHEN {DIFF}::DOUBLE <= 0.05::DOUBLE THEN 'Stable'
 WHEN {DIFF}::DOUBLE <= 0.1::DOUBLE THEN 'Moderately stable' ELSE 'Variable' END AS stability""",
     lambda: dict(sign=ru.sign_consistency(C("r1"), C("r2")), strength=ru.relationship_strength(C("r1")), stability=ru.relationship_stability(C("r1"), C("r2"))))
rule("R11_feature_assessment", f"""CASE WHEN n2 = 1 AND n3 = 1 THEN 'Constant in both' WHEN n2 = 1 THEN 'Constant only in Test1' WHEN n3 = 1 THEN 'Constant only in Test2' ELSE 'Variable' END AS constant_status,
 CASE WHEN r1 IS NULL AND r2 IS NULL THEN 'No label correlation available' WHEN r1 IS NULL OR r2 IS NULL THEN 'Single-dataset evidence' WHEN {DIFF}::DOUBLE <= 0.05::DOUBLE THEN 'Consistent magnitude' WHEN {DIFF}::DOUBLE <= 0.1::DOUBLE THEN 'Moderately consistent magnitude' ELSE 'Magnitude varies' END AS label_evidence,
 CASE WHEN n2 = 1 AND n3 = 1 THEN 'Showcase / Configuration' WHEN {STRENGTH} = 'Strong' THEN 'High-priority candidate' WHEN {STRENGTH} = 'Moderate' THEN 'Candidate for further evaluation'
 WHEN {STRENGTH} = 'Weak' AND {SIGN} = 'Consistent sign' THEN 'Potential supporting feature' WHEN {STRENGTH} = 'Very Weak' THEN 'Low observed label association' ELSE 'Requires further evaluation' END AS assessment""",
     lambda: dict(constant_status=ru.constant_status(C("n2") == 1, C("n3") == 1), label_evidence=ru.label_evidence(C("r1"), C("r2")),
     assessment=ru.assessment((C("n2") == 1) & (C("n3") == 1), ru.relationship_strength(C("r1")), ru.sign_consistency(C("r1"), C("r2")))))
rule("R12_constant_class", """CASE WHEN n1 = 1 AND n2 = 1 AND n3 = 1 THEN 'Constant in training, Test1 and Test2' WHEN n2 > 1 AND n3 > 1 THEN 'Constant in training, variable in Test1 and Test2'
 WHEN n2 > 1 THEN 'Constant in training, variable in Test1' WHEN n3 > 1 THEN 'Constant in training, variable in Test2' ELSE 'Requires review' END AS class""",
     lambda: dict(**{"class": ru.constant_class(C("n1"), C("n2"), C("n3"))}))
rule("R13_training_decision", """CASE WHEN role IN ('Process Measurement', 'Electrical Load Demand', 'Output Power', 'Valve Position Command', 'Valve Current Position', 'Measured Flowrate', 'Converted Flowrate', 'Controller Output') THEN 'KEEP' ELSE 'REVIEW' END AS decision""",
     lambda: dict(decision=ru.training_decision(C("role"))))
def category():
    return ru.review_category(C("role"), ["Setpoint", "Status / Switch"], ["Requires Documentation"], ["Internal Control-Logic Output"])
rule("R14_review_resolution", """CASE WHEN role IN ('Setpoint', 'Status / Switch') THEN 'DOCUMENTED_ENGINEERING_SIGNAL' WHEN role = 'Requires Documentation' THEN 'REQUIRES_DOCUMENTATION' WHEN role = 'Internal Control-Logic Output' THEN 'INTERNAL_CONTROL_LOGIC' ELSE 'UNRESOLVED' END AS category,
 CASE WHEN role IN ('Setpoint', 'Status / Switch') THEN 'KEEP' WHEN role IN ('Requires Documentation', 'Internal Control-Logic Output') THEN 'REVIEW' ELSE CASE WHEN n1 = 1 THEN 'EXCLUDE' ELSE 'REVIEW' END END AS decision""",
     lambda: dict(category=category(), decision=ru.resolved_decision(category(), F.when(C("n1") == 1, "EXCLUDE").otherwise("REVIEW"))))


@query("R15_activity_class", f"""WITH s AS (SELECT user_id, l_floor - lag(l_floor) {U.replace('OVER (', 'OVER (')} AS dv FROM (SELECT *, floor(value / 25) AS l_floor FROM events)),
c AS (SELECT user_id, avg((dv <> 0)::INT) AS rate FROM s GROUP BY 1)
SELECT user_id, round(rate, 6) AS change_rate, CASE WHEN rate = 0 THEN 'STATIC' WHEN rate < 0.01 THEN 'VERY_LOW_ACTIVITY' WHEN rate < 0.1 THEN 'LOW_ACTIVITY' WHEN rate < 0.5 THEN 'MODERATE_ACTIVITY' ELSE 'HIGH_ACTIVITY' END AS activity FROM c""".replace(
    "ORDER BY ts, event_id) AS dv FROM (SELECT *, floor(value / 25) AS l_floor FROM events)", "ORDER BY ts, event_id) AS dv FROM (SELECT *, floor(value / 25) AS l_floor FROM events) ev"))
def r15(spark, d):
    e = events(spark, d).select("user_id", "ts", "event_id", F.floor(C("value") / 25).cast("double").alias("v"))
    t = w.temporal_features(e, by_user(), ["v"], kinds=("diff",))
    rate = t.groupBy("user_id").agg(F.avg(F.when(C("v__diff") != 0, 1.0).when(C("v__diff") == 0, 0.0)).alias("rate"))
    return rate.select("user_id", r("rate").alias("change_rate"), ru.activity(C("rate")).alias("activity"))


@query("R16_quality_class", f"""WITH {TALL}, q AS (SELECT feature, l_returnflag, count(value) AS n, count(DISTINCT value) AS u, stddev_samp(value) AS s FROM tall GROUP BY 1, 2)
SELECT feature, l_returnflag, CASE WHEN n = 0 THEN 'NO_VALID_DATA' WHEN u <= 1 THEN 'CONSTANT' WHEN u <= 10 THEN 'VERY_LOW_CARDINALITY' WHEN s = 0 THEN 'CONSTANT' ELSE 'VARIABLE' END AS class FROM q""")
def r16(spark, d):
    m = measures(spark, d)
    x = p.feature_moments(m, STEADY, ["l_returnflag"]).join(p.distinct_values(m, STEADY, ["l_returnflag"]), ["l_returnflag", "feature"])
    return x.select("feature", "l_returnflag", ru.quality_class(C("valid"), C("distinct_values"), C("std")).alias("class"))


SUFFIX = ["__diff_1s", "__abs_diff_1s", "__rolling_std_5s"]
SFX = "['__diff_1s', '__abs_diff_1s', '__rolling_std_5s']"
TRANS = "['diff_1s', 'abs_diff_1s', 'rolling_std_5s']"
TP = f"""tp AS (SELECT id, role AS ba, role_2 AS bb, {TRANS}[n1 % 3 + 1] AS ta, {TRANS}[n2 + 1] AS tb, CASE WHEN n3 = 0 THEN 1.0 ELSE r1 END::DOUBLE AS r FROM f)"""


def temporal_pairs(spark, d):
    sfx = F.array(*[F.lit(x) for x in SUFFIX])
    f = feats(spark, d)
    fa, fb = F.concat("role", sfx[(C("n1") % 3).cast("int")]), F.concat("role_2", sfx[C("n2").cast("int")])
    return f.select("id", fa.alias("feature_1"), fb.alias("feature_2"), F.when(C("n3") == 0, 1.0).otherwise(C("r1")).alias("r"))


STATUS, PROCESS = ["Status / Switch", "Setpoint", "Control / Assignment"], ["Process Measurement", "Output Power", "Controller Output"]
R17 = """CASE WHEN abs(abs(r) - 1) < 1e-12 THEN CASE WHEN ba = bb THEN 'KEEP' ELSE 'REVIEW' END
 WHEN (ta = 'diff_1s' AND tb = 'abs_diff_1s') OR (tb = 'diff_1s' AND ta = 'abs_diff_1s') THEN CASE WHEN ba = bb THEN 'KEEP' ELSE 'REVIEW' END
 WHEN ta = tb AND NOT (ba IN ('Status / Switch', 'Setpoint', 'Control / Assignment') AND bb IN ('Status / Switch', 'Setpoint', 'Control / Assignment'))
  AND NOT (ba IN ('Process Measurement', 'Output Power', 'Controller Output') AND bb IN ('Process Measurement', 'Output Power', 'Controller Output')) THEN 'KEEP' ELSE 'REVIEW' END"""


@query("R17_temporal_pair_decision", f"WITH {FEATS}, {TP} SELECT id, ba AS base_1, tb AS transformation_2, {R17} AS decision FROM tp")
def r17(spark, d):
    t = temporal_pairs(spark, d)
    b1, b2, t1, t2 = n.base_feature(C("feature_1")), n.base_feature(C("feature_2")), n.transformation(C("feature_1")), n.transformation(C("feature_2"))
    return t.select("id", b1.alias("base_1"), t2.alias("transformation_2"), ru.temporal_pair_decision(C("r"), b1, b2, t1, t2, STATUS, PROCESS).alias("decision"))


@query("R18_temporal_manifest", f"""WITH {FEATS}, {TP}, x AS (SELECT ba || '__' || ta AS a, bb || '__' || tb AS b, r FROM tp),
e AS (SELECT a AS feature, b AS partner, r FROM x WHERE abs(r) >= 0.9 UNION ALL SELECT b, a, r FROM x WHERE abs(r) >= 0.9), k AS (SELECT a AS feature FROM x UNION SELECT b FROM x),
g AS (SELECT feature, count(*) AS pairs, count(*) FILTER (abs(abs(r) - 1) < 1e-12) AS exact_pairs, string_agg(DISTINCT partner, ';' ORDER BY partner) AS related FROM e GROUP BY 1)
SELECT feature, coalesce(pairs, 0) AS pairs, coalesce(exact_pairs, 0) AS exact_pairs, coalesce(related, '') AS related, 'KEEP' AS selection,
CASE WHEN exact_pairs > 0 THEN 'EXACT_REDUNDANCY_REVIEW' WHEN pairs > 0 THEN 'HIGH_CORRELATION_REVIEW' ELSE 'NO_REDUNDANCY_FLAG' END AS status FROM k LEFT JOIN g USING (feature)""")
def r18(spark, d):
    t = temporal_pairs(spark, d)
    hi = t.filter(F.abs("r") >= 0.9)
    both = hi.select(C("feature_1").alias("feature"), C("feature_2").alias("partner"), "r").unionAll(hi.select("feature_2", "feature_1", "r"))
    exact = F.count(F.when(F.abs(F.abs("r") - 1) < 1e-12, 1))
    # partners of a feature are feature names: bounded by the column count
    g = both.groupBy("feature").agg(F.count(F.lit(1)).alias("pairs"), exact.alias("exact_pairs"), F.array_join(F.sort_array(F.collect_set("partner")), ";").alias("related"))
    every = t.select(C("feature_1").alias("feature")).union(t.select("feature_2")).distinct()
    x = every.join(g, "feature", "left").fillna(0, ["pairs", "exact_pairs"]).fillna("", ["related"])
    return x.select("feature", "pairs", "exact_pairs", "related", F.lit("KEEP").alias("selection"), ru.temporal_review_status(C("pairs"), C("exact_pairs")).alias("status"))


@query("R19_column_category", f"""WITH {FEATS}, {TP} SELECT id, CASE WHEN id = 0 THEN 'timestamp' WHEN id % 5 = 0 THEN 'original_model_ready' ELSE 'temporal' END AS category,
CASE WHEN id = 0 THEN 'none' WHEN id % 5 = 0 THEN 'original' ELSE ta END AS transformation FROM tp""")
def r19(spark, d):
    t = temporal_pairs(spark, d)
    name = F.when(C("id") == 0, "timestamp").when(C("id") % 5 == 0, n.base_feature(C("feature_1"))).otherwise(C("feature_1"))
    t = t.select("id", name.alias("column"), (C("id") % 5 == 0).alias("original"))
    tr = n.transformation(C("column"))
    is_time = C("column") == "timestamp"
    return t.select("id", ru.column_category(tr, is_time, C("original")).alias("category"),
                    F.when(is_time, "none").when(C("original"), "original").otherwise(tr).alias("transformation"))


FN = """fn AS (SELECT p_partkey AS id, CASE p_size % 6 WHEN 0 THEN 'day_of_week' WHEN 1 THEN p_name || '_lag_' || (p_partkey % 12) WHEN 2 THEN upper(p_name) WHEN 3 THEN 'other thing_lag_2' WHEN 4 THEN p_type || ' rolling' ELSE 'zzz' END AS name FROM part),
kn AS (SELECT DISTINCT replace(p_name, ' ', '_') AS k FROM part),
fx AS (SELECT *, replace(lower(name), ' ', '_') AS s, regexp_matches(name, '_lag_[0-9]+$') AS is_lag, replace(lower(regexp_replace(name, '_lag_[0-9]+$', '')), ' ', '_') AS b FROM fn)"""
LINEAGE = """CASE WHEN s IN ('hour', 'minute', 'day_of_week', 'day_of_month') THEN 'TIME_DERIVED' WHEN is_lag AND b IN (SELECT k FROM kn) THEN 'LAG_DERIVED' WHEN is_lag THEN 'LAG_DERIVED_REVIEW'
 WHEN s IN (SELECT k FROM kn) THEN 'RAW_SOURCE' WHEN regexp_matches(s, 'rolling|diff|delta|change|mean|std|min|max|rate|ratio|avg') THEN 'ENGINEERED' ELSE 'REQUIRES_REVIEW' END"""


def lineage(spark, d):
    pt = table(spark, d, "part")
    s = C("p_size") % 6
    name = (F.when(s == 0, "day_of_week").when(s == 1, F.concat("p_name", F.lit("_lag_"), (C("p_partkey") % 12).cast("string"))).when(s == 2, F.upper("p_name"))
            .when(s == 3, "other thing_lag_2").when(s == 4, F.concat("p_type", F.lit(" rolling"))).otherwise("zzz"))
    fn = pt.select(C("p_partkey").alias("id"), name.alias("name"))
    fn = fn.select("*", n.snake(C("name")).alias("snake"), n.lag_step(C("name")).alias("lag_step"), n.snake(n.lag_base(C("name"))).alias("base"))
    known = pt.select(n.snake(C("p_name")).alias("known")).distinct()
    x = fn.join(known.select(C("known").alias("base"), F.lit(True).alias("base_known")), "base", "left").join(
        known.select(C("known").alias("snake"), F.lit(True).alias("raw_known")), "snake", "left")
    f = F.coalesce
    cls = ru.lineage_class(C("snake"), C("lag_step").isNotNull(), f("base_known", F.lit(False)), f("raw_known", F.lit(False)))
    return x.select("id", "name", "lag_step", cls.alias("feature_class"))


@query("R20_lineage_class", f"WITH {FN} SELECT id, name, coalesce(nullif(regexp_extract(name, '_lag_([0-9]+)$', 1), '')::INTEGER, 0) AS lag_step, {LINEAGE} AS feature_class FROM fx")
def r20(spark, d):
    return lineage(spark, d).fillna(0, ["lag_step"])


@query("R21_acquisition_lookup", """SELECT p_partkey AS id, coalesce(cls, 'REQUIRES_DOCUMENTATION') AS acquisition_class, CASE WHEN cls IS NULL THEN 'DOCUMENTATION_REVIEW' ELSE 'HISTORICAL_READY' END AS runtime_status
FROM part LEFT JOIN (VALUES ('ECONOMY', 'HISTORICAL_RUNTIME'), ('PROMO', 'HISTORICAL_RUNTIME'), ('SMALL', 'HARDWARE')) t(p_type, cls) USING (p_type)""")
def r21(spark, d):
    known = {"ECONOMY": "HISTORICAL_RUNTIME", "PROMO": "HISTORICAL_RUNTIME", "SMALL": "HARDWARE"}
    x = lookup(table(spark, d, "part").select("p_partkey", "p_type"), "p_type", known, "acquisition_class", "REQUIRES_DOCUMENTATION")
    return x.select(C("p_partkey").alias("id"), "acquisition_class", F.when(C("acquisition_class") == "REQUIRES_DOCUMENTATION", "DOCUMENTATION_REVIEW").otherwise("HISTORICAL_READY").alias("runtime_status"))


@query("R22_acquisition_plan", f"""WITH {FN}, c AS (SELECT id, {LINEAGE} AS cls FROM fx) SELECT id,
CASE cls WHEN 'RAW_SOURCE' THEN 'NOT_CONFIRMED' WHEN 'TIME_DERIVED' THEN 'RUNTIME_TIMESTAMP' WHEN 'LAG_DERIVED' THEN 'RUNTIME_SOURCE_PLUS_HISTORY_BUFFER' ELSE 'UNKNOWN' END AS runtime_source,
CASE cls WHEN 'RAW_SOURCE' THEN 'HISTORICAL_ONLY_UNTIL_RUNTIME_SOURCE_MAPPED' WHEN 'TIME_DERIVED' THEN 'REQUIRES_RUNTIME_FEATURE_BUILDER' WHEN 'LAG_DERIVED' THEN 'REQUIRES_RUNTIME_FEATURE_BUILDER' ELSE 'REQUIRES_REVIEW' END AS runtime_status,
CASE cls WHEN 'TIME_DERIVED' THEN 'NOT_APPLICABLE' ELSE 'NOT_ESTABLISHED' END AS mapping_confidence FROM c""")
def r22(spark, d):
    x = lineage(spark, d)
    return x.select("id", *[v.alias(k) for k, v in ru.acquisition_plan(C("feature_class")).items()])


@query("R23_name_mapping", """WITH h AS (SELECT p_partkey AS id, p_name, CASE p_size % 3 WHEN 0 THEN 'MW' WHEN 1 THEN 't/h' ELSE '' END AS unit FROM part)
SELECT id, p_name AS signal, unit, coalesce(t.param, '') AS parameter, CASE WHEN t.param IS NULL THEN 'NO_CURRENT_SOURCE' ELSE 'CANDIDATE_REQUIRES_VERIFICATION' END AS mapping_status,
CASE WHEN t.param IS NULL THEN 'NOT_ESTABLISHED' ELSE conf END AS mapping_confidence, t.param IS NULL AS requires_new_parameter
FROM h LEFT JOIN (VALUES ('blue anvil', 'power_output', 'STRONG_CANDIDATE'), ('red bolt', 'steam_pressure', 'LOW_CONFIDENCE')) t(p_name, param, conf) USING (p_name)""")
def r23(spark, d):
    known = small_table(spark, [("blue anvil", "power_output", "STRONG_CANDIDATE"), ("red bolt", "steam_pressure", "LOW_CONFIDENCE")], "signal STRING, parameter STRING, confidence STRING")
    s = C("p_size") % 3
    header = F.concat("p_name", F.when(s == 0, "\n（MW）").when(s == 1, " (t/h)").otherwise(""))
    x = table(spark, d, "part").select(C("p_partkey").alias("id"), header.alias("header"))
    x = x.select("id", n.signal_name(C("header")).alias("signal"), n.unit(C("header")).alias("unit")).join(known, "signal", "left")
    return x.select("id", "signal", "unit", F.coalesce("parameter", F.lit("")).alias("parameter"), *[v.alias(k) for k, v in ru.mapping_status(C("parameter"), C("confidence")).items()])


@query("R24_catalogue_coverage", """WITH v AS (SELECT DISTINCT p_name AS name FROM part), c AS (SELECT DISTINCT p_type AS name FROM part UNION SELECT DISTINCT p_name FROM part WHERE p_size = 1)
SELECT name, CASE WHEN name IN (SELECT name FROM c) THEN 'AVAILABLE_EXACT' WHEN m.target IN (SELECT name FROM c) THEN 'AVAILABLE_EXPLICIT_PROJECT_MAPPING' ELSE 'NOT_AVAILABLE' END AS status
FROM v LEFT JOIN (VALUES ('blue anvil', 'ECONOMY'), ('red bolt', 'NOWHERE'), ('hot gear', 'PROMO')) m(name, target) USING (name)""")
def r24(spark, d):
    pt = table(spark, d, "part")
    cat = pt.select(C("p_type").alias("name")).union(pt.filter("p_size = 1").select("p_name")).distinct()
    mapped = small_table(spark, [("blue anvil", "ECONOMY"), ("red bolt", "NOWHERE"), ("hot gear", "PROMO")], "name STRING, target STRING")
    x = pt.select(C("p_name").alias("name")).distinct().join(mapped, "name", "left").join(cat.withColumn("exact", F.lit(True)), "name", "left")
    x = x.join(cat.select(C("name").alias("target"), F.lit(True).alias("via")), "target", "left")
    return x.select("name", ru.coverage_status(F.coalesce("exact", F.lit(False)), F.coalesce("via", F.lit(False))).alias("status"))


DEC = f"""x AS (SELECT *, (event_type IN ('error', 'view'))::INTEGER AS hit, CASE event_type WHEN 'error' THEN 'ANOMALY' WHEN 'view' THEN 'anomaly' WHEN 'signup' THEN 'INSUFFICIENT_HISTORY' WHEN 'click' THEN 'UNAVAILABLE' ELSE 'NORMAL' END AS state FROM events),
s AS (SELECT *, sum(1 - hit) {U} AS resets FROM x), t AS (SELECT *, (sum(hit) OVER (PARTITION BY user_id, resets ORDER BY ts, event_id))::BIGINT AS streak FROM s),
l AS (SELECT event_id, streak, CASE WHEN streak >= 3 THEN 'LEVEL_3' WHEN upper(state) IN ('ANOMALY', 'INSUFFICIENT_HISTORY', 'UNAVAILABLE') THEN 'LEVEL_2' ELSE 'LEVEL_1' END AS level FROM t)"""


def decisions(spark, d):
    e = events(spark, d).select("user_id", "ts", "event_id", "event_type", "value")
    state = F.when(C("event_type") == "error", "ANOMALY").when(C("event_type") == "view", "anomaly").when(C("event_type") == "signup", "INSUFFICIENT_HISTORY").when(C("event_type") == "click", "UNAVAILABLE").otherwise("NORMAL")
    s = w.streaks(e.withColumn("state", state), by_user(), F.upper("state") == "ANOMALY")
    return s.withColumn("level", ru.decision_level(C("state"), C("streak")))


@query("R25_decision_level", f"WITH {DEC} SELECT event_id, streak, level, CASE level WHEN 'LEVEL_3' THEN 'HUMAN_ONLY' WHEN 'LEVEL_2' THEN 'APPROVAL_REQUIRED' ELSE 'AUTOMATIC' END AS action FROM l")
def r25(spark, d):
    return decisions(spark, d).select("event_id", "streak", "level", ru.decision_action(C("level")).alias("action"))


@query("R26_alarm_rows", f"WITH {DEC} SELECT event_id, 'DSS_' || level AS alarm_code, CASE level WHEN 'LEVEL_2' THEN 'WARNING' ELSE 'CRITICAL' END AS severity FROM l WHERE level <> 'LEVEL_1'")
def r26(spark, d):
    x = decisions(spark, d).filter(C("level") != "LEVEL_1")
    return x.select("event_id", ru.alarm_code(C("level")).alias("alarm_code"), ru.alarm_severity(C("level")).alias("severity"))


@query("K10_category_order", f"WITH {FEATS}, s AS (SELECT id, {STAB} AS stability, round((abs(r1) + abs(r2)) / 2, 6) AS mean_abs FROM f) SELECT id, stability, mean_abs FROM s")
def k10(spark, d):
    x = feats(spark, d).select("id", ru.stability_class(C("r1"), C("r2")).alias("stability"), r((F.abs("r1") + F.abs("r2")) / 2).alias("mean_abs"))
    return category_order(x, "stability", ru.STABILITY_ORDER, F.desc("mean_abs"))
