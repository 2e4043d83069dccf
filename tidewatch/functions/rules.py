"""Rule tables: ordered conditions, first match wins. Each rule is one column expression."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def choose(rules: list[tuple[Column, object]], default=None) -> Column:
    out = None
    for cond, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    default = default if isinstance(default, Column) else F.lit(default)
    return out.otherwise(default)


def _has(r1: Column, r2: Column, a: str, *others: str) -> Column:
    return ((r1 == a) & r2.isin(*others)) | ((r2 == a) & r1.isin(*others))


def leakage_role(name: Column, time: str, target: str, derived: list[str]) -> Column:
    return choose([(name == time, "timestamp"), (name == target, "forecast_target")], "candidate_feature")


def leakage_risk(name: Column, time: str, target: str, derived: list[str]) -> Column:
    return choose([(name == time, "none"), (name == target, "target"), (name.isin(*derived), "review")], "low")


def variability(distinct: Column) -> Column:
    return choose([(distinct == 1, "Constant"), (distinct == 2, "Two-State")], "Variable")


# fixed values: unordered role pairs with a named relationship, in order of precedence
ROLE_PAIRS = [
    ("Command vs Actual Position", "Valve Position Command", ["Valve Current Position"]),
    ("Measured vs Converted Flowrate", "Measured Flowrate", ["Converted Flowrate"]),
    ("Setpoint vs Process Measurement", "Setpoint", ["Process Measurement"]),
    ("Threshold vs Process Measurement", "Process Threshold", ["Process Measurement"]),
    ("Controller Output vs Process Measurement", "Controller Output", ["Process Measurement"]),
    ("Power Output vs Load Demand", "Output Power", ["Electrical Load Demand", "Total Electrical Load Demand"]),
    ("Scheduled Demand vs Actual/Load", "Scheduled Power Demand", ["Output Power", "Electrical Load Demand"]),
    ("Frequency vs Power/Load", "Frequency Deviation", ["Output Power", "Electrical Load Demand", "Total Electrical Load Demand"]),
]


def role_relationship(r1: Column, r2: Column) -> Column:
    rules = [(_has(r1, r2, a, *b), name) for name, a, b in ROLE_PAIRS]
    inner = (r1 == "Internal Control-Logic Output") | (r2 == "Internal Control-Logic Output")
    rules += [(inner & (r1 != r2), "Internal Control Logic vs Process Signal"), (r1 == r2, "Same Role")]
    return choose(rules, "Different Engineering Roles")


def relationship_decision(rel: Column) -> Column:
    return choose([(rel.isin("Same Role", "Different Engineering Roles"), "REVIEW")], "KEEP")


def relationship_reason(rel: Column) -> Column:
    return choose([
        (rel == "Same Role", "equal roles: possible redundancy, check meaning before removal"),
        (rel == "Different Engineering Roles", "unnamed role pair: engineering review needed"),
    ], "distinct documented signals despite high correlation")


# fixed values: roles kept when the feature varies
KEPT_ROLES = ["Vibration / Equipment Condition", "Equipment Condition", "Process Measurement", "Status / Switch", "Setpoint", "Control / Assignment"]


def selection_decision(role: Column, const_a: Column, const_b: Column, var: Column) -> Column:
    pump = role == "Equipment / Pump Signal"
    return choose([
        (const_a & const_b, "EXCLUDE"), (const_a | const_b, "REVIEW"), (role == "Requires Documentation", "DOCUMENT"),
        (role.isin(*KEPT_ROLES), "KEEP"), (role == "Derived / Calculated", "REVIEW"),
        (pump & var.isin("Variable", "Two-State"), "KEEP"), (pump, "EXCLUDE"),
    ], "REVIEW")


def stability_class(r1: Column, r2: Column, high: float = 0.95, moderate: float = 0.80) -> Column:
    a, b = F.abs(r1), F.abs(r2)
    return choose([
        ((a >= high) & (b >= high) & (r1 * r2 < 0), "HIGH_BUT_SIGN_CHANGED"), ((a >= high) & (b >= high), "STABLE_HIGH_CORRELATION"),
        ((a >= high) & (b < high), "TEST1_SPECIFIC"), ((b >= high) & (a < high), "TEST2_SPECIFIC"),
        ((a >= moderate) & (b >= moderate), "MODERATE_STABLE"),
    ], "UNSTABLE")


# fixed values: report order of the stability classes
STABILITY_ORDER = ["STABLE_HIGH_CORRELATION", "HIGH_BUT_SIGN_CHANGED", "TEST1_SPECIFIC", "TEST2_SPECIFIC", "MODERATE_STABLE", "UNSTABLE"]


def redundancy_assessment(r1: Column, r2: Column) -> Column:
    """Stable pairs: equal roles may be redundant, different roles are both retained."""
    redundant = r1.isin("Process Measurement", "Equipment / Pump Signal", "Equipment Condition")
    return choose([((r1 == r2) & redundant, "REDUNDANT_CANDIDATE"), (r1 == r2, "REVIEW")], "RETAIN_BOTH_REVIEW")


# fixed values: status of a role inside a correlation group
REPRESENTATIVE_STATUS = {
    "Setpoint": "RETAIN_FOR_CONTEXT",
    "Control / Assignment": "RETAIN_FOR_CONTEXT",
    "Process Measurement": "REPRESENTATIVE_CANDIDATE",
    "Equipment Condition": "REPRESENTATIVE_CANDIDATE",
    "Vibration / Equipment Condition": "RETAIN_FOR_DIAGNOSTICS",
    "Status / Switch": "RETAIN_FOR_CONTEXT",
}


def representative_status(role: Column) -> Column:
    return choose([(role == k, v) for k, v in REPRESENTATIVE_STATUS.items()], "REVIEW")


def sign_consistency(a: Column, b: Column) -> Column:
    return choose([
        (a.isNull() | b.isNull(), "One dataset unavailable"), ((a == 0) | (b == 0), "Weak/zero relationship"), (a * b > 0, "Consistent sign"),
    ], "Opposite signs")


def _closeness(a: Column, b: Column, near: str, mid: str, far: str, single: str) -> Column:
    d = F.abs(F.abs(a) - F.abs(b))
    return choose([(a.isNull() | b.isNull(), single), (d <= 0.05, near), (d <= 0.10, mid)], far)


def relationship_stability(a: Column, b: Column) -> Column:
    return _closeness(a, b, "Stable", "Moderately stable", "Variable", "Single-dataset evidence")


def relationship_strength(r: Column) -> Column:
    x = F.abs(r)
    return choose([(r.isNull(), "Unavailable"), (x >= 0.30, "Strong"), (x >= 0.10, "Moderate"), (x >= 0.05, "Weak")], "Very Weak")


def constant_status(const_a: Column, const_b: Column) -> Column:
    return choose([(const_a & const_b, "Constant in both"), (const_a, "Constant only in Test1"), (const_b, "Constant only in Test2")], "Variable")


def label_evidence(a: Column, b: Column) -> Column:
    none = choose([(a.isNull() & b.isNull(), "No label correlation available")], "Single-dataset evidence")
    full = _closeness(a, b, "Consistent magnitude", "Moderately consistent magnitude", "Magnitude varies", "")
    return F.when(a.isNull() | b.isNull(), none).otherwise(full)


def assessment(const_both: Column, strength: Column, sign: Column) -> Column:
    return choose([
        (const_both, "Showcase / Configuration"), (strength == "Strong", "High-priority candidate"),
        (strength == "Moderate", "Candidate for further evaluation"),
        ((strength == "Weak") & (sign == "Consistent sign"), "Potential supporting feature"),
        (strength == "Very Weak", "Low observed label association"),
    ], "Requires further evaluation")


def constant_class(train: Column, test1: Column, test2: Column) -> Column:
    v1, v2 = test1 > 1, test2 > 1
    return choose([
        ((train == 1) & (test1 == 1) & (test2 == 1), "Constant in training, Test1 and Test2"),
        (v1 & v2, "Constant in training, variable in Test1 and Test2"),
        (v1, "Constant in training, variable in Test1"), (v2, "Constant in training, variable in Test2"),
    ], "Requires review")


# fixed values: documented roles
DOCUMENTED_ROLES = [
    "Process Measurement", "Steam Temperature", "Steam Pressure", "Electrical Load Demand", "Output Power", "Valve Position Command",
    "Valve Current Position", "Measured Flowrate", "Converted Flowrate", "Controller Output", "Gate Opening Rate", "Mode Switch",
    "Status / Indicator", "Start Command",
]


def training_decision(role: Column) -> Column:
    review = (role == "Internal Control-Logic Output") | role.contains("Requires Documentation")
    return choose([(review, "REVIEW"), (role.isin(*DOCUMENTED_ROLES), "KEEP")], "REVIEW")


def review_category(feature: Column, documented: list[str], undocumented: list[str], internal: list[str]) -> Column:
    return choose([
        (feature.isin(*documented), "DOCUMENTED_ENGINEERING_SIGNAL"), (feature.isin(*undocumented), "REQUIRES_DOCUMENTATION"),
        (feature.isin(*internal), "INTERNAL_CONTROL_LOGIC"),
    ], "UNRESOLVED")


def resolved_decision(category: Column, earlier: Column) -> Column:
    return choose([(category == "DOCUMENTED_ENGINEERING_SIGNAL", "KEEP"), (category == "UNRESOLVED", earlier)], "REVIEW")


def activity(rate: Column) -> Column:
    return choose([
        (rate == 0, "STATIC"), (rate < 0.01, "VERY_LOW_ACTIVITY"), (rate < 0.10, "LOW_ACTIVITY"), (rate < 0.50, "MODERATE_ACTIVITY"),
    ], "HIGH_ACTIVITY")


def quality_class(valid: Column, distinct: Column, std: Column) -> Column:
    return choose([
        (valid == 0, "NO_VALID_DATA"), (distinct <= 1, "CONSTANT"), (distinct <= 10, "VERY_LOW_CARDINALITY"), (std == 0, "CONSTANT"),
    ], "VARIABLE")


def temporal_pair_decision(r: Column, base_a: Column, base_b: Column, trans_a: Column, trans_b: Column, status: list[str], process: list[str]) -> Column:
    exact = F.abs(F.abs(r) - 1) < 1e-12
    same_base = base_a == base_b
    signed_vs_abs = _has(trans_a, trans_b, "diff_1s", "abs_diff_1s")
    both = lambda names: base_a.isin(*names) & base_b.isin(*names)
    return choose([
        (exact, F.when(same_base, "KEEP").otherwise("REVIEW")), (signed_vs_abs, F.when(same_base, "KEEP").otherwise("REVIEW")),
        ((trans_a == trans_b) & ~both(status) & ~both(process), "KEEP"),
    ], "REVIEW")


def temporal_review_status(pairs: Column, exact_pairs: Column) -> Column:
    return choose([(exact_pairs > 0, "EXACT_REDUNDANCY_REVIEW"), (pairs > 0, "HIGH_CORRELATION_REVIEW")], "NO_REDUNDANCY_FLAG")


def column_category(transformation: Column, is_time: Column, is_original: Column) -> Column:
    known = transformation.isin("diff_1s", "abs_diff_1s", "rolling_std_5s")
    return choose([(is_time, "timestamp"), (is_original, "original_model_ready"), (known, "temporal")],
                  F.raise_error(F.lit("unexpected column")).cast("string"))


# fixed values: calendar features and words that mark an engineered one
CALENDAR_FEATURES = ["hour", "minute", "day_of_week", "day_of_month"]
ENGINEERED_WORDS = ["rolling", "diff", "delta", "change", "mean", "std", "min", "max", "rate", "ratio", "avg"]


def lineage_class(name: Column, is_lag: Column, base_known: Column, raw_known: Column) -> Column:
    engineered = F.lit(False)
    for w in ENGINEERED_WORDS:
        engineered = engineered | name.contains(w)
    return choose([
        (name.isin(*CALENDAR_FEATURES), "TIME_DERIVED"), (is_lag & base_known, "LAG_DERIVED"), (is_lag, "LAG_DERIVED_REVIEW"),
        (raw_known, "RAW_SOURCE"), (engineered, "ENGINEERED"),
    ], "REQUIRES_REVIEW")


# fixed values: acquisition plan per lineage class
ACQUISITION = {
    "RAW_SOURCE": ("NOT_CONFIRMED", "HISTORICAL_ONLY_UNTIL_RUNTIME_SOURCE_MAPPED", "NOT_ESTABLISHED"),
    "TIME_DERIVED": ("RUNTIME_TIMESTAMP", "REQUIRES_RUNTIME_FEATURE_BUILDER", "NOT_APPLICABLE"),
    "LAG_DERIVED": ("RUNTIME_SOURCE_PLUS_HISTORY_BUFFER", "REQUIRES_RUNTIME_FEATURE_BUILDER", "NOT_ESTABLISHED"),
}


def acquisition_plan(cls: Column) -> dict[str, Column]:
    pick = lambda i, other: choose([(cls == k, v[i]) for k, v in ACQUISITION.items()], other)
    return {"runtime_source": pick(0, "UNKNOWN"), "runtime_status": pick(1, "REQUIRES_REVIEW"), "mapping_confidence": pick(2, "NOT_ESTABLISHED")}


def mapping_status(mapped: Column, confidence: Column) -> dict[str, Column]:
    """Status of a name that was looked up in the catalogue of parameters."""
    none = mapped.isNull() | (mapped == "")
    return {
        "mapping_status": F.when(none, "NO_CURRENT_SOURCE").otherwise("CANDIDATE_REQUIRES_VERIFICATION"),
        "mapping_confidence": F.when(none, "NOT_ESTABLISHED").otherwise(confidence), "requires_new_parameter": none,
    }


def coverage_status(exact: Column, mapped: Column) -> Column:
    return choose([(exact, "AVAILABLE_EXACT"), (mapped, "AVAILABLE_EXPLICIT_PROJECT_MAPPING")], "NOT_AVAILABLE")


def decision_level(state: Column, streak: Column, threshold: int = 3) -> Column:
    """Persistence is tested first; an unknown state is an error."""
    s = F.upper(state)
    return choose([
        (streak >= threshold, "LEVEL_3"), (s.isin("ANOMALY", "INSUFFICIENT_HISTORY", "UNAVAILABLE"), "LEVEL_2"), (s == "NORMAL", "LEVEL_1"),
    ], F.raise_error(F.concat(F.lit("unknown anomaly state: "), F.coalesce(state, F.lit("null")))).cast("string"))


def decision_action(level: Column) -> Column:
    return choose([(level == "LEVEL_3", "HUMAN_ONLY"), (level == "LEVEL_2", "APPROVAL_REQUIRED")], "AUTOMATIC")


def alarm_code(level: Column) -> Column:
    return F.concat(F.lit("DSS_"), level)


def alarm_severity(level: Column) -> Column:
    return F.when(level == "LEVEL_2", "WARNING").when(level == "LEVEL_3", "CRITICAL")


def alarm_text(level: Column, action: Column, score: Column, label: Column) -> Column:
    return F.concat_ws("; ", F.concat(F.lit("DSS decision: "), level), F.concat(F.lit("action="), action),
                       F.concat(F.lit("anomaly_score="), F.coalesce(score.cast("string"), F.lit("None"))),
                       F.concat(F.lit("predicted_attack_mechanism="), F.coalesce(label, F.lit("None"))))

