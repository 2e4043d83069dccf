"""Data contracts: each returns one row per check (check, violations, pass) or the bad rows."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.operators.series import Series
from tidewatch.operators.windows import intervals
from tidewatch.sources.tables import surplus_copies

INF = float("inf")


def report(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Evaluate violation counts in one aggregate and list them."""
    row = df.agg(*[F.coalesce(v, F.lit(0)).cast("long").alias(k) for k, v in checks.items()])
    return as_checks(row, list(checks))


def as_checks(row: DataFrame, names: list[str]) -> DataFrame:
    items = F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).cast("long").alias("violations")) for n in names])
    return row.select(F.inline(items)).withColumn("passed", F.col("violations") == 0)


def _sum(c: Column) -> Column:
    return F.sum(F.when(c, 1).otherwise(0))


def _any_null(cols: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols], F.lit(False))


def _any_infinite(df: DataFrame, cols: list[str]) -> Column:
    floats = [f.name for f in df.schema.fields if f.name in cols and isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return reduce(lambda a, b: a | b, [F.coalesce(F.isnan(c) | (F.abs(F.col(c)) == INF), F.lit(False)) for c in floats], F.lit(False))


def not_numeric(df: DataFrame, cols: list[str]) -> int:
    return len([f for f in df.schema.fields if f.name in cols and not isinstance(f.dataType, T.NumericType)])


def repeated_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row: surplus copies of equal values."""
    return surplus_copies(df, cols)


def series_contract(
    df: DataFrame, series: Series, cols: list[str], cadence_seconds: float | None = None, label: str | None = None,
    expected_rows: int | None = None, strict: bool = True, unique: list[str] | None = None, aligned: dict[str, tuple[str, int]] | None = None, unique_time: bool = False,
) -> DataFrame:
    """Time series contract: timestamps present, increasing (`strict`: no ties) and on the
    cadence; values present, finite and numeric; label 0 or 1; row count; no rows that repeat
    the `unique` columns, and with `unique_time` none that repeat a time of their series; each target of `aligned` equal to its column so many rows ahead."""
    ts = series.order[0]
    step = intervals(df, series, "_dt")
    dt = F.col("_dt")
    checks = {
        "missing_timestamp": _sum(F.col(ts).isNull()), "not_increasing": _sum(dt <= 0 if strict else dt < 0),
        "null_values": _sum(_any_null(cols)), "infinite_values": _sum(_any_infinite(df, cols)), "non_numeric_columns": F.lit(not_numeric(df, cols)),
    }
    if cadence_seconds is not None:
        checks["off_cadence"] = _sum(dt != cadence_seconds)
    if label is not None:
        checks["bad_label"] = _sum(~F.coalesce(F.col(label).isin(0, 1), F.lit(False)))
    if expected_rows is not None:
        checks["row_count"] = F.abs(F.count(F.lit(1)) - expected_rows)
    out = report(step, checks)
    if unique:
        out = out.unionByName(as_checks(surplus_copies(df, unique, "duplicate_rows"), ["duplicate_rows"]))
    if unique_time:
        out = out.unionByName(as_checks(surplus_copies(df, [*series.keys, ts], "duplicate_time"), ["duplicate_time"]))
    if aligned:
        out = out.unionByName(as_checks(_misaligned(df, series, aligned), [f"misaligned_{t}" for t in aligned]))
    return out


def _misaligned(df: DataFrame, series: Series, aligned: dict[str, tuple[str, int]]) -> DataFrame:
    """One row: how often each target differs from the value it stands for."""
    columns = dict.fromkeys([*series.keys, *series.order, *aligned, *(c for c, _ in aligned.values())])
    fr = series.frame(df.select(*columns), after=max(k for _, k in aligned.values()))
    off = {f"_off_{t}": (~F.lead(c, k).over(fr.window()).eqNullSafe(F.col(t))).cast("int") for t, (c, k) in aligned.items()}
    rows = fr.with_columns(off).rows()
    return rows.agg(*[F.coalesce(F.sum(f"_off_{t}"), F.lit(0)).alias(f"misaligned_{t}") for t in aligned])


def candidate_contract(df: DataFrame, expected: list[str], keys: list[str], label: str | None = None) -> DataFrame:
    """Columns as the manifest says (both ways), key unique and present, values complete and finite."""
    have = [c for c in df.columns if c not in keys and c != label]
    present = [c for c in expected if c in df.columns]
    checks = {
        "missing_columns": F.lit(len(set(expected) - set(have))), "extra_columns": F.lit(len(set(have) - set(expected))),
        "null_keys": _sum(_any_null(keys)), "null_values": _sum(_any_null(present)), "infinite_values": _sum(_any_infinite(df, present)),
    }
    if label:
        checks["bad_label"] = _sum(~F.coalesce(F.col(label).isin(0, 1), F.lit(False)))
    dup = as_checks(repeated_rows(df, keys).withColumnRenamed("duplicates", "duplicate_keys"), ["duplicate_keys"])
    return report(df, checks).unionByName(dup)


def grouped_contract(df: DataFrame, part: str, series: Series, cols: list[str], cadence_seconds: float) -> DataFrame:
    """The series contract per file or dataset, in one pass: one row per part."""
    dt = F.col("_dt")
    return intervals(df, series, "_dt").groupBy(part).agg(
        F.count(F.lit(1)).alias("rows"), _sum(_any_null(cols)).alias("null_values"), _sum(_any_infinite(df, cols)).alias("infinite_values"),
        _sum(dt <= 0).alias("not_increasing"), _sum(dt != cadence_seconds).alias("off_cadence"),
    ).withColumn("passed", (F.col("null_values") + F.col("infinite_values") + F.col("not_increasing") + F.col("off_cadence")) == 0)


# fixed values: fields of a measurement record that must be non-blank text
RECORD_TEXT = ["source_id", "plant_id", "equipment_id", "parameter", "unit", "quality"]


def record_violations(timestamp: str = "timestamp", value: str = "value", texts: list[str] = RECORD_TEXT) -> Column:
    """Array of violation codes of a tall record given as text fields; empty when valid."""
    blank = [F.when(F.coalesce(F.trim(F.col(t)) == "", F.lit(True)), F.lit(f"blank_{t}")) for t in texts]
    return F.array_compact(F.array(
        F.when(F.try_to_timestamp(F.col(timestamp)).isNull(), F.lit("bad_timestamp")),
        F.when(F.col(value).try_cast("double").isNull(), F.lit("bad_value")), *blank))


def message_violations(features: Column, expected: list[str], numbers: Column | None = None, allow_extra: bool = False) -> Column:
    """Array of violation codes of a feature map (text values): exact keys, finite numbers.
    Booleans arrive as `true` / `false` and are no numbers."""
    want = F.array(*[F.lit(x) for x in expected])
    keys = F.map_keys(features)
    number = lambda v: v.try_cast("double")
    bad = F.exists(F.map_values(features), lambda v: number(v).isNull())
    inf = F.exists(F.map_values(features), lambda v: F.coalesce(F.isnan(number(v)) | (F.abs(number(v)) == INF), F.lit(False)))
    codes = [
        F.when(F.size(F.array_except(want, keys)) > 0, F.lit("missing_keys")),
        F.when(F.lit(not allow_extra) & (F.size(F.array_except(keys, want)) > 0), F.lit("extra_keys")),
        F.when(F.coalesce(bad, F.lit(False)), F.lit("not_numeric")), F.when(F.coalesce(inf, F.lit(False)), F.lit("not_finite")),
    ]
    return F.array_compact(F.array(*codes))


def interval_violations(df: DataFrame, series: Series, cadence_seconds: float, code: str = "code") -> DataFrame:
    """The rows with `bad_interval` where the time since the row before is not exactly the cadence; the first row of a series has none."""
    return intervals(df, series, "_dt").withColumn(code, F.when(F.col("_dt") != cadence_seconds, F.lit("bad_interval"))).drop("_dt")


def input_contract(df: DataFrame, manifest: list[str]) -> DataFrame:
    """Forecast input: features present, numeric, no null, finite."""
    present = [c for c in manifest if c in df.columns]
    return report(df, {
        "missing_features": F.lit(len(manifest) - len(present)), "non_numeric": F.lit(not_numeric(df, present)),
        "null_values": _sum(_any_null(present)), "not_finite": _sum(_any_infinite(df, present)),
    })


def completeness(features: Column, manifest: list[str]) -> dict[str, Column]:
    """READY or INCOMPLETE per row of a feature map, with missing and extra names."""
    want, keys = F.array(*[F.lit(x) for x in manifest]), F.map_keys(features)
    missing = F.array_except(want, keys)
    return {
        "status": F.when(F.size(missing) == 0, "READY").otherwise("INCOMPLETE"),
        "missing": F.array_join(F.sort_array(missing), ";"), "extra": F.array_join(F.sort_array(F.array_except(keys, want)), ";"),
    }


def target_alignment(df: DataFrame, series: Series, source: str, targets: dict[str, int], tolerance: float = 1e-9) -> DataFrame:
    """Stored targets against the lead of the source column: mismatches per target."""
    fr = series.frame(df, after=max(targets.values()))
    w = fr.window()
    fr = fr.with_columns({f"_l_{t}": F.lead(source, k).over(w) for t, k in targets.items()})
    checks = {}
    for t in targets:
        lead, have = F.col(f"_l_{t}"), F.col(t)
        checks[t] = _sum(F.coalesce(F.abs(lead - have) > tolerance, lead.isNull() != have.isNull()))
    return report(fr.rows(), checks)


def boundary_nulls(df: DataFrame, keys: list[str], sequence: str, expect: dict[str, int]) -> DataFrame:
    """Nulls of derived columns against `warm-up rows` per sequence (or its length, if shorter)."""
    per = df.groupBy(*keys, sequence).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(F.col(c).isNull().cast("int")).alias(f"_z_{c}") for c in expect])
    sums = [s for c, k in expect.items() for s in (F.sum(f"_z_{c}").alias(f"n_{c}"), F.sum(F.least(F.col("_n"), F.lit(k))).alias(f"e_{c}"))]
    tot = per.agg(F.count(F.lit(1)).alias("sequences"), *sums)
    items = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"n_{c}").alias("nulls"), F.col(f"e_{c}").alias("expected")) for c in expect])
    return tot.select("sequences", F.inline(items)).withColumn("passed", F.col("nulls") == F.col("expected"))


def multilabel_consistency(df: DataFrame, attack: Column, labels: list[str], codes: Column) -> DataFrame:
    """Normal rows carry no label, attack rows at least one, as many as they have codes."""
    n = reduce(lambda a, b: a + b, [F.col(x) for x in labels])
    return report(df, {
        "normal_with_label": _sum(~attack & (n != 0)), "attack_without_label": _sum(attack & (n < 1)),
        "label_code_mismatch": _sum(attack & (n != F.size(codes))),
    })


def target_consistency(tagged: DataFrame, ts: str, scenario: str, attack: str, positive_minutes: DataFrame, catalogue: DataFrame, codes: str, rows_per_minute: int | None = None) -> DataFrame:
    """Positive minutes equal on both sides, scenarios present with the catalogue's codes,
    normal rows clean, rows per minute as expected."""
    minute = F.date_trunc("minute", F.col(ts)).alias("minute")
    attacked = tagged.filter(F.col(attack) == 1)
    have = attacked.groupBy(minute).agg(F.count(F.lit(1)).alias("n"))
    want = positive_minutes.select("minute").distinct()
    lost = want.join(have, "minute", "left_anti").agg(F.count(F.lit(1)).alias("positive_minutes_lost"))
    added = have.join(want, "minute", "left_anti").agg(F.count(F.lit(1)).alias("minutes_added"))
    wrong = attacked.select(F.col(scenario), F.col(codes).alias("_c")).distinct().join(catalogue.select(scenario, F.col(codes).alias("_k")), scenario, "left")
    wrong = wrong.agg(F.coalesce(_sum(~F.coalesce(F.col("_c") == F.col("_k"), F.lit(False))), F.lit(0)).alias("codes_differ"))
    clean = tagged.agg(F.coalesce(_sum((F.col(attack) == 0) & F.col(scenario).isNotNull()), F.lit(0)).alias("normal_with_scenario"))
    row = clean.withColumns({"positive_minutes_lost": lost.scalar(), "minutes_added": added.scalar(), "codes_differ": wrong.scalar()})
    names = ["positive_minutes_lost", "minutes_added", "codes_differ", "normal_with_scenario"]
    if rows_per_minute is not None:
        odd = have.agg(F.coalesce(_sum(F.col("n") != rows_per_minute), F.lit(0)).alias("odd_minutes"))
        row, names = row.withColumn("odd_minutes", odd.scalar()), [*names, "odd_minutes"]
    return as_checks(row, names)


def name_leakage(features: DataFrame, name: str, targets: list[str], tokens: list[str]) -> DataFrame:
    """Feature names that are targets or contain a target token."""
    hit = reduce(lambda a, b: a | b, [F.lower(F.col(name)).contains(t.lower()) for t in tokens], F.lit(False))
    kind = F.when(F.col(name).isin(*targets), "is_target").when(hit, "target_token")
    return features.select(name, kind.alias("violation")).filter(F.col("violation").isNotNull())


def dataset_audit(df: DataFrame, ts: str, keys: list[str], label: str, scenario: str, cols: list[str]) -> DataFrame:
    """Rows, duplicate keys, class counts, scenario count, constant features of a labelled table."""
    one = df.agg(
        F.count(F.lit(1)).alias("rows"), _sum(F.col(label) == 1).alias("attack_rows"), _sum(F.col(label) == 0).alias("normal_rows"),
        F.count_distinct(scenario).alias("scenarios"), _sum(F.col(ts).isNull()).alias("missing_timestamps"),
        reduce(lambda a, b: a + b, [F.when(F.min(c) == F.max(c), 1).otherwise(0) for c in cols]).alias("constant_features"),
    ).withColumn("duplicate_keys", repeated_rows(df, keys).scalar())
    names = ["rows", "attack_rows", "normal_rows", "scenarios", "missing_timestamps", "constant_features", "duplicate_keys"]
    return one.select(F.inline(F.array(*[F.struct(F.lit(x).alias("measure"), F.col(x).cast("long").alias("value")) for x in names])))
