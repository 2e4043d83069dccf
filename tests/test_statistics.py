import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import correlate as c, metrics as m, profile as p
from tidewatch.operators import quantiles as q


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(1)
    parts = {"wide": rng.lognormal(0, 8, 500) * rng.choice([-1, 1], 500), "narrow": 1e6 + rng.random(400) * 1e-3, "ties": rng.integers(0, 3, 300) * 1.0, "one": np.array([4.5])}
    pdf = pd.concat([pd.DataFrame({"g": k, "v": v}) for k, v in parts.items()])
    probs = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    got = q.exact_quantiles(spark.createDataFrame(pdf), ["g"], "v", probs).toPandas().set_index("g")
    for k, v in parts.items():
        for n, pr in probs.items():
            assert got.loc[k, n] == pytest.approx(np.quantile(v, pr), rel=1e-12), (k, n)


def test_quantiles_ignore_null_and_missing_groups(spark):
    df = spark.createDataFrame([("a", None), ("a", 2.0), ("b", None)], "g STRING, v DOUBLE")
    assert [tuple(r) for r in q.exact_quantiles(df, ["g"], "v", {"m": 0.5}).collect()] == [("a", 2.0)]


def test_wide_correlation_with_nulls_and_constants(spark):
    rng = np.random.default_rng(2)
    x = pd.DataFrame(rng.normal(1e5, 1, (400, 12)), columns=[f"c{i}" for i in range(12)])
    x["c3"] = x["c1"] * 2 + 1
    x["c5"] = 3.0
    x = x.mask(rng.random(x.shape) < 0.1)
    got = c.pearson_pairs(spark.createDataFrame(x).select(*[F.nanvl(n, F.lit(None).cast("double")).alias(n) for n in x]), list(x)).toPandas()
    want = x.corr()
    for r in got.itertuples():
        w = want.loc[r.feature_1, r.feature_2]
        assert (math.isnan(w) or "c5" in (r.feature_1, r.feature_2)) and pd.isna(r.correlation) or r.correlation == pytest.approx(w, abs=1e-7)
    assert len(got) == 66


def test_constant_column_has_no_correlation(spark):
    df = spark.range(10).select(F.col("id").cast("double").alias("a"), F.lit(3.0).alias("b"))
    assert c.pearson_pairs(df, ["a", "b"]).first().correlation is None


def test_p_value_of_known_correlation():
    # r = 0.5, n = 12: t = 1.8257 with 10 degrees of freedom, two-sided p = 0.0979
    assert c._t_two_sided(0.5, 12) == pytest.approx(0.0979, abs=2e-4)
    assert c._t_two_sided(0.0, 30) == 1.0 and c._t_two_sided(1.0, 30) == 0.0
    # one degree of freedom (Cauchy): p = 1 - 2/pi * atan(t)
    r = 0.3
    t = r / math.sqrt(1 - r * r)
    assert c._t_two_sided(r, 3) == pytest.approx(1 - 2 / math.pi * math.atan(t), rel=1e-9)


def test_components_of_random_graph(spark):
    rng = np.random.default_rng(3)
    edges = {(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))} | {(100, i) for i in range(101, 130)}
    got = {r.node: r.component for r in c.connected_groups(spark.createDataFrame(list(edges), "feature_1 LONG, feature_2 LONG")).collect()}
    parent = {n: n for e in edges for n in e}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    assert got == {n: find(n) for n in parent}


def prob(spark, rows):
    return spark.createDataFrame(rows, "label STRING, y INT, p DOUBLE")


def test_ties_and_single_class(spark):
    df = prob(spark, [("tied", y, 0.5) for y in (0, 1, 0, 1)] + [("zero", 0, x) for x in (0.1, 0.7)])
    got = {r.label: r for r in m.ranking(df, ["label"], "y", "p").collect()}
    assert got["tied"].roc_auc == 0.5 and got["tied"].average_precision == 0.5
    assert got["zero"].roc_auc is None and got["zero"].average_precision == 0.0


def test_best_threshold_takes_first_of_equal(spark):
    df = prob(spark, [("a", 1, 0.9), ("a", 0, 0.1)])
    best = m.best_threshold(m.threshold_counts(df, ["label"], "y", "p", [0.2, 0.5, 0.95]), ["label"]).first()
    assert (best.best_threshold, best.best_f1) == (0.2, 1.0)


def test_confusion_identities(spark):
    df = spark.range(200).select((F.col("id") % 3 == 0).cast("int").alias("y"), (F.col("id") % 5 == 0).cast("int").alias("h"))
    r = m.confusion(df, [], "y", "h").first()
    assert r.tn + r.fp + r.fn + r.tp == 200 and r.f1 == pytest.approx(2 * r.precision * r.recall / (r.precision + r.recall))


def test_published_detector_metrics_follow_from_counts(spark):
    rows = spark.createDataFrame([(49685, 1330, 2406, 575), (204348, 17645, 5557, 2846)], "tn LONG, fp LONG, fn LONG, tp LONG")
    got = m.add_scores(rows).orderBy("tn").collect()
    assert [round(x.f1, 6) for x in got] == [0.235366, 0.196996] and [round(x.precision, 6) for x in got] == [0.301837, 0.13889]


def test_zero_deviation_shift(spark):
    base = spark.createDataFrame([(3.0,)] * 4, "v DOUBLE")
    other = spark.createDataFrame([(5.0,)] * 4, "v DOUBLE")
    assert p.drift(base, {"o": other}, ["v"]).first().mean_shift is None
    assert p.drift(base, {"o": other}, ["v"], zero_std_as_zero=True).first().mean_shift == 0.0


def test_quality_counts_nan_and_infinite(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("inf"),), (float("-inf"),), (0.0,)], "v DOUBLE")
    r = p.feature_moments(df, ["v"]).first()
    assert (r.rows, r.valid, r.missing, r.infinite, r.zeros) == (5, 2, 1, 2, 1)


def test_missing_numbers_count_alike_for_any_number_of_columns(spark):
    """NaN and infinities are no values: a pair has the same rows and r among 8 columns, among 9, and by itself."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(50, 9))
    x[3, 0], x[7, 0], x[9, 1] = np.nan, np.inf, -np.inf
    df = spark.createDataFrame(pd.DataFrame(x, columns=[f"c{i}" for i in range(9)]))
    found = [{(r.feature_1, r.feature_2): (r.pair_rows, r.correlation) for r in rows.collect()}
             for rows in (c.pearson_pairs(df, df.columns), c.pearson_pairs(df, df.columns[:8]), c.pearson_of(df, [("c0", "c1"), ("c0", "c2")]))]
    fine = np.isfinite(x[:, 0]) & np.isfinite(x[:, 2])
    want = np.corrcoef(x[fine, 0], x[fine, 2])[0, 1]
    assert all(f["c0", "c2"] == (48, pytest.approx(want)) and f["c0", "c1"][0] == 47 for f in found)
    assert all(found[0][k] == (v[0], pytest.approx(v[1])) for k, v in found[1].items())


def test_partial_products_do_not_grow_with_the_splits(spark):
    df = spark.range(4000).selectExpr("id", "rand(1) AS a", "rand(2) AS b").repartition(900)
    assert c.pearson_pairs(df, ["a", "b"]).rdd.getNumPartitions() < 900
    text = c.pearson_pairs(df, ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    assert "Coalesce" in text


def test_spearman_of_ties_nulls_and_hot_values_equals_scipy_free_ranks(spark):
    rng = np.random.default_rng(5)
    n = 1500
    score = np.round(rng.normal(0, 1, n), 1)
    score[rng.random(n) < 0.33] = 0.0
    pdf = pd.DataFrame({"s": score, "tied": rng.integers(0, 4, n) + (score > 0.5), "free": rng.normal(0, 1, n) - score, "flat": 2.0, "none": np.nan})
    data = pdf.astype(object)
    data.loc[rng.random(n) < 0.2, "tied"] = None
    data.loc[rng.random(n) < 0.1, "free"] = None
    data.loc[rng.random(n) < 0.05, "s"] = None
    data["none"] = None
    df = spark.createDataFrame(data.values.tolist(), "s DOUBLE, tied INT, free DOUBLE, flat DOUBLE, none DOUBLE").repartition(7)
    got = {r["feature"]: r["spearman_r"] for r in c.spearman_of(df, ["tied", "free", "flat", "none"], "s").collect()}
    for f in ("tied", "free"):
        both = data[["s", f]].dropna().astype(float)
        assert abs(got[f] - both["s"].rank().corr(both[f].rank())) < 1e-12
    assert got["flat"] is None and got.get("none") is None
    whole = {r["feature"]: r for r in c.score_association(df, ["tied", "none"], "s").collect()}
    assert abs(whole["tied"]["spearman_r"] - got["tied"]) < 1e-12
    assert whole["none"]["rows"] == 0 and whole["none"]["spearman_r"] is None


def test_spearman_joins_rows_once(spark):
    df = spark.range(500).selectExpr("cast(id % 37 as double) AS s", "cast(id % 11 as double) AS a", "cast(id % 5 as double) AS b", "cast(id % 3 as double) AS c")
    plan = c.spearman_of(df, ["a", "b", "c"], "s")._jdf.queryExecution().optimizedPlan().toString()
    # the rows themselves are folded in stored tables: what is left joins two lines per feature
    assert plan.count("Join ") == 1 and "Range" not in plan


def test_equal_columns_by_sums(spark):
    rng = np.random.default_rng(3)
    n = 400
    base = rng.integers(0, 6, n).astype(float)
    holes = lambda v, share: np.where(rng.random(n) < share, None, v)
    few = holes(base, 0.5)
    data = {"a": base, "b": base.copy(), "shuffled": rng.permutation(base), "few": few, "few_again": few.copy(), "other_holes": holes(base, 0.3),
            "late": np.where(np.arange(n) < n - 1, base, base + 1), "zero": np.zeros(n), "minus_zero": -np.zeros(n), "nothing": np.full(n, None),
            "left": np.where(np.arange(n) < n // 2, base, None), "right": np.where(np.arange(n) >= n // 2, base, None)}
    names = list(data)
    rows = [tuple(None if data[x][i] is None else float(data[x][i]) for x in names) for i in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"{x} DOUBLE" for x in names))
    df = df.withColumns({"whole": F.col("a").cast("int"), "text": F.col("a").cast("string"), "text_again": F.col("b").cast("string"), "nan": F.lit(float("nan")), "nan_again": F.lit(float("nan"))})
    want = set()
    frame = df.collect()
    for i, x in enumerate(df.columns):
        for y in df.columns[i + 1:]:
            both = [(r[x], r[y]) for r in frame if r[x] is not None and r[y] is not None]
            if both and all(p == q or (p != p and q != q) for p, q in both) and (x in ("text", "text_again")) == (y in ("text", "text_again")):
                want.add((x, y, len(both)))
    assert {tuple(r) for r in c.equal_columns(df, df.columns).collect()} == want and len(want) > 15
    assert c.equal_columns(df.limit(0), df.columns).count() == 0
    assert c.equal_columns(df, ["a"]).count() == 0


def test_equal_columns_compares_candidates_only(spark):
    wide = spark.range(500).select("id", *[F.xxhash64("id", F.lit(i)).alias(f"c{i}") for i in range(60)]).withColumn("copy", F.col("c7"))
    out = c.equal_columns(wide, [f"c{i}" for i in range(60)] + ["copy"])
    assert out._jdf.queryExecution().optimizedPlan().toString().count("compared") < 10
    assert [tuple(r) for r in out.collect()] == [("c7", "copy", 500)]
