import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.plans import classifier as cl, detector as dt, forecast as fc


def test_least_squares_equal_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (300, 4))
    y = x @ np.array([1.0, -2.0, 0.5, 3.0]) + 7 + rng.normal(0, 0.1, 300)
    pdf = pd.DataFrame(x, columns=list("abcd")).assign(y=y)
    m = fc.fit_linear(spark.createDataFrame(pdf), list("abcd"), "y")
    want = np.linalg.lstsq(np.c_[x, np.ones(300)], y, rcond=None)[0]
    assert np.allclose([*m.coefficients, m.intercept], want)
    scored = fc.score_horizons(spark.createDataFrame(pdf), {2: m}).toPandas()
    assert np.allclose(scored["forecast_2"], np.c_[x, np.ones(300)] @ want)


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(4)
    x = np.r_[rng.normal(0, 1, (980, 3)), rng.normal(8, 1, (20, 3))]
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(id=np.arange(1000), y=[0] * 980 + [1] * 20)
    return spark.createDataFrame(pdf).repartition(6).cache()


def test_forest_flags_the_contamination_share_and_outliers(cloud):
    f = dt.fit_forest(cloud, ["a", "b", "c"], ["id"], trees=60)
    got = f.predict(cloud).toPandas()
    assert (got["prediction"] == 1).sum() == 50
    assert (got.loc[got["y"] == 1, "prediction"] == 1).all()
    assert ((got["decision_score"] + f.offset) <= 0).all() and ((got["decision_score"] + f.offset) >= -1).all()
    assert np.allclose(got["anomaly_score"], -got["decision_score"])


def test_forest_repeats_with_other_partitions(cloud):
    a = dt.fit_forest(cloud, ["a", "b", "c"], ["id"], trees=20).predict(cloud).toPandas().set_index("id")["decision_score"]
    b = dt.fit_forest(cloud.repartition(2), ["a", "b", "c"], ["id"], trees=20).predict(cloud).toPandas().set_index("id")["decision_score"]
    assert np.allclose(a.sort_index(), b.sort_index())


def test_large_table_sampling_gives_each_tree_its_rows(spark):
    big = spark.range(400_000).select("id", F.rand(1).alias("a"))
    n = dt.tree_samples(big, ["a"], ["id"], trees=50, sample=256, rows=400_000, seed=1).groupBy("tree").count().toPandas()
    assert len(n) == 50 and n["count"].min() >= 256


def test_calibration_and_missing_class(spark):
    rng = np.random.default_rng(9)
    p = rng.random(600)
    y = (rng.random(600) < p**2).astype(int)
    pdf = pd.concat([pd.DataFrame({"label": "a", "y": y, "p": p}), pd.DataFrame({"label": "none", "y": 0, "p": p[:50]})])
    df = spark.createDataFrame(pdf)
    out = cl.Calibrators(df, ["a", "none"]).apply(df)
    t = {(r.label, r.method): r for r in cl.calibration_metrics(out).collect()}
    assert t["a", "isotonic"].brier <= t["a", "raw"].brier and t["a", "sigmoid"].log_loss < t["a", "raw"].log_loss
    assert ("none", "sigmoid") not in t
    iso = out.filter("label = 'a'").orderBy("p").toPandas()["isotonic"]
    assert (np.diff(iso) >= -1e-9).all()
    tab = cl.calibrated_table(out, cl.choose_method(cl.calibration_metrics(out)))
    assert tab.filter("label = 'none' AND calibrated IS NOT NULL").count() == 0


def test_balanced_classifier_separates(cloud):
    v = cl.vectors(cl.scale(cloud, cl.scaling(cloud, ["a", "b", "c"])), ["a", "b", "c"])
    s = cl.score_labels(v, cl.fit_labels(v, ["y"], balanced=True), ["id"], ["y"]).toPandas()
    assert s.loc[s.y == 1, "p"].min() > s.loc[s.y == 0, "p"].max()


def _path(tree, row):
    """Path length of one row in one tree, step by step."""
    feature, threshold, left, right, path = tree
    at = 0
    while feature[at] >= 0:
        at = left[at] if row[feature[at]] <= threshold[at] else right[at]
    return path[at]


def _subset_rows(spark):
    rng = np.random.default_rng(12)
    n = 900
    pdf = pd.DataFrame(rng.normal(0, 1, (n, 3)), columns=["a", "b", "c"]).assign(id=np.arange(n))
    pdf["part"] = np.where(pdf["id"] < 600, "train", np.where(pdf["id"] < 750, "t1", "t2"))
    pdf["y"] = ((pdf["id"] % 15 == 0) & (pdf["id"] >= 600)).astype(int)
    pdf.loc[pdf["y"] == 1, ["a", "b"]] += 7
    pdf = pdf.astype({"a": object, "c": object, "y": object, "part": object})
    pdf.loc[pdf["id"] % 50 == 3, "c"] = None
    pdf.loc[pdf["id"] == 700, "y"] = None
    pdf.loc[pdf["id"] == 701, "part"] = None
    return pdf, spark.createDataFrame(pdf, "a DOUBLE, b DOUBLE, c DOUBLE, id LONG, part STRING, y INT").repartition(5)


SUBSETS = {"one": ["a"], "two": ["b", "a"], "all": ["a", "b", "c"]}


def test_forests_of_all_subsets_equal_forests_fitted_alone(spark):
    _, df = _subset_rows(spark)
    train = df.filter("part = 'train'")
    many = dt.grow_forests(train, SUBSETS, ["id"], trees=15, sample=64)
    for name, cols in SUBSETS.items():
        alone = dt.fit_forest(train, cols, ["id"], trees=15, sample=64, contamination=None)
        assert len(many[name].trees) == 15 and many[name].sample == alone.sample == 64
        for a, b in zip(many[name].trees, alone.trees):
            assert all(np.array_equal(p, q) for p, q in zip(a, b))


def test_subset_comparison_equals_plain_path_lengths(spark):
    pdf, df = _subset_rows(spark)
    got = {(r["subset"], r["sample"]): r for r in dt.compare_subsets(df, "part", "train", SUBSETS, ["id"], "y", trees=15, size=64).collect()}
    assert set(got) == {(s, t) for s in SUBSETS for t in ("t1", "t2")}
    forests = dt.grow_forests(df.filter("part = 'train'"), SUBSETS, ["id"], trees=15, sample=64)
    for name, cols in SUBSETS.items():
        whole = pdf.dropna(subset=[*cols, "part"])
        x = whole[cols].to_numpy(dtype=float)
        norm = float(dt._average_path(np.array([64]))[0])
        score = np.array([-(2.0 ** (-sum(_path(t, row) for t in forests[name].trees) / 15 / norm)) for row in x])
        offset = np.quantile(score[(whole["part"] == "train").to_numpy()], 0.05)
        for test in ("t1", "t2"):
            here = ((whole["part"] == test) & whole["y"].notna()).to_numpy()
            y, hit = whole.loc[here, "y"].to_numpy(dtype=int) == 1, score[here] < offset
            r = got[name, test]
            assert (r["tn"], r["fp"], r["fn"], r["tp"]) == ((~y & ~hit).sum(), (~y & hit).sum(), (y & ~hit).sum(), (y & hit).sum())
            assert r["features"] == len(cols)


def test_path_lengths_by_sql_on_stored_trees(spark):
    _, df = _subset_rows(spark)
    cols = SUBSETS["all"]
    forest = dt.fit_forest(df.filter("part = 'train'"), cols, ["id"], trees=8, sample=32)
    nodes = [(t, i, *(int(v) for v in (f, lo, hi)), float(c), float(p))
             for t, (fs, cs, ls, rs, ps) in enumerate(forest.trees) for i, (f, c, lo, hi, p) in enumerate(zip(fs, cs, ls, rs, ps))]
    spark.createDataFrame(nodes, "tree INT, node INT, feature INT, lo INT, hi INT, cut DOUBLE, path DOUBLE").createOrReplaceTempView("stored_nodes")
    whole = df.dropna(subset=cols)
    whole.selectExpr("id", "array(a, b, c) AS x").createOrReplaceTempView("scored_rows")
    depth = int(np.ceil(np.log2(32)))
    level = "SELECT r.id, r.x, n.tree, n.feature, n.lo, n.hi, n.cut, n.path FROM scored_rows r CROSS JOIN stored_nodes n WHERE n.node = 0"
    # leaves are reached by walking down from the root, one join per level
    at = spark.sql(level)
    n = spark.table("stored_nodes")
    for _ in range(depth):
        down = at.selectExpr("id", "x", "tree", "CASE WHEN feature < 0 THEN NULL WHEN x[feature] <= cut THEN lo ELSE hi END AS node", "path AS held")
        at = down.join(n, ["tree", "node"], "left").selectExpr(
            "id", "x", "tree", "coalesce(feature, -1) AS feature", "lo", "hi", "cut", "CASE WHEN node IS NULL THEN held ELSE path END AS path")
    norm = float(dt._average_path(np.array([32]))[0])
    want = {r["id"]: -(2.0 ** (-r["m"] / norm)) for r in at.groupBy("id").agg({"path": "avg"}).toDF("id", "m").collect()}
    got = {r["id"]: r["score_samples"] for r in forest.score(whole).select("id", "score_samples").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_subset_without_rows_is_named(spark):
    _, df = _subset_rows(spark)
    with pytest.raises(ValueError, match="all"):
        dt.grow_forests(df.withColumn("c", F.lit(None).cast("double")), SUBSETS, ["id"], trees=3)
