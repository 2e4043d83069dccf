"""Steps that were rewritten to grow no faster than their input, against plain forms."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.plans import detector as dt, trees as tr
from tidewatch.streaming import features as ft, replay as rp


def plain_path(tree, row):
    feature, threshold, left, right, path = tree
    at = 0
    while feature[at] >= 0:
        at = left[at] if row[feature[at]] <= threshold[at] else right[at]
    return path[at]


@pytest.mark.parametrize("features", [1, 2, 5])
def test_paths_of_many_rows_equal_a_walk_row_by_row(features):
    rng = np.random.default_rng(features)
    x = rng.exponential(9, (300, features)).round(1)
    trees = []
    for t in range(7):
        g = dt._grow(x[rng.choice(300, 64)] if t else x[:1], np.random.default_rng(t), 6)  # one tree is a single leaf
        trees.append(tuple(np.array(g[c]) for c in ("feature", "threshold", "left", "right", "path")))
    x[0, 0], x[1, 0], x[2, 0] = np.nan, np.inf, -np.inf
    own = np.concatenate([t[1][t[0] == 0] for t in trees])[:40]
    x[3:3 + len(own), 0] = own  # thresholds themselves go left
    want = [-2.0 ** (-sum(plain_path(t, row) for t in trees) / 7 / 4.5) for row in x]
    assert np.allclose(dt._Paths(trees, features, 4.5).scores(x), want, rtol=1e-14)


def test_rows_without_a_draw_go_before_the_trees_are_gone_through(spark):
    df = spark.range(4000).selectExpr("id", "double(id) AS a", "if(id % 3 = 0, null, double(id)) AS b")
    rows = {"a": 4000, "both": 2666}
    got = dt.forest_samples(df, {"a": ["a"], "both": ["a", "b"]}, ["id"], 20, 16, rows, 42)
    u = {r.id: r.u for r in df.select("id", dt._unit_hash("id", F.lit(42)).alias("u")).collect()}
    want = {}
    for name, n in rows.items():
        chances = dt._draws(20, 1.5 * 16 / n)
        want |= {(name, i): k for i, v in u.items() if (k := sum(c <= v for c in chances)) and (name == "a" or i % 3)}
    assert {(r.subset, r.id): r["count"] for r in got.groupBy("subset", "id").count().collect()} == want
    assert "_u#" in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def readings():
    """Keys of every kind of neighbour: several to a bucket, new ones in later triggers, a missing one, ids that floats cannot hold."""
    rng = np.random.default_rng(1)
    n = 120
    keys = [None if k == 5 else (1 << 60) + int(k) for k in rng.integers(0, 8, n)]
    return [(k, (1 << 60) + i if i % 11 else None, i, float(rng.normal()), "ANOMALY" if rng.random() < 0.7 else "NORMAL") for i, k in enumerate(keys)]


def test_streams_by_bucket_carry_every_key(spark, tmp_path, readings):
    schema = "k LONG, id LONG, step LONG, v DOUBLE, state STRING"
    for a in range(0, 120, 50):
        spark.createDataFrame(readings[a:a + 50], schema).coalesce(1).write.mode("append").parquet(str(tmp_path))
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    windows = rp.run_to_table(ft.stream_temporal_features(read(), "k", ["step"], ["id", "step"], ["v"], buckets=3)).collect()
    streaks = rp.run_to_table(ft.stream_decisions(read(), "k", ["step"], "state", buckets=3)).collect()
    past, runs, want = {}, {}, {}
    for k, i, step, v, state in readings:
        own = past.setdefault(k, [])
        own.append(v)
        runs[k] = runs.get(k, 0) + 1 if state == "ANOMALY" else 0
        want[step] = (k, i, own[-1] - own[-2] if len(own) > 1 else None, np.mean(own[-5:]) if len(own) > 4 else None, runs[k])
    assert len(windows) == len(streaks) == 120
    for r in windows:
        k, i, diff, mean, _ = want[r.step]
        assert (r.k, r.id) == (k, i)
        assert all((g is None and w is None) or abs(g - w) < 1e-12 for g, w in ((r.v__diff, diff), (r.v__mean, mean)))
    assert {r.step: (r.k, r.id, r.streak) for r in streaks} == {s: (w[0], w[1], w[4]) for s, w in want.items()}


@pytest.mark.parametrize("features", [1, 9])
def test_trees_predict_what_a_walk_row_by_row_does(features):
    rng = np.random.default_rng(features)
    codes = rng.integers(0, 65_535, (2000, features), dtype=np.uint16, endpoint=True)
    tree = tr.grow_whole(codes, rng.normal(size=2000), *tr.bootstrap(3, 0, 2000))
    other = np.vstack([codes, rng.integers(0, 65_535, (500, features), dtype=np.uint16, endpoint=True), np.zeros((1, features), np.uint16)])
    want = []
    for row in other:
        at = 0
        while tree.feature[at] >= 0:
            at = tree.left[at] + (row[tree.feature[at]] > tree.code[at])
        want.append(tree.value[at])
    assert np.array_equal(tree.predict(other), want) and len(tree.predict(other[:0])) == 0
    stump = tr.Tree(np.array([-1], np.int16), np.zeros(1, np.uint16), np.zeros(1, np.int32), np.array([2.5]))
    assert (stump.predict(other) == 2.5).all()
