"""Tree models learn from every training row, however many there are."""
import numpy as np
import pandas as pd
import pytest

from tidewatch.operators.series import Series
from tidewatch.plans import forecast as fc, trees as tr

BY_T, ROWS, CUT = Series([], ["t"]), 27_500, 22_000
FOREST, BOOSTING = tr.Forest(trees=2, seed=5), tr.Boosting(iterations=4, rate=0.3, leaves=7)


@pytest.fixture(scope="module")
def table(spark):
    """22,000 rows before the cut. `group` tells `y` and has some 22 of them a value, so that each row counts; some numbers are missing."""
    rng = np.random.default_rng(1)
    group = rng.integers(0, 1000, ROWS)
    x = pd.DataFrame({"t": np.arange(ROWS), "group": group.astype(float), "some": rng.normal(size=ROWS).round(2), "same": 3.0, "y": rng.normal(size=1000)[group] * 9})
    x["z"] = x.some * 2 + rng.normal(size=ROWS)
    x["net power output"] = x.y * 0.9 + x.some
    x.loc[::50, "some"] = None
    x.loc[7::90, "y"] = None
    schema = "t long, group double, some double, same double, y double, z double, `net power output` double"
    return spark.createDataFrame(x.astype(object).where(x.notna(), None), schema).repartition(5)


def by_hand(df, columns, feats, target, spec):
    """Rows, MAE and RMSE after the cut of a model grown here from all rows before it; `columns` are those of the whole grid."""
    at = [columns.index(c) for c in (*feats, target)]
    train, test = (tr.sample_rows(df.filter(f"t {side} {CUT}"), columns)[:, at] for side in ("<", ">="))
    train, test = (m[np.isfinite(m).all(1)] for m in (train, test))
    assert len(train) > 21_000
    borders = [tr.edges(train[:, i], getattr(spec, "bins", len(train))) for i in range(len(feats))]
    codes, other, y = tr.encode(train[:, :-1], borders), tr.encode(test[:, :-1], borders), train[:, -1]
    if isinstance(spec, tr.Forest):
        said = np.mean([tr.grow_whole(codes, y, *tr.bootstrap(spec.seed, t, len(y))).predict(other) for t in range(spec.trees)], axis=0)
    else:
        said = sum(t.predict(other) for t in tr.boost(codes, y, spec))
    return len(test), np.abs(said - test[:, -1]).mean(), np.sqrt(((said - test[:, -1]) ** 2).mean())


def test_forests_learn_from_all_rows(table):
    sets = {"a": ["group", "same"], "b": ["group", "some", "same"]}
    got = fc.benchmark(table, BY_T, sets, ["y", "z"], {"RandomForest": FOREST}).collect()
    assert len(got) == 4
    for r in got:
        want = by_hand(table, ["group", "same", "some", "y", "z"], sets[r.feature_set], r.target, FOREST)
        assert r.rows == want[0] and np.allclose([r.mae, r.rmse], want[1:])


def test_trees_of_any_size_say_what_plain_ones_do(monkeypatch):
    """Nodes split one at a time, then subtrees, against whole trees: all features are looked at, so that draws do not matter."""
    rng = np.random.default_rng(3)
    x = np.c_[rng.normal(size=4000).round(3), rng.integers(0, 5, 4000), np.full(4000, 2)]
    y = x[:, 0] ** 2 + 3 * (x[:, 1] > 2) + rng.normal(0, 0.1, 4000)
    borders = [tr.edges(x[:3000, i], 3000) for i in range(3)]
    codes, other = tr.encode(x[:3000], borders), tr.encode(x[3000:], borders)
    columns, asked = [*codes.T], [*other.T]
    w, _ = tr.bootstrap(1, 0, 3000)
    monkeypatch.setattr(tr.np, "sqrt", lambda v: v)
    want = tr.grow_whole(codes, y[:3000], w, np.random.default_rng(0)).predict(other)
    for limit in (5000, 100, 1):
        monkeypatch.setattr(tr, "SUBTREE_ROWS", limit)
        monkeypatch.setattr(tr, "CHUNK", 300)
        out = np.ones(1000)
        tr._predict_forest_tree(columns, y[:3000], w, np.random.default_rng(0), asked, out)
        assert np.allclose(out, 1 + want)
    flat = np.zeros(1000)
    tr._predict_forest_tree(columns, np.full(3000, 7.0), w, np.random.default_rng(0), asked, flat)
    assert (flat == 7).all()


def test_every_value_of_a_large_column_is_told_apart():
    """More values than 16 bits can number, and a node beyond the size of a subtree."""
    x = np.random.default_rng(0).permutation(70_000).astype(float)
    code = tr._code(x, tr._borders(x, tr.Forest()))
    assert np.array_equal(code, x)
    out = np.zeros(len(x))
    tr._predict_forest_tree([code], x ** 1.5, np.ones(len(x), int), np.random.default_rng(0), [code], out)
    assert np.allclose(out, x ** 1.5)
    with pytest.raises(ValueError):
        tr.encode(x[:, None], [tr._borders(x, tr.Forest())])


def test_boosted_trees_of_the_grid_learn_from_all_rows(table):
    sets = {"a": ["group"], "b": ["group", "some", "same"]}
    models = {"LinearRegression": fc.regressors()["LinearRegression"], "RandomForest": FOREST, "GradientBoosting": BOOSTING}
    grid = fc.benchmark(table, BY_T, sets, ["y", "z"], models).persist()
    got = {(r.feature_set, r.target, r.model): r for r in grid.collect()}
    assert len(got) == 12
    want = {k: by_hand(table, ["group", "some", "same", "y", "z"], sets[k[0]], k[1], models[k[2]]) for k in got if k[2] != "LinearRegression"}
    for k, v in want.items():
        assert got[k].rows == v[0] and np.allclose([got[k].mae, got[k].rmse], v[1:])
    best = {r.target: r for r in fc.best_per_target(grid).collect()}
    for target in ("y", "z"):
        assert best[target].rmse == min(r.rmse for r in got.values() if r.target == target)


def test_safe_and_leaking_models_learn_from_all_rows(table):
    sets = {"all": ["group", "some", "net power output"], "safe": ["group", "some"]}
    models = {"RandomForest": FOREST, "GradientBoosting": BOOSTING}
    got = {r.model: r for r in fc.leakage_safe_comparison(table, BY_T, sets["all"], ["y"], models).collect()}
    assert got.keys() == models.keys()
    for name, r in got.items():
        a, b = (by_hand(table, ["group", "some", "net power output", "y"], sets[s], "y", models[name])[2] for s in ("all", "safe"))
        assert np.allclose([r.rmse_all, r.rmse_safe, r.rmse_change], [a, b, b - a])


def test_fits_without_rows(spark):
    """A fit that lacks training rows says nothing for forests and 0 for boosted trees; one that lacks test rows has none."""
    df = spark.range(100).selectExpr("id AS t", "double(id) AS a", "if(id < 80, null, double(id)) AS late", "if(id < 80, double(id), null) AS early")
    models = {"RandomForest": FOREST, "GradientBoosting": BOOSTING}
    got = {(r.target, r.model): r for r in fc.benchmark(df, BY_T, {"a": ["a"]}, ["late", "early"], models).collect()}
    assert [got["early", m].rows for m in models] == [0, 0]
    assert [got["late", m].rows for m in models] == [20, 20]
    assert np.isnan(got["late", "RandomForest"].rmse) and np.isclose(got["late", "GradientBoosting"].mae, np.arange(80, 100).mean())
