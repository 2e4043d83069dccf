"""Boosted trees and forests against plain versions, one node at a time."""
import numpy as np
import pandas as pd
import pytest

from tidewatch.checks.models import FEATS, supervised
from tidewatch.plans import trees as tr


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    x = np.c_[rng.normal(0, 1, 400), rng.integers(0, 5, 400), np.full(400, 2.0), rng.random(400).round(1)]
    return x, x[:, 0] ** 2 + 3 * (x[:, 1] > 2) + rng.normal(0, 0.1, 400)


def best_by_hand(codes, y, rows, least, features):
    best = (1e-12, None, None)
    for f in features:
        for c in sorted(set(codes[rows, f].tolist()))[:-1]:
            left = codes[rows, f] <= c
            a, b = y[rows][left], y[rows][~left]
            if min(len(a), len(b)) >= least:
                gain = a.sum() ** 2 / len(a) + b.sum() ** 2 / len(b) - y[rows].sum() ** 2 / len(rows)
                if gain > best[0] + 1e-9:
                    best = (gain, f, c)
    return best


def boosted_by_hand(codes, y, spec):
    total = np.full(len(y), y.mean())
    for _ in range(spec.iterations):
        over = y - total
        leaves = [np.arange(len(y))]
        while len(leaves) < spec.leaves:
            cuts = [best_by_hand(codes, over, r, spec.least, range(codes.shape[1])) for r in leaves]
            at = int(np.argmax([c[0] for c in cuts]))
            if cuts[at][1] is None:
                break
            r = leaves.pop(at)
            left = codes[r, cuts[at][1]] <= cuts[at][2]
            leaves += [r[left], r[~left]]
        for r in leaves:
            total[r] += spec.rate * over[r].mean()
    return total


def test_boosting_equals_a_plain_grower(rows):
    x, y = rows
    spec = tr.Boosting(iterations=6, rate=0.3, leaves=7, least=20)
    codes = tr.encode(x, [tr.edges(x[:, i], spec.bins) for i in range(4)])
    got = sum(t.predict(codes) for t in tr.boost(codes, y, spec))
    assert np.allclose(got, boosted_by_hand(codes, y, spec))
    assert all((t.feature < 0).sum() <= 7 for t in tr.boost(codes, y, spec))


def test_boosting_on_the_table(spark):
    """300 iterations of the fit in tasks give what the same fit gives here."""
    df = supervised(spark, "/root/testdata/sf0.001")
    sample = tr.sample_rows(df, [*FEATS[:5], "target_2"])
    spec = tr.Boosting()
    model = tr.fit_all(spark, [*FEATS[:5], "target_2"], sample, {"k": (FEATS[:5], "target_2", spec)})["k"]
    assert len(model.trees) == 301 and 20 < max((t.feature < 0).sum() for t in model.trees) <= 31
    codes = tr.encode(sample[:, :-1], model.borders)
    few = tr.Boosting(iterations=3)
    assert np.allclose(sum(t.predict(codes) for t in model.trees[:4]), boosted_by_hand(codes, sample[:, -1], few))
    scored = tr.score(df, model, "target_2").toPandas()
    assert len(scored) == len(sample) and np.allclose(np.sort(scored["prediction"]), np.sort(model.predict(sample[:, :-1])))


def forest_tree_by_hand(codes, y, w):
    """A tree that looks at all features: each row's leaf mean."""
    out = np.zeros(len(y))

    def walk(r):
        best = (None, None, None)
        for f in range(codes.shape[1]):
            for c in sorted(set(codes[r, f].tolist()))[:-1]:
                left = codes[r, f] <= c
                gain = sum((w[p] * y[p]).sum() ** 2 / w[p].sum() for p in (r[left], r[~left]))
                if best[0] is None or gain > best[0] + 1e-9:
                    best = (gain, f, c)
        whole = (w[r] * y[r]).sum() ** 2 / w[r].sum()
        if best[0] is None or best[0] <= whole + 1e-9:
            out[r] = (w[r] * y[r]).sum() / w[r].sum()
            return
        left = codes[r, best[1]] <= best[2]
        walk(r[left])
        walk(r[~left])

    walk(np.flatnonzero(w))
    return out


def test_trees_have_no_depth_limit(rows, monkeypatch):
    x, y = rows
    codes = tr.encode(x, [tr.edges(x[:, i], 65_535) for i in range(4)])
    w, rng = tr.bootstrap(1, 0, len(y))
    monkeypatch.setattr(tr.np, "sqrt", lambda v: v)  # every node looks at all features
    tree = tr.grow_whole(codes, y, w, rng)
    monkeypatch.undo()
    drawn = w > 0
    assert np.allclose(tree.predict(codes)[drawn], forest_tree_by_hand(codes, y, w)[drawn])
    deep = np.arange(3000)[:, None]
    line = tr.grow_whole(deep.astype(np.uint16), deep[:, 0] ** 1.5, np.ones(3000, int), np.random.default_rng(0))
    assert (line.feature < 0).sum() == 3000


def test_forest_in_tasks(spark, rows):
    x, y = rows
    df = spark.createDataFrame(pd.DataFrame(np.c_[x, y], columns=[*"abcd", "y"]))
    sample = tr.sample_rows(df, [*"abcd", "y"])
    spec = tr.Forest(trees=9, seed=5)
    model = tr.fit_all(spark, [*"abcd", "y"], sample, {"f": (list("abcd"), "y", spec)})["f"]
    codes = tr.encode(sample[:, :4], model.borders)
    want = np.mean([tr.grow_whole(codes, sample[:, 4], *tr.bootstrap(5, t, len(sample))).predict(codes) for t in range(9)], axis=0)
    assert np.allclose(model.predict(sample[:, :4]), want)
    assert np.corrcoef(want, sample[:, 4])[0, 1] > 0.97


def test_bounded_rows_and_nulls(spark):
    df = spark.range(5000).selectExpr("id AS a", "if(id % 50 = 0, null, id * 2) AS y")
    assert len(tr.sample_rows(df, ["a", "y"], 300)) == 300
    assert np.array_equal(tr.sample_rows(df, ["a", "y"], 300), tr.sample_rows(df.repartition(7), ["a", "y"], 300), equal_nan=True)
    sample = tr.sample_rows(df, ["a", "y"], 300)
    model = tr.fit_all(spark, ["a", "y"], sample, {1: (["a"], "y", tr.Boosting(iterations=5))})[1]
    assert tr.score(df, model, "y").count() == 4900
