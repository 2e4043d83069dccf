"""All labels at once: logistic fits by their score equations, pooling and sigmoids against plain versions."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.plans import classifier as cl, logistic as lg, pooling as po


def newton(x, y, weight, ridge, rounds=60):
    theta = np.zeros(x.shape[1])
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-x @ theta))
        h = (x * (weight * q * (1 - q))[:, None]).T @ x + np.diag(ridge) + 1e-12 * np.eye(len(theta))
        theta = theta - np.linalg.solve(h, x.T @ (weight * (q - y)) + ridge * theta)
    return theta


@pytest.fixture(scope="module")
def wide(spark):
    """39 labels, one of them constant and some rare, on eight features."""
    rng = np.random.default_rng(11)
    x = rng.normal(0, 1, (1500, 8))
    y = (rng.random((1500, 39)) < 1 / (1 + np.exp(-(x @ rng.normal(0, 1, (8, 39)) + rng.normal(-1, 1, 39))))).astype(int)
    y[:, 7] = 0
    names = [f"y{i}" for i in range(39)]
    pdf = pd.DataFrame(x, columns=list("abcdefgh")).join(pd.DataFrame(y, columns=names)).assign(id=range(1500))
    return cl.vectors(spark.createDataFrame(pdf).repartition(5), list("abcdefgh")).cache(), np.c_[x, np.ones(1500)], y, names


@pytest.mark.parametrize("balanced", [True, False])
def test_all_labels_in_the_same_passes(wide, balanced, monkeypatch):
    df, x, y, names = wide
    passes = []
    sums = lg._sums
    monkeypatch.setattr(lg, "_sums", lambda *a: passes.append(1) or sums(*a))
    model = cl.fit_labels(df, names, balanced, iterations=200)
    assert model.labels == tuple(n for n in names if n != "y7") and len(passes) < 40
    ridge = np.r_[np.ones(8), 0]
    for name, theta in zip(model.labels, model.weights):
        t = y[:, names.index(name)]
        w = np.where(t == 1, 750 / t.sum(), 750 / (1500 - t.sum())) if balanced else np.ones(1500)
        slope = x.T @ (w * (1 / (1 + np.exp(-x @ theta)) - t)) + ridge * theta
        assert np.abs(slope).max() < 1e-4
        assert np.allclose(theta, newton(x, t, w, ridge), atol=1e-4)
    scored = cl.score_labels(df, model, ["id"], names).toPandas()
    assert len(scored) == 38 * 1500
    one = scored[scored.label == "y3"].sort_values("id")
    assert np.allclose(one["p"], 1 / (1 + np.exp(-x @ model.weights[model.labels.index("y3")])))


def test_nothing_to_learn(spark):
    df = cl.vectors(spark.createDataFrame([(1.0, 0, None), (2.0, 0, 1)], "a double, y int, z int"), ["a"])
    assert cl.fit_labels(df, ["y"], True).labels == () and cl.fit_labels(df.limit(0), ["y"], True).labels == ()
    assert cl.fit_labels(df, ["z"], True).labels == ()


def isotonic_by_hand(p, y, w):
    order = np.argsort(p)
    blocks = []
    for i in order:
        blocks.append([p[i], p[i], y[i] * w[i], w[i]])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][3] >= blocks[-1][2] / blocks[-1][3]:
            b = blocks.pop()
            blocks[-1] = [blocks[-1][0], b[1], blocks[-1][2] + b[2], blocks[-1][3] + b[3]]
    return np.array(blocks)


@pytest.mark.parametrize("parts,batch", [(1, 7), (6, 10_000), (40, 3)])
def test_blocks_merge_across_tasks(spark, parts, batch):
    """A hot label lies over all tasks, others inside one; cuts between tasks and batches change nothing."""
    rng = np.random.default_rng(5)
    p = rng.permutation(4000) / 4000
    y = (rng.random(4000) < p**2).astype(int)
    pdf = pd.concat([pd.DataFrame({"label": "hot", "p": p, "y": y}), pd.DataFrame({"label": "up", "p": [0.1, 0.2, 0.3], "y": [0, 0, 1]}),
                     pd.DataFrame({"label": "down", "p": [0.1, 0.2, 0.3], "y": [1, 0, 0]})])
    folded = spark.createDataFrame(pdf).groupBy("label", "p").agg(F.sum("y").cast("double").alias("total"), F.count(F.lit(1)).cast("double").alias("weight"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {k: v.sort_values("low")[["low", "high", "total", "weight"]].to_numpy() for k, v in po.isotonic_blocks(folded).toPandas().groupby("label")}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.shuffle.partitions", old)
    for label, part in pdf.groupby("label"):
        want = isotonic_by_hand(*(part[c].to_numpy(float) for c in ("p", "y")), np.ones(len(part)))
        assert np.allclose(got[label], want)


def test_sigmoids(spark):
    rng = np.random.default_rng(2)
    frames, want = [], {}
    for label, a, b in (("x", -2, 4), ("y", 3, -8), ("rare", -7, 3)):
        p = rng.random(3000).round(3)
        y = (rng.random(3000) < 1 / (1 + np.exp(-(a + b * p)))).astype(int)
        frames.append(pd.DataFrame({"label": label, "p": p, "y": y}))
        want[label] = newton(np.c_[np.ones(3000), p], y, np.ones(3000), np.array([0.0, 1.0]))
    folded = spark.createDataFrame(pd.concat(frames)).groupBy("label", "p").agg(F.sum("y").cast("double").alias("total"), F.count(F.lit(1)).cast("double").alias("weight"))
    got = po.sigmoids(folded, list(want))
    assert all(np.allclose(got[x], want[x], atol=1e-8) for x in want)


def test_final_validation_leaves_seen_rows_out(spark):
    rng = np.random.default_rng(1)
    p = rng.random(900)
    pdf = pd.DataFrame({"id": range(900), "label": "a", "split": np.repeat(["train", "validation", "test"], 300), "p": p, "y": (rng.random(900) < p**2).astype(int)})
    got = cl.final_validation(spark.createDataFrame(pdf), "split", ["a"]).toPandas().set_index("method")
    test = pdf[pdf.split == "test"]
    assert set(got.index) == {"raw", "sigmoid", "isotonic"} and set(got["positives"]) == {test.y.sum()} and set(got["negatives"]) == {300 - test.y.sum()}
    assert np.isclose(got.loc["raw", "brier"], ((test.p - test.y) ** 2).mean())
    fit = pdf[pdf.split == "validation"]
    blocks = isotonic_by_hand(fit.p.to_numpy(), fit.y.to_numpy(float), np.ones(300))
    iso = np.clip(np.interp(test.p, blocks[:, :2].ravel(), np.repeat(blocks[:, 2] / blocks[:, 3], 2)), 1e-7, 1 - 1e-7)
    assert np.isclose(got.loc["isotonic", "brier"], ((iso - test.y) ** 2).mean())
