"""Isolation forest on Spark: sampled fit per tree, Arrow scoring, ablation and candidates."""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.operators import metrics
from tidewatch.operators.quantiles import exact_quantiles
from tidewatch.operators.topk import top_k
from tidewatch.sources.tables import pinned, small_table

TREE_SCHEMA = "subset STRING, tree INT, feature ARRAY<INT>, threshold ARRAY<DOUBLE>, left ARRAY<INT>, right ARRAY<INT>, path ARRAY<DOUBLE>"
_U = float(1 << 53)


def _unit_hash(*cols):
    """Uniform number in [0, 1) from a 64-bit hash of the columns."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(_U)


def _average_path(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary tree of n points."""
    n = np.asarray(n, dtype=float)
    out = np.where(n == 2, 1.0, 0.0)
    big = n > 2
    m = np.where(big, n, 3.0)
    return np.where(big, 2.0 * (np.log(m - 1.0) + np.euler_gamma) - 2.0 * (m - 1.0) / m, out)


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> dict[str, list]:
    """One random tree on a small sample; `path` holds the depth estimate of each leaf."""
    nodes = {"feature": [], "threshold": [], "left": [], "right": [], "path": []}
    stack = [(np.arange(len(x)), 0, -1, "")]
    while stack:
        rows, depth, parent, side = stack.pop()
        me = len(nodes["feature"])
        if parent >= 0:
            nodes[side][parent] = me
        lo, hi = x[rows].min(axis=0), x[rows].max(axis=0)
        open_ = np.flatnonzero(hi > lo)
        leaf = depth >= limit or len(rows) < 2 or not len(open_)
        f = -1 if leaf else int(rng.choice(open_))
        cut = 0.0 if leaf else float(rng.uniform(lo[f], hi[f]))
        nodes["feature"].append(f)
        nodes["threshold"].append(cut)
        nodes["left"].append(-1)
        nodes["right"].append(-1)
        nodes["path"].append(depth + float(_average_path(np.array([len(rows)]))[0]) if leaf else 0.0)
        if not leaf:
            goes = x[rows, f] <= cut
            if goes.all() or not goes.any():
                goes = x[rows, f] <= lo[f]
            stack.append((rows[~goes], depth + 1, me, "right"))
            stack.append((rows[goes], depth + 1, me, "left"))
    return nodes


#: Levels of a tree that are answered for all rows together; below them each row looks up its own node.
TOP = 4


def _below(levels: int) -> np.ndarray:
    """The node reached from node 1 (children of i: 2i and 2i + 1) for each pattern of answers of the nodes above it."""
    nodes = (1 << levels) - 1
    pattern, at = np.arange(1 << nodes), np.ones(1 << nodes, np.int64)
    for _ in range(levels):
        at = 2 * at + (pattern >> (nodes - at) & 1)
    return at


_BELOW = [_below(k) for k in range(TOP + 1)]


class _Paths:
    """Trees made ready for many rows: values become their rank among a feature's thresholds, and every tree is filled up to all
    nodes of its levels, so that a row's next node follows by arithmetic. A forest on one feature is a table of steps."""

    def __init__(self, trees: list[tuple[np.ndarray, ...]], features: int, norm: float):
        self.norm, self.count = norm, len(trees)
        self.cuts = [np.unique(np.concatenate([t[1][t[0] == f] for t in trees])) for f in range(features)]
        never = max(map(len, self.cuts)) + 1  # above every rank: all rows go left
        self.kind, self.trees, self.steps = np.min_scalar_type(never), [], None
        for feature, threshold, left, right, path in trees:
            levels = [np.zeros(1, np.int64)]
            while (feature[levels[-1]] >= 0).any():
                at = levels[-1]
                ends = feature[at] < 0
                levels.append(np.stack([np.where(ends, at, left[at]), np.where(ends, at, right[at])], axis=1).ravel())
            inner = np.concatenate([[0], *levels[:-1]]).astype(np.int64)  # node 1 is the root
            f, rank = feature[inner], np.full(len(inner), never, self.kind)
            for k, cuts in enumerate(self.cuts):
                rank[f == k] = np.searchsorted(cuts, threshold[inner][f == k])
            self.trees.append((len(levels) - 1, np.maximum(f, 0).astype(np.int64), rank, path[levels[-1]]))
        if features == 1:
            self.steps = self._total(np.arange(len(self.cuts[0]) + 1)[None, :].astype(self.kind))

    def _total(self, ranks: np.ndarray) -> np.ndarray:
        """Path lengths of rows (features x rows of ranks), added tree by tree."""
        n, flat = ranks.shape[1], ranks.ravel()
        rows, total, place = np.arange(n), np.zeros(n), np.empty(n, np.int64)
        mine, cut, right, answers = np.empty(n, self.kind), np.empty(n, self.kind), np.empty(n, bool), np.empty(n, np.uint16)
        for depth, feature, rank, path in self.trees:
            top = min(depth, TOP)
            answers[:] = 0
            for node in range(1, 1 << top):
                np.greater(ranks[feature[node]], rank[node], out=right)
                np.left_shift(answers, 1, out=answers)
                np.bitwise_or(answers, right.view(np.uint8), out=answers)
            at, start = _BELOW[top].take(answers), feature * n
            for _ in range(depth - top):
                start.take(at, out=place, mode="clip")
                place += rows
                flat.take(place, out=mine, mode="clip")
                rank.take(at, out=cut, mode="clip")
                np.greater(mine, cut, out=right)
                at += at
                at += right
            at -= 1 << depth
            total += path.take(at)
        return total

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Minus two to the minus mean path length over its expectation, for each row."""
        ranks = np.stack([np.searchsorted(c, x[:, i]).astype(self.kind) for i, c in enumerate(self.cuts)])  # NaN: behind all
        total = self._total(ranks) if self.steps is None else self.steps[ranks[0]]
        return -np.power(2.0, -total / self.count / self.norm)


@dataclass
class IsolationForest:
    features: list[str]
    trees: list[tuple[np.ndarray, ...]]
    sample: int
    offset: float = -0.5

    def paths(self) -> _Paths:
        return _Paths(self.trees, len(self.features), float(_average_path(np.array([self.sample]))[0]))

    def score(self, df: DataFrame, name: str = "score_samples") -> DataFrame:
        """Score per row, low = anomalous. The forest (at most trees x 2 x sample nodes) travels
        with the task; rows are scored per Arrow batch, a tree at a time."""
        feats, paths = self.features, self.paths()
        schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pdf.assign(**{name: paths.scores(pdf[feats].to_numpy(dtype=float))})

        return df.mapInPandas(run, schema)

    def predict(self, df: DataFrame) -> DataFrame:
        """`decision_score` (low = anomalous), its negative `anomaly_score`, prediction and status.
        Rows with an undefined feature (sequence starts) are left out."""
        out = self.score(df.dropna(subset=self.features))
        s = F.col("score_samples") - F.lit(self.offset)
        return out.withColumns({
            "decision_score": s, "anomaly_score": -s, "prediction": F.when(s < 0, 1).otherwise(0),
            "status": F.when(s < 0, "ANOMALY").otherwise("NORMAL"),
        }).drop("score_samples")


def _draws(trees: int, rate: float) -> list[float]:
    """Chances that a row is drawn by at most 0, 1, 2, ... of the trees, each of which draws it at `rate`."""
    if rate >= 1:
        return [0.0] * trees
    chance, total, out = (1 - rate) ** trees, 0.0, []
    for k in range(trees):
        total += chance
        out.append(min(total, 1.0))
        chance *= (trees - k) / (k + 1) * rate / (1 - rate)
    return out


def _defined(cols: list[str]) -> Column:
    """All of the columns hold a number."""
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in cols])


def forest_samples(
    df: DataFrame, subsets: dict[str, list[str]], ident: list[str], trees: int, sample: int, rows: dict[str, int], seed: int
) -> DataFrame:
    """(subset, tree, order, features): a random sample per forest and tree, decided by hashes of
    the row id, so a retried task draws the same rows. One law at every size: each tree draws each
    row at the same rate. How many trees of a forest a row goes to is read off the binomial law by
    one hash, which trees by another; all forests draw in one pass, and rows that none draws are
    filtered before anything is multiplied."""
    feats = list(dict.fromkeys(c for cols in subsets.values() for c in cols))
    base = df.select(*ident, *[F.col(c).cast("double").alias(c) for c in feats])
    chances = {n: _draws(trees, min(1.0, 1.5 * min(sample, rows[n]) / max(rows[n], 1))) for n in subsets}
    # rows whose hash lies below every forest's chance of no draw go before the chances are gone through
    base = base.withColumn("_u", _unit_hash(*ident, F.lit(seed))).filter(F.col("_u") >= min(c[0] for c in chances.values()))
    many = {}
    for i, (name, cols) in enumerate(subsets.items()):
        times = F.size(F.filter(F.array(*[F.lit(c) for c in chances[name]]), lambda c: c <= F.col("_u")))
        many[f"_many{i}"] = F.when(_defined(cols), times).otherwise(0)
    drawn = base.withColumns(many).filter(reduce(lambda a, b: a | b, [F.col(c) > 0 for c in many]))
    strides = [k for k in range(1, trees + 1) if np.gcd(k, trees) == 1]
    first, stride = F.pmod(F.xxhash64(*ident, F.lit(seed + 1)), F.lit(trees)), F.pmod(F.xxhash64(*ident, F.lit(seed + 3)), F.lit(len(strides)))
    drawn = drawn.withColumns({"_first": first, "_step": F.get(F.array(*[F.lit(k) for k in strides]), stride.cast("int"))})

    def marks(name: str, times: Column) -> Column:
        tree = lambda k: F.pmod(F.col("_first") + k * F.col("_step"), F.lit(trees)).cast("int")
        return F.when(times > 0, F.transform(F.sequence(F.lit(0), times - 1), lambda k: F.struct(F.lit(name).alias("subset"), tree(k).alias("tree"))))

    every = F.array(*[marks(n, F.col(c)) for n, c in zip(subsets, many)])
    drawn = drawn.select(*ident, *feats, F.inline(F.flatten(F.array_compact(every))))
    return drawn.withColumn("_o", F.xxhash64(*ident, "tree", F.lit(seed + 2)))


def tree_samples(df: DataFrame, features: list[str], ident: list[str], trees: int, sample: int, rows: int, seed: int) -> DataFrame:
    """(tree, order, features): the samples of one forest."""
    return forest_samples(df, {"": features}, ident, trees, sample, {"": rows}, seed).drop("subset")


def _equal(one: list[tuple[np.ndarray, ...]], two: list[tuple[np.ndarray, ...]]) -> bool:
    return len(one) == len(two) and all(np.array_equal(a, b) for s, t in zip(one, two) for a, b in zip(s, t))


def score_forests(df: DataFrame, forests: dict[str, IsolationForest], keep: list[str]) -> DataFrame:
    """(keep, subset, score_samples) of all forests in one pass; a row that lacks a feature of a
    forest has no score from it. Rows leave narrow, once per forest."""
    parts: list[tuple[list[str], IsolationForest]] = []  # equal forests are walked once
    for n, f in forests.items():
        same = [names for names, g in parts if f.features == g.features and f.sample == g.sample and _equal(f.trees, g.trees)]
        if same:
            same[0].append(n)
        else:
            parts.append(([n], f))
    feats = list(dict.fromkeys(c for _, f in parts for c in f.features))
    plain = df.select(*keep, *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(feats)])
    schema = T.StructType([*df.select(*keep).schema.fields, T.StructField("subset", T.StringType()), T.StructField("score_samples", T.DoubleType())])
    ready = [(names, [feats.index(c) for c in f.features], f.paths()) for names, f in parts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[len(keep):]])
            for names, at, paths in ready:
                whole = ~np.isnan(x[:, at]).any(axis=1)
                kept = batch.select(list(keep)).filter(pa.array(whole)).columns if keep else []
                scores = pa.array(paths.scores(x[whole][:, at]))
                for name in names:
                    yield pa.record_batch([*kept, pa.repeat(name, len(scores)), scores], [*keep, "subset", "score_samples"])

    return plain.mapInArrow(run, schema)


def grow_forests(df: DataFrame, subsets: dict[str, list[str]], ident: list[str], trees: int = 200, sample: int = 256, seed: int = 42) -> dict[str, IsolationForest]:
    """One forest per feature subset, without offsets. The table is read twice, whatever the number
    of subsets: usable rows of all subsets are counted together and all samples drawn together; the
    trees of all forests grow in one stage, one bounded sample per task group."""
    names = list(subsets)
    counts = df.agg(*[F.count(F.when(_defined(subsets[n]), 1)).alias(f"_n{i}") for i, n in enumerate(names)]).first()
    rows = dict(zip(names, counts))
    empty = [n for n in names if not rows[n]]
    if empty:
        raise ValueError(f"no row with all features of {empty}")
    drawn = forest_samples(df, subsets, ident, trees, sample, rows, seed)
    order = [F.asc("_o"), *[F.asc(c) for c in ident]]
    # samples are small but growing is work: a fixed number of tasks, which is not merged by size
    tasks = min(len(names) * trees, 4 * df.sparkSession.sparkContext.defaultParallelism)
    drawn = drawn.repartition(tasks, "subset", "tree")
    kept = top_k(drawn, ["subset", "tree"], order, sample).drop(*ident)
    limit = {n: int(np.ceil(np.log2(max(min(sample, rows[n]), 2)))) for n in names}

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        name, tree = str(key[0]), int(key[1])
        x = pdf.sort_values(["_o", *subsets[name]])[subsets[name]].to_numpy(dtype=float)
        return pd.DataFrame([{"subset": name, "tree": tree, **_grow(x, np.random.default_rng([seed, tree]), limit[name])}])

    grown = kept.groupBy("subset", "tree").applyInPandas(build, TREE_SCHEMA).toArrow().sort_by("tree").combine_chunks()
    out = {n: IsolationForest(list(subsets[n]), [], min(sample, rows[n])) for n in names}
    for i, name in enumerate(grown["subset"].to_pylist()):
        out[name].trees.append(tuple(grown[c][i].values.to_numpy() for c in ("feature", "threshold", "left", "right", "path")))
    return out


def _set_offsets(forests: dict[str, IsolationForest], scores: DataFrame, contamination: float) -> None:
    """Offsets at the contamination quantile of stored training scores, for all forests at once."""
    for row in exact_quantiles(scores, ["subset"], "score_samples", {"q": contamination}, few_groups=True).collect():
        forests[row.subset].offset = float(row.q)


def fit_forest(
    df: DataFrame, features: list[str], ident: list[str], trees: int = 200, sample: int = 256, contamination: float | None = 0.05, seed: int = 42
) -> IsolationForest:
    """Trees grow in parallel, one bounded sample per task group; the offset is the
    contamination quantile of the training scores, which are computed once and stored for it."""
    forests = grow_forests(df, {"": features}, ident, trees, sample, seed)
    if contamination is not None:
        with pinned(score_forests(df, forests, [])) as scores:
            _set_offsets(forests, scores, contamination)
    return forests[""]


def compare_subsets(
    rows: DataFrame, sample: str, train: str, subsets: dict[str, list[str]], ident: list[str], label: str,
    trees: int = 200, size: int = 256, contamination: float = 0.05, seed: int = 42
) -> DataFrame:
    """One forest per feature subset, grown on the rows whose `sample` column says `train`, and its
    confusion scores on each of the other samples.

    The rows are read three times (usable rows, samples, scores), whatever the number of subsets and
    samples; they should be stored, not computed. Scores of all forests on all rows are one narrow
    stored table, from which the offsets and then all confusion counts are taken. Test rows
    without a label count nowhere, rows without a sample are left out; a subset without a test row that has
    all its features has no line for that test.
    """
    forests = grow_forests(rows.filter(F.col(sample) == train), subsets, ident, trees, size, seed)
    used = rows.filter(F.col(sample).isNotNull()).select(
        F.col(sample).alias("sample"), F.coalesce(F.col(label).cast("int"), F.lit(-1)).alias("actual"),
        *dict.fromkeys(c for cols in subsets.values() for c in cols))
    with pinned(score_forests(used, forests, ["sample", "actual"])) as scores:
        _set_offsets(forests, scores.filter(F.col("sample") == train), contamination)
        cuts = F.create_map(*[F.lit(v) for n, f in forests.items() for v in (n, f.offset)])
        called = scores.filter((F.col("sample") != train) & (F.col("actual") >= 0)).withColumn("prediction", F.when(F.col("score_samples") < cuts[F.col("subset")], 1).otherwise(0))
        counts = metrics.confusion(called, ["subset", "sample"], "actual", "prediction").collect()
    # one row per subset and sample
    lines = [(c.subset, len(subsets[c.subset]), c.sample, c.tn, c.fp, c.fn, c.tp, c.precision, c.recall, c.f1, c.accuracy) for c in counts]
    schema = "subset STRING, features INT, sample STRING, tn LONG, fp LONG, fn LONG, tp LONG, precision DOUBLE, recall DOUBLE, f1 DOUBLE, accuracy DOUBLE"
    return small_table(rows.sparkSession, lines, schema)


# fixed values: features taken per family (difference, absolute difference, rolling deviation)
CANDIDATES = {"candidate_A": (0, 10, 10), "candidate_B": (0, 20, 20), "candidate_C": (0, 30, 30), "candidate_D": (10, 10, 10), "candidate_E": (20, 20, 20)}


def reduced_candidates(association: DataFrame, originals: DataFrame, family: str, ranks: list[str], families: list[str], recipe=CANDIDATES) -> DataFrame:
    """Manifest per candidate: all originals plus the best features of each family.

    `association` has `feature`, the family and the ranking columns; both tables hold one row
    per feature.
    """
    order = [*[F.desc(c) for c in ranks], F.asc("feature")]
    best = top_k(association.filter(F.col(family).isin(families)), [family], order, max(max(v) for v in recipe.values()), "place")
    out = None
    for name, counts in recipe.items():
        allowed = F.lit(False)
        for fam, k in zip(families, counts):
            allowed = allowed | ((F.col(family) == fam) & (F.col("place") <= k))
        chosen = best.filter(allowed).select("feature", family).unionByName(originals.select("feature", F.lit("original").alias(family)))
        one = chosen.dropDuplicates(["feature"]).withColumn("candidate", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out
