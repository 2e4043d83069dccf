"""Regression trees by leaves or without a depth limit: grown in tasks from all training rows, scored over all rows."""
from __future__ import annotations

import heapq
import io
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.sources.tables import pin, small_batches

#: Rows of a node whose subtree is grown level by level in memory; larger nodes are split one at a time.
SUBTREE_ROWS = 50_000
#: Rows that are looked at together where any number of rows is gone through, and rows of a stored block.
CHUNK, BLOCK_ROWS = 1 << 18, 10_000
#: Trees of a forest that one task grows.
TREES_PER_TASK = 25


@dataclass(frozen=True)
class Boosting:
    """Trees of at most `leaves` leaves, each fitted to what the ones before leave over; leaves are split best first."""

    iterations: int = 300
    rate: float = 0.05
    leaves: int = 31
    least: int = 20
    bins: int = 255


@dataclass(frozen=True)
class Forest:
    """Trees on bootstrapped rows, grown until leaves are pure; each node looks at a random root of the features.

    Cuts lie between any two neighbouring values.
    """

    trees: int = 200
    seed: int = 42


@dataclass(frozen=True)
class Tree:
    """Nodes in arrays: the feature (-1 in leaves), the last code that goes left, the left child (right is next to it), the value."""

    feature: np.ndarray
    code: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def predict(self, codes: np.ndarray) -> np.ndarray:
        """Each node is one number (left child, feature, code), so that a step takes two look-ups; leaves lead to themselves."""
        ends = self.feature < 0
        node = np.where(ends, np.arange(len(ends)), self.left).astype(np.int64) << 32
        node += np.where(ends, 0, self.feature).astype(np.int64) << 16
        node += np.where(ends, 65_535, self.code)
        parts = [self._walk(node, ends, codes[a:a + CHUNK]) for a in range(0, len(codes), CHUNK)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def _walk(self, node: np.ndarray, ends: np.ndarray, codes: np.ndarray) -> np.ndarray:
        flat, out = codes.astype(np.int64).ravel(), np.zeros(len(codes), np.int64)
        rows = np.arange(len(codes))
        first, at, step = rows * codes.shape[1], np.zeros(len(codes), np.int64), 0
        while len(rows):
            here = node.take(at)
            place = here >> 16 & 65_535
            place += first
            right = (here & 65_535) - flat.take(place)
            right >>= 63  # -1 where the row's code is above the node's
            here >>= 32
            here -= right
            at, step = here, step + 1
            if step % 3 == 0:  # rows in leaves are put away now and then
                done = ends.take(at)
                out[rows[done]] = at[done]
                rows, first, at = rows[~done], first[~done], at[~done]
        return self.value[out]


def edges(values: np.ndarray, bins: int) -> np.ndarray:
    """Borders between bins: midpoints of neighbouring values or, with more values than bins, quantiles."""
    known = np.unique(values)
    if len(known) <= bins:
        return (known[:-1] + known[1:]) / 2
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1], method="midpoint"))


def _borders(values: np.ndarray, spec: Boosting | Forest) -> np.ndarray:
    return edges(values, spec.bins if isinstance(spec, Boosting) else max(len(values), 1))


def encode(x: np.ndarray, borders: list[np.ndarray]) -> np.ndarray:
    """Column by column, the number of borders below each value."""
    if any(len(b) > 65_535 for b in borders):
        raise ValueError("more than 65,536 different values in a column: `predictions` takes them")
    return np.stack([np.searchsorted(b, x[:, i], side="left") for i, b in enumerate(borders)], axis=1).astype(np.uint16)


def _best_cut(sums: np.ndarray, counts: np.ndarray, least: int) -> tuple[float, int, int]:
    """Gain, feature and last left bin of the best split of a histogram (features x bins)."""
    ls, ln = sums.cumsum(1), counts.cumsum(1)
    s, n = ls[:, -1:], ln[:, -1:]
    rs, rn = s - ls, n - ln
    fits = (ln >= least) & (rn >= least)
    gain = np.where(fits, ls * ls / np.maximum(ln, 1) + rs * rs / np.maximum(rn, 1) - s * s / np.maximum(n, 1), -np.inf)
    at = int(gain.argmax())
    return float(gain.flat[at]), at // sums.shape[1], at % sums.shape[1]


def grow_by_leaves(codes: np.ndarray, y: np.ndarray, spec: Boosting) -> tuple[Tree, dict[int, np.ndarray]]:
    """The tree and the rows of its leaves. The leaf with the largest gain is split next; of two new leaves the smaller is summed and
    the larger is what is left."""
    features, width = codes.shape[1], int(codes.max(initial=0)) + 1

    def histogram(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sums, counts = np.zeros((features, width)), np.zeros((features, width), np.int64)
        for a in range(0, len(rows), CHUNK):
            some = rows[a:a + CHUNK]
            over = y[some]
            for f in range(features):
                at = codes[some, f]
                sums[f] += np.bincount(at, over, width)
                counts[f] += np.bincount(at, minlength=width)
        return sums, counts

    nodes = [(-1, 0, 0, y.mean())]
    held = {0: np.arange(len(y), dtype=np.int32 if len(y) < 1 << 31 else np.int64)}
    heap = []

    def offer(node: int, hist) -> None:
        gain, feature, code = _best_cut(*hist, spec.least)
        if gain > 1e-12:
            heapq.heappush(heap, (-gain, node, feature, code, hist))

    offer(0, histogram(held[0]))
    while heap and len(held) < spec.leaves:
        _, node, feature, code, hist = heapq.heappop(heap)
        rows = held.pop(node)
        right = codes[rows, feature] > code
        parts = rows[~right], rows[right]
        small = int(len(parts[1]) < len(parts[0]))
        one = histogram(parts[small])
        rest = hist[0] - one[0], hist[1] - one[1]
        left = len(nodes)
        nodes[node] = (feature, code, left, nodes[node][3])
        nodes += [(-1, 0, 0, y[p].mean()) for p in parts]
        for side in (0, 1):
            held[left + side] = parts[side]
            offer(left + side, one if side == small else rest)
    feature, code, left, value = zip(*nodes)
    return Tree(np.array(feature, np.int16), np.array(code, np.uint16), np.array(left, np.int32), np.array(value)), held


def boost(codes: np.ndarray, y: np.ndarray, spec: Boosting) -> list[Tree]:
    """The first tree is the mean; the others count `rate` times."""
    trees = [Tree(np.array([-1], np.int16), np.zeros(1, np.uint16), np.zeros(1, np.int32), np.array([y.mean()]))]
    codes, left_over = np.asfortranarray(codes), y - y.mean()
    for _ in range(spec.iterations):
        t, held = grow_by_leaves(codes, left_over, spec)
        t = Tree(t.feature, t.code, t.left, t.value * spec.rate)
        for node, rows in held.items():
            left_over[rows] -= t.value[node]
        trees.append(t)
    return trees


def _level_cuts(codes, y, w, node, count, wanted) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each node of a level, the best split among its wanted features: score, feature, last left code."""
    best, feature, code = np.full(count, -np.inf), np.full(count, -1), np.zeros(count, np.int64)
    for f in range(codes.shape[1]):
        rows = np.flatnonzero(wanted[node, f])
        if not len(rows):
            continue
        key, bits = (node[rows] << 16) + codes[rows, f], len(rows).bit_length()
        if count.bit_length() + 16 + bits < 63:  # with the place in the same number, sorting numbers is a stable sort
            rows = rows[np.sort((key << bits) + np.arange(len(rows))) & (1 << bits) - 1]
        else:
            rows = rows[np.argsort(key, kind="stable")]
        at, c = node[rows], codes[rows, f]
        fresh, cut = np.ones(len(rows), bool), np.zeros(len(rows), bool)
        fresh[1:] = at[1:] != at[:-1]
        cut[:-1] = ~fresh[1:] & (c[1:] != c[:-1])
        first = np.flatnonzero(fresh)
        last = np.append(first[1:], len(rows)) - 1
        run = np.repeat(np.arange(len(first)), last - first + 1)
        weight = w[rows]
        sums, weight = np.cumsum(weight * y[rows]), np.cumsum(weight)
        base_s, base_n = np.zeros(len(first)), np.zeros(len(first))
        base_s[1:], base_n[1:] = sums[last[:-1]], weight[last[:-1]]
        ls, ln = sums - base_s[run], weight - base_n[run]
        rs, rn = (sums[last] - base_s)[run] - ls, (weight[last] - base_n)[run] - ln
        score = np.where(cut, ls * ls / ln + rs * rs / np.maximum(rn, 1), -np.inf)
        top = np.maximum.reduceat(score, first)
        where = np.flatnonzero((score == top[run]) & cut)
        if len(where):  # the first of equal scores
            where = where[np.append(True, run[where[1:]] != run[where[:-1]])]
        better = where[score[where] > best[at[where]]]
        best[at[better]], feature[at[better]], code[at[better]] = score[better], f, c[better]
    return best, feature, code


def grow_whole(codes: np.ndarray, y: np.ndarray, w: np.ndarray, rng: np.random.Generator) -> Tree:
    """All nodes of a level at once, until no node can be split; rows count `w` times."""
    use = np.flatnonzero(w)
    codes, w = codes[use], w[use].astype(float)
    centre = np.average(y[use], weights=w)
    y = y[use] - centre
    features, some = codes.shape[1], max(1, int(np.sqrt(codes.shape[1])))
    level, parts = [np.array([-1]), np.array([0]), np.array([0]), np.array([centre])], []
    node, rows, ids, total = np.zeros(len(use), np.int64), np.arange(len(use)), np.array([0]), 1
    while len(ids):
        m = len(ids)
        wanted = rng.random((m, features)).argsort(1) < some
        n = np.bincount(node, w[rows], m)
        over = y[rows] - (np.bincount(node, w[rows] * y[rows], m) / n)[node]  # around the node's mean, so that sums stay exact enough
        best, feature, code = _level_cuts(codes[rows], over, w[rows], node, m, wanted)
        again = feature < 0  # the drawn features have one value here: look at the others
        if again.any() and some < features:
            more = _level_cuts(codes[rows], over, w[rows], node, m, ~wanted & again[:, None])
            best, feature, code = (np.where(again, b, a) for a, b in zip((best, feature, code), more))
        split = (feature >= 0) & (best > 1e-12)
        kids = np.full(m, -1)
        kids[split] = np.arange(split.sum()) * 2
        level[0][split], level[1][split], level[2][split] = feature[split], code[split], total + kids[split]
        parts.append(level)
        stays = split[node]
        rows, node = rows[stays], node[stays]
        node = kids[node] + (codes[rows, feature[node]] > code[node])
        fresh = int(split.sum()) * 2
        means = np.bincount(node, w[rows] * y[rows], fresh) / np.maximum(np.bincount(node, w[rows], fresh), 1) + centre
        level = [np.full(fresh, -1), np.zeros(fresh, int), np.zeros(fresh, int), means]
        ids, total = total + np.arange(fresh), total + fresh
    flat = [np.concatenate([p[i] for p in parts]) for i in range(4)]
    return Tree(flat[0].astype(np.int16), flat[1].astype(np.uint16), flat[2].astype(np.int32), flat[3].astype(np.float64))


def bootstrap(seed: int, tree: int, rows: int) -> tuple[np.ndarray, np.random.Generator]:
    """How often each row is drawn for a tree, and the tree's own generator."""
    rng = np.random.default_rng([seed, tree])
    return np.bincount(rng.integers(0, rows, rows), minlength=rows), rng


def _plain(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(c) for c in columns])


def _by_hash(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in an order that does not depend on how the table is split, as bootstraps draw rows by their number."""
    return _plain(df, columns).orderBy(F.xxhash64(*columns), *columns)


def sample_rows(df: DataFrame, columns: list[str], limit: int | None = None) -> np.ndarray:
    """All rows of a small table as a matrix, or the `limit` rows with the least hash of their values."""
    least = _by_hash(df, columns)
    least = least if limit is None else least.limit(limit)
    return np.column_stack([c.to_numpy() for c in least.toArrow().columns]).astype(float).reshape(-1, len(columns))


@dataclass(frozen=True)
class Fitted:
    """A fit's features, borders and trees; `mean` says whether trees are averaged or summed."""

    features: tuple[str, ...]
    borders: list[np.ndarray]
    trees: list[Tree]
    mean: bool

    def predict(self, x: np.ndarray) -> np.ndarray:
        codes = encode(x, self.borders)
        total = np.zeros(len(x))
        for t in self.trees:
            total += t.predict(codes)
        return total / len(self.trees) if self.mean else total


def _pack(tree: Tree) -> bytes:
    out = io.BytesIO()
    np.savez(out, feature=tree.feature, code=tree.code, left=tree.left, value=tree.value)
    return out.getvalue()


def _unpack(data: bytes) -> Tree:
    with np.load(io.BytesIO(data)) as z:
        return Tree(z["feature"], z["code"], z["left"], z["value"])


def fit_all(spark, columns: list[str], sample: np.ndarray, fits: dict[tuple, tuple[list[str], str, Boosting | Forest]]) -> dict[tuple, Fitted]:
    """All fits (features, target, model) of a small table's grid in one job: a task per boosted fit and per some trees of a forest.

    `sample` is a matrix that driver and tasks hold (see `sample_rows`) and all trees come to the driver; `predictions` is for tables of
    any size. Rows with a null in a fit's columns are left out of that fit. A lost task grows its trees again from the same numbers.
    """
    place = {c: i for i, c in enumerate(columns)}
    shared = spark.sparkContext.broadcast(sample)

    def data(key):
        features, target, spec = fits[key]
        part = shared.value[:, [place[c] for c in (*features, target)]]
        part = part[np.isfinite(part).all(1)]
        return part[:, :-1], part[:, -1], spec

    keys, tasks = list(fits), []
    for i, k in enumerate(keys):
        spec = fits[k][2]
        tasks += [(i, -1)] if isinstance(spec, Boosting) else [(i, t) for t in range(spec.trees)]

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {}
        for batch in batches:
            for fit, tree in zip(batch["fit"].to_pylist(), batch["tree"].to_pylist()):
                if fit not in held:
                    x, y, spec = data(keys[fit])
                    held = {fit: (encode(x, [_borders(x[:, i], spec) for i in range(x.shape[1])]), y, spec)}
                codes, y, spec = held[fit]
                if not len(y):
                    continue
                if isinstance(spec, Boosting):
                    grown = list(enumerate(boost(codes, y, spec)))
                else:
                    w, rng = bootstrap(spec.seed, tree, len(y))
                    grown = [(tree, grow_whole(codes, y, w, rng))]
                for t, g in grown:
                    yield pa.record_batch([pa.array([fit], pa.int32()), pa.array([t], pa.int32()), pa.array([_pack(g)])], ["fit", "tree", "nodes"])

    todo = spark.createDataFrame(tasks, "fit int, tree int").repartition(max(1, min(len(tasks), 8 * len(keys))), "fit", F.floor(F.col("tree") / 25))
    grown: dict[int, list] = {i: [] for i in range(len(keys))}
    for fit, tree, nodes in todo.mapInArrow(grow, "fit int, tree int, nodes binary").collect():
        grown[fit].append((tree, bytes(nodes)))
    out = {}
    for i, k in enumerate(keys):
        x, _, spec = data(k)
        borders = [_borders(x[:, j], spec) for j in range(x.shape[1])]
        out[k] = Fitted(tuple(fits[k][0]), borders, [_unpack(n) for _, n in sorted(grown[i])], isinstance(spec, Forest))
    shared.unpersist()
    return out


def _predict_forest_tree(codes: list[np.ndarray], y: np.ndarray, w: np.ndarray, rng: np.random.Generator, asked: list[np.ndarray], out: np.ndarray) -> None:
    """Grow a tree on any number of rows and add what it says of the asked rows to `out`; nothing of the tree is kept.

    A node with more than SUBTREE_ROWS drawn rows is split by its rows' sums per code, as `grow_whole` splits it by sorted rows; the
    training and the asked rows of a smaller one go to `grow_whole` together, their codes numbered anew. `codes` and `asked` are columns.
    """
    features, some = len(codes), max(1, int(np.sqrt(len(codes))))
    short = lambda n: np.int32 if n < 1 << 31 else np.int64
    todo = [(np.flatnonzero(w).astype(short(len(y))), np.arange(len(out), dtype=short(len(out))))]
    while todo:
        rows, there = todo.pop()
        if len(rows) <= SUBTREE_ROWS:
            known, own = zip(*[np.unique(c[rows], return_inverse=True) for c in codes])
            tree = grow_whole(np.stack(own, axis=1).astype(np.uint16), y[rows], w[rows], rng)
            for a in range(0, len(there), CHUNK):
                at = there[a:a + CHUNK]
                out[at] += tree.predict(np.stack([np.searchsorted(k, c[at]) for k, c in zip(known, asked)], axis=1).astype(np.uint16))
            continue
        weight = w[rows].astype(float)
        centre = np.average(y[rows], weights=weight)
        over = weight * (y[rows] - centre)
        wanted = rng.random(features).argsort() < some
        best = (1e-12, -1, 0)
        for group in (np.flatnonzero(wanted), np.flatnonzero(~wanted)):
            if best[1] >= 0:  # the other features are looked at only where the drawn ones have one value here
                break
            for f in group:
                c = codes[f][rows]
                ls, ln = np.bincount(c, over).cumsum(), np.bincount(c, weight).cumsum()
                rs, rn = ls[-1] - ls, ln[-1] - ln
                cut = (ln > 0) & (rn > 0)
                if cut.any():
                    gain = np.where(cut, ls * ls / np.maximum(ln, 1) + rs * rs / np.maximum(rn, 1), -np.inf)
                    at = int(gain.argmax())
                    if best[1] < 0 or gain[at] > best[0]:
                        best = (float(gain[at]), int(f), at)
        if best[1] < 0 or best[0] <= 1e-12:
            out[there] += centre
            continue
        _, f, code = best
        right, over_there = codes[f][rows] > code, asked[f][there] > code
        todo += [(rows[right], there[over_there]), (rows[~right], there[~over_there])]


def _blocks(df: DataFrame, columns: list[str], kind: int) -> DataFrame:
    """`kind, block` and a column's numbers as bytes, some rows to a block, in the order of the table; written once."""
    names = ["kind", "block", *[f"c{i}" for i in range(len(columns))]]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK_ROWS):
                part = [c.to_numpy(zero_copy_only=False).astype(float).tobytes() for c in batch.slice(a, BLOCK_ROWS).columns]
                yield pa.record_batch([pa.array([kind], pa.int32()), pa.array([block]), *[pa.array([c], pa.binary()) for c in part]], names)
                block += 1

    return pin(df.mapInArrow(cut, "kind int, block long, " + ", ".join(f"{c} binary" for c in names[2:])))


class _Held:
    """The rows a task has been passed, without those that lack a number; columns that floats of half the size hold exactly are kept so."""

    def __init__(self):
        self.blocks: dict[int, list[np.ndarray]] = {}

    def add(self, block: int, columns: list[bytes]) -> None:
        x = [np.frombuffer(c) for c in columns]
        whole = np.logical_and.reduce([np.isfinite(c) for c in x])
        kept = [c[whole] for c in x]
        with np.errstate(over="ignore"):
            halves = [c.astype(np.float32) for c in kept]
        self.blocks[block] = [h if np.array_equal(h, c) else c for h, c in zip(halves, kept)]

    def order(self) -> list[int]:
        return sorted(self.blocks)

    def take(self, column: int) -> np.ndarray:
        """A column in the order of the blocks; it is given out once."""
        parts = []
        for b in self.order():
            parts.append(self.blocks[b][column].astype(float))
            self.blocks[b][column] = None
        return np.concatenate(parts) if parts else np.zeros(0)


def _code(values: np.ndarray, borders: np.ndarray) -> np.ndarray:
    return np.searchsorted(borders, values, side="left").astype(np.min_scalar_type(len(borders)))


def predictions(train: DataFrame, test: DataFrame, columns: list[str], fits: dict[tuple, tuple[list[str], str, Boosting | Forest]]) -> dict[tuple, DataFrame]:
    """`label, prediction` of all test rows for every fit (features, target, model), each learned from all training rows.

    One job, a task per boosted fit and per TREES_PER_TASK trees of a forest. Every task reads the stored rows, a block at a time, and
    holds its fit's columns. Boosted models are small and come to the driver. A forest's trees have about as many nodes as there are
    rows; a task drops each of them when it has scored the test rows, so sums per test row leave the task. Rows with a null in a fit's
    columns are left out of that fit. A lost task grows the same trees again.
    """
    spark, keys, place = train.sparkSession, list(fits), {c: i for i, c in enumerate(columns)}
    specs = [fits[k][2] for k in keys]
    wanted = [[place[c] for c in (*fits[k][0], fits[k][1])] for k in keys]
    tasks = [(i, 0) for i, spec in enumerate(specs) if isinstance(spec, Boosting)]
    tasks += [(i, t) for i, spec in enumerate(specs) if isinstance(spec, Forest) for t in range(0, spec.trees, TREES_PER_TASK)]
    names = ["fit", "tree", "block", "label", "data"]

    def line(fit: int, tree: int, block: int, label: bytes | None, data: bytes) -> pa.RecordBatch:
        return pa.record_batch([pa.array([fit], pa.int32()), pa.array([tree], pa.int32()), pa.array([block], pa.int64()), pa.array([label], pa.binary()), pa.array([data], pa.binary())], names)

    def boosted(fit: int, rows: _Held) -> Iterator[pa.RecordBatch]:
        y = rows.take(len(wanted[fit]) - 1)
        borders, codes = [], []
        for i in range(len(wanted[fit]) - 1):
            x = rows.take(i)
            borders.append(_borders(x, specs[fit]))
            codes.append(_code(x, borders[-1]))
        for i, b in enumerate(borders):
            yield line(fit, i, -2, None, b.tobytes())
        for t, tree in enumerate(boost(np.stack(codes, axis=1), y, specs[fit]) if len(y) else []):
            yield line(fit, t, -1, None, _pack(tree))

    def forest(fit: int, first: int, rows: _Held, other: _Held) -> Iterator[pa.RecordBatch]:
        last = len(wanted[fit]) - 1
        sizes = [(b, len(other.blocks[b][last])) for b in other.order()]
        y, label = rows.take(last), other.take(last)
        codes, asked = [], []
        for i in range(last):
            x = rows.take(i)
            borders = _borders(x, specs[fit])
            codes.append(_code(x, borders))
            asked.append(_code(other.take(i), borders))
        out = np.zeros(len(label)) if len(y) else np.full(len(label), np.nan)
        for tree in range(first, min(first + TREES_PER_TASK, specs[fit].trees) if len(y) else first):
            w, rng = bootstrap(specs[fit].seed, tree, len(y))
            _predict_forest_tree(codes, y, w, rng, asked, out)
        a = 0
        for block, n in sizes:
            if n:
                yield line(fit, first, block, None if first else label[a:a + n].tobytes(), out[a:a + n].tobytes())
            a += n

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[_Held, _Held]] = defaultdict(lambda: (_Held(), _Held()))
        for batch in batches:
            for task, kind, block, *cells in zip(*[batch[c] for c in ("task", "kind", "block", *[f"c{i}" for i in range(len(columns))])]):
                fit = tasks[task.as_py()][0]
                if kind.as_py() == 0 or isinstance(specs[fit], Forest):
                    held[task.as_py()][kind.as_py()].add(block.as_py(), [cells[i].as_py() for i in wanted[fit]])
        for task, (rows, other) in held.items():
            fit, first = tasks[task]
            yield from boosted(fit, rows) if isinstance(specs[fit], Boosting) else forest(fit, first, rows, other)

    stored = _blocks(_by_hash(train, columns), columns, 0).unionByName(_blocks(_plain(test, columns), columns, 1))
    # a partition per task; each of them goes through the stored blocks, which are neither shuffled nor held by the JVM
    each = spark.range(0, len(tasks), 1, len(tasks)).withColumnRenamed("id", "task").hint("shuffle_replicate_nl")
    with small_batches(spark, 8):
        done = pin(stored.coalesce(1).crossJoin(each).mapInArrow(grow, "fit int, tree int, block long, label binary, data binary"))

    def total(parts: pa.Table) -> pa.Table:
        parts = parts.sort_by("tree")
        fit, label = parts["fit"][0].as_py(), np.frombuffer(parts["label"][0].as_py())
        sums = np.zeros(len(label))
        for p in parts["data"]:
            sums += np.frombuffer(p.as_py())
        return pa.table([pa.array([fit] * len(label), pa.int32()), pa.array(label), pa.array(sums / specs[fit].trees)], ["fit", "label", "prediction"])

    out, models = {}, defaultdict(list)
    for r in done.filter("block < 0").orderBy("fit", "block", "tree").collect():
        models[r.fit].append(np.frombuffer(r.data) if r.block == -2 else _unpack(bytes(r.data)))
    scored = pin(done.filter("block >= 0").groupBy("fit", "block").applyInArrow(total, "fit int, label double, prediction double"))
    for i, k in enumerate(keys):
        if isinstance(specs[i], Boosting):
            n, parts = len(fits[k][0]), models[i] or [np.zeros(0)] * len(fits[k][0])
            out[k] = score(test, Fitted(tuple(fits[k][0]), parts[:n], parts[n:], False), fits[k][1])
        else:
            out[k] = scored.filter(F.col("fit") == i).select("label", "prediction")
    return out


def score(df: DataFrame, model: Fitted, target: str) -> DataFrame:
    """`label, prediction` of all rows without nulls, in one pass; the model is held by every task."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            x = x[np.isfinite(x).all(1)]
            yield pa.record_batch([pa.array(x[:, -1]), pa.array(shared.value.predict(x[:, :-1]))], ["label", "prediction"])

    rows = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate((*model.features, target))])
    return rows.mapInArrow(predict, "label double, prediction double")
