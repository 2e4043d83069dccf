"""Correlations, rank correlations, pair tables and groups of correlated features."""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.operators.quantiles import value_cell
from tidewatch.operators.series import Series
from tidewatch.operators.topk import rank_first

#: Partial sums per core that a block product hands on, whatever the number of input splits.
PARTIALS_PER_CORE = 4


def finite(c: str) -> Column:
    """The number, or null where it is NaN or infinite."""
    v = F.col(c).cast("double")
    return F.when(F.abs(v) < float("inf"), v)


def _pearson(n: Column, cov: Column, va: Column, vb: Column) -> Column:
    # a constant side has zero variance: the result is null instead of a division error
    return F.when(n >= 2, F.try_divide(cov, F.sqrt(va) * F.sqrt(vb)))


def pearson_of(df: DataFrame, pairs: list[tuple[str, str]], group: list[str] = ()) -> DataFrame:
    """Pearson r of given column pairs over rows where both are present: one aggregate pass."""
    group, aggs = list(group), []
    for i, (a, b) in enumerate(pairs):
        x, y = finite(a), finite(b)
        both = x.isNotNull() & y.isNotNull()
        x, y = F.when(both, x), F.when(both, y)
        aggs.append(F.struct(
            F.lit(a).alias("feature_1"), F.lit(b).alias("feature_2"), F.count(x).alias("pair_rows"),
            _pearson(F.count(x), F.covar_pop(x, y), F.var_pop(x), F.var_pop(y)).alias("correlation"),
        ).alias(f"_p{i}"))
    wide = df.groupBy(*group).agg(*aggs)
    return wide.select(*group, F.inline(F.array(*[F.col(f"_p{i}") for i in range(len(pairs))])))


def pearson_pairs(df: DataFrame, cols: list[str]) -> DataFrame:
    """All pairs i < j, by block products per Arrow batch; NaN and infinities count as missing.

    A task hands on one partial sum per pair, so input splits are first read by a bounded number of tasks, without a shuffle.
    """
    wide = df.select(*[finite(c).alias(c) for c in cols])
    # one value per column: centre of the data, so that products keep their precision
    centre = np.array(wide.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in cols]).first(), dtype=float)
    f = len(cols)
    iu, ju = np.triu_indices(f, k=1)

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = [np.zeros((f, f)) for _ in range(6)]
        for pdf in batches:
            x = pdf.to_numpy(dtype=float) - centre
            m = np.isfinite(x).astype(float)
            x = np.where(m > 0, x, 0.0)
            sq = x * x
            for a, part in zip(acc, (m.T @ m, x.T @ m, m.T @ x, sq.T @ m, m.T @ sq, x.T @ x)):
                a += part
        n, sx, sy, sxx, syy, sxy = (a[iu, ju] for a in acc)
        yield pd.DataFrame({"i": iu, "j": ju, "n": n, "sx": sx, "sy": sy, "sxx": sxx, "syy": syy, "sxy": sxy})

    schema = "i INT, j INT, n DOUBLE, sx DOUBLE, sy DOUBLE, sxx DOUBLE, syy DOUBLE, sxy DOUBLE"
    tasks = PARTIALS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism
    sums = wide.coalesce(tasks).mapInPandas(blocks, schema).groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    n = F.col("n")
    va, vb = F.col("sxx") - F.col("sx") ** 2 / n, F.col("syy") - F.col("sy") ** 2 / n
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / n
    eps = 1e-12
    flat = (va <= eps * F.col("sxx")) | (vb <= eps * F.col("syy"))
    names = F.array(*[F.lit(c) for c in cols])
    return sums.filter(n > 0).select(
        names[F.col("i")].alias("feature_1"), names[F.col("j")].alias("feature_2"), n.cast("long").alias("pair_rows"),
        F.when(~flat, _pearson(n, cov, F.greatest(va, F.lit(0.0)), F.greatest(vb, F.lit(0.0)))).alias("correlation"),
    )


def high_pairs(pairs: DataFrame, threshold: float = 0.95) -> DataFrame:
    return pairs.withColumn("abs_correlation", F.abs("correlation")).filter(F.col("abs_correlation") >= threshold)


def label_correlation(df: DataFrame, cols: list[str], label: str) -> DataFrame:
    out = pearson_of(df, [(c, label) for c in cols])
    return out.select(F.col("feature_1").alias("feature"), "correlation", F.abs("correlation").alias("abs_correlation"))


def average_ranks(counts: DataFrame, keys: list[str], value: str, n: str, series: Series | None = None) -> DataFrame:
    """Add the average rank of each distinct value per key to a table of (keys, value, how often): ties are folded before any ordering."""
    s = series or Series(keys, [value], cell=value_cell(F.col(value)))
    ranked = s.frame(counts).running_sum("_below", F.col(n), inclusive=False).rows()
    return ranked.select(*counts.columns, (F.col("_below") + (F.col(n) + 1) / 2).alias("rank"))


def _t_two_sided(r: float, n: float) -> float:
    """Two-sided p of a correlation under the t distribution, by the incomplete beta fraction."""
    if r is None or n is None or n < 3 or not math.isfinite(r):
        return float("nan")
    if abs(r) >= 1:
        return 0.0
    dof = n - 2
    x = 1 - r * r  # = dof / (dof + t^2)
    a, b = dof / 2, 0.5
    if r == 0:
        return 1.0
    # log of gamma(a + 1/2) / gamma(a): for long samples by its series, where the difference of two large logarithms would cancel
    ratio = math.lgamma(a + b) - math.lgamma(a) if a < 1e3 else 0.5 * math.log(a) - 1 / (8 * a) + 1 / (192 * a**3)
    front = math.exp(a * math.log1p(-r * r) + 2 * b * math.log(abs(r)) + ratio - math.lgamma(b))

    def fraction(p, q, z):
        c, d = 1.0, 1 - (p + q) * z / (p + 1)
        d = 1 / (d if abs(d) > 1e-300 else 1e-300)
        h = d
        for m in range(1, 500):
            for num in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 / (1 + num * d or 1e-300)
                c = 1 + num / c or 1e-300
                h *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return h

    if x < (a + 1) / (a + b + 2):
        return min(1.0, front * fraction(a, b, x) / a)
    return max(0.0, 1 - front * fraction(b, a, 1 - x) / b)


def add_p_value(df: DataFrame, r: str, n: str, name: str) -> DataFrame:
    """p-values for a correlation table (one row per feature)."""

    @F.pandas_udf("double")
    def p(rs: pd.Series, ns: pd.Series) -> pd.Series:
        return pd.Series([_t_two_sided(float(a), float(b)) for a, b in zip(rs.fillna(np.nan), ns)], dtype=float)

    return df.withColumn(name, F.nanvl(p(F.col(r), F.col(n).cast("double")), F.lit(None).cast("double")))


def spearman_of(df: DataFrame, cols: list[str], score: str) -> DataFrame:
    """(feature, spearman_r) of each column with one score over rows where both are present; null where either is constant.

    It is Pearson on average ranks. All rows of a value share its rank, so the sum of rank products
    needs, for a value, only the sum of its rows' score ranks: rows are folded into counts per
    (feature, score), whose ranks return to the rows by one join on the score that carries the ranks
    for all features, and then into counts and sums per (feature, value). Both folded tables are
    stored, as the look-up of hot features reads them before the ranking does. No row is multiplied
    before a join, and no value, however frequent, is shuffled more than once per task.
    """
    from tidewatch.sources.tables import pin

    at = range(len(cols))
    rows = df.filter(F.col(score).isNotNull()).select(F.col(score).cast("double").alias("_score"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(cols)])
    per_score = rows.groupBy("_score").agg(*[F.count(f"_x{i}").alias(f"_n{i}") for i in at])
    folded = per_score.select("_score", F.inline(F.array(*[F.struct(F.lit(i).alias("_f"), F.col(f"_n{i}").alias("_n")) for i in at]))).filter("_n > 0")
    scores = average_ranks(pin(folded), ["_f"], "_score", "_n")
    wide = scores.groupBy("_score").agg(*[F.max(F.when(F.col("_f") == i, F.col("rank"))).alias(f"_r{i}") for i in at])
    placed = rows.join(wide, "_score").select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("_f"), F.col(f"_x{i}").alias("_x"), F.col(f"_r{i}").alias("_ry")) for i in at]))).filter(F.col("_x").isNotNull())
    values = average_ranks(pin(placed.groupBy("_f", "_x").agg(F.count(F.lit(1)).alias("_n"), F.sum("_ry").alias("_ry"))), ["_f"], "_x", "_n")

    n, rank = F.col("_n").cast("double"), F.col("rank")
    x = values.groupBy("_f").agg(
        F.count(F.lit(1)).alias("_kx"), F.sum(n).alias("_all"), F.sum(n * rank * rank).alias("_xx"), F.sum(rank * F.col("_ry")).alias("_xy"))
    y = scores.groupBy("_f").agg(F.count(F.lit(1)).alias("_ky"), F.sum(n * rank * rank).alias("_yy"))
    # the mean of any ranks with ties is (n + 1) / 2
    mean = F.col("_all") * ((F.col("_all") + 1) / 2) ** 2
    r = F.try_divide(F.col("_xy") - mean, F.sqrt(F.col("_xx") - mean) * F.sqrt(F.col("_yy") - mean))
    r = F.when((F.col("_kx") > 1) & (F.col("_ky") > 1), F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0)))
    names = F.array(*[F.lit(c) for c in cols])
    return x.join(y, "_f").select(names[F.col("_f")].alias("feature"), r.alias("spearman_r"))


def score_association(df: DataFrame, cols: list[str], score: str) -> DataFrame:
    """Pearson and Spearman of each feature with a score and the direction of the relation;
    both are null for a constant feature."""
    pearson = pearson_of(df, [(c, score) for c in cols]).select(F.col("feature_1").alias("feature"), F.col("pair_rows").alias("rows"), F.col("correlation").alias("pearson_r"))
    spearman = spearman_of(df, cols, score)
    way = F.when(F.col("pearson_r") < 0, "lower_score_with_higher_feature").when(F.col("pearson_r") > 0, "higher_score_with_higher_feature")
    out = pearson.join(spearman, "feature", "left").withColumn("score_direction", F.coalesce(way, F.lit("undefined")))
    out = add_p_value(out, "pearson_r", "rows", "pearson_p")
    return add_p_value(out, "spearman_r", "rows", "spearman_p")


def _parts_of(h: Column, parts: int) -> list[Column]:
    """Pieces of 20 bits of a hash: their sums stay far from overflow for any table."""
    return [F.shiftrightunsigned(h, 20 * i).bitwiseAND(F.lit((1 << 20) - 1).cast("long")) for i in range(parts)]


def equal_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Column pairs that never differ where both are present: `feature_1, feature_2, compared`.

    Numbers of any type are compared with each other, other columns with those of their type; -0.0
    equals 0.0 and NaN equals NaN. Pairs without a common row are left out. A first pass sums, per
    column, hashes of the null pattern of the rows where it is null, in no order: columns of equal
    sums are missing in the same rows (but for a clash of 60 bits) and form a mask. A second one sums
    hashes of values per column and mask, over the rows where both are present. Only pairs whose sums
    agree are compared value by value, in the third. Sums and candidates reach the driver: columns
    times masks, whatever the number of rows.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    number = {c: isinstance(types[c], T.NumericType) for c in cols}
    # adding 0.0 turns -0.0 into 0.0
    value = {c: F.col(c).cast("double") + F.lit(0.0) if number[c] else F.col(c) for c in cols}
    at, nothing = {c: i for i, c in enumerate(cols)}, df.sparkSession.createDataFrame([], "feature_1 STRING, feature_2 STRING, compared LONG")

    pattern = F.xxhash64(*[F.col(c).isNull() for c in cols])
    parts = _parts_of(F.col("_p"), 3)
    sums = df.select(*cols, pattern.alias("_p")).agg(*[F.sum(F.when(F.col(c).isNull(), x)).alias(f"_m{at[c]}_{i}") for c in cols for i, x in enumerate(parts)]).first()
    masks: dict[tuple, list[str]] = {}
    for c in cols:
        masks.setdefault(tuple(sums[f"_m{at[c]}_{i}"] for i in range(3)), []).append(c)
    members = list(masks.values())

    seen = [F.col(m[0]).isNotNull() for m in members]
    hashes = {c: _parts_of(F.xxhash64(value[c]), 1)[0] for c in cols}
    found = df.agg(
        *[F.sum(F.when(F.col(c).isNotNull() & seen[k], hashes[c])).alias(f"_s{at[c]}_{k}") for c in cols for k in range(len(members))],
        *[F.count(F.when(seen[j] & seen[k], 1)).alias(f"_n{j}_{k}") for j in range(len(members)) for k in range(j, len(members))],
    ).first()
    pairs = set()
    for j, left in enumerate(members):
        for k in range(j, len(members)):
            if not found[f"_n{j}_{k}"]:
                continue
            kind = lambda c: "number" if number[c] else types[c].simpleString()
            same: dict[tuple, list[str]] = {}
            for c in members[k]:
                same.setdefault((kind(c), found[f"_s{at[c]}_{j}"]), []).append(c)
            pairs |= {tuple(sorted((a, b), key=at.get)) for a in left for b in same.get((kind(a), found[f"_s{at[a]}_{k}"]), []) if a != b}
    if not pairs:
        return nothing
    pairs = sorted(pairs, key=lambda p: (at[p[0]], at[p[1]]))
    items = [
        F.struct(
            F.lit(a).alias("feature_1"), F.lit(b).alias("feature_2"),
            F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)).alias("compared"),
            F.count(F.when(F.col(a) != F.col(b), 1)).alias("different"),
        ).alias(f"_e{i}") for i, (a, b) in enumerate(pairs)
    ]
    flat = df.agg(*items).select(F.inline(F.array(*[F.col(f"_e{i}") for i in range(len(pairs))])))
    return flat.filter((F.col("compared") > 0) & (F.col("different") == 0)).drop("different")


def pair_key(a: Column, b: Column) -> list[Column]:
    """Unordered pair in a canonical order."""
    return [F.least(a, b).alias("feature_1"), F.greatest(a, b).alias("feature_2")]


def family_pairs(pairs: DataFrame, family: Column, other: Column) -> DataFrame:
    """Redundant pairs counted per unordered pair of families."""
    fams = pairs.select(F.least(family, other).alias("family_1"), F.greatest(family, other).alias("family_2"), F.abs("correlation").alias("_r"))
    return fams.groupBy("family_1", "family_2").agg(F.count(F.lit(1)).alias("pairs"), F.max("_r").alias("max_abs_correlation"))


def pivot_samples(long: DataFrame, sample: str, samples: list[str], value: str = "correlation") -> DataFrame:
    """Pair table with one column per sample."""
    keyed = long.select(*pair_key(F.col("feature_1"), F.col("feature_2")), sample, value)
    wide = keyed.groupBy("feature_1", "feature_2").pivot(sample, samples).agg(F.first(value, ignorenulls=True))
    return wide.select("feature_1", "feature_2", *[F.col(f"`{s}`").alias(f"{s}_{value}") for s in samples])


def partners(pairs: DataFrame) -> DataFrame:
    """Per feature: number of partners, strongest partner and the sorted partner list.

    A pair table is bounded by the square of the column count, hence so is a list.
    """
    both = pairs.select(F.col("feature_1").alias("feature"), F.col("feature_2").alias("partner"), "correlation").unionByName(
        pairs.select(F.col("feature_2").alias("feature"), F.col("feature_1").alias("partner"), "correlation"))
    strong = F.struct(F.abs("correlation"), F.col("partner"))
    return both.groupBy("feature").agg(
        F.count(F.lit(1)).alias("high_correlation_count"), F.max(F.abs("correlation")).alias("max_abs_correlation"),
        F.max_by("partner", strong).alias("most_correlated_feature"),
        F.array_join(F.sort_array(F.collect_set("partner")), ";").alias("partners"),
    )


def connected_groups(edges: DataFrame, a: str = "feature_1", b: str = "feature_2", limit: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star steps (Kiveris et al. 2014).

    Both steps take a minimum per node, a map-side combined aggregate, so a node with very
    many edges is no bottleneck. The edge table is written out after every step. Returns
    (node, component); the component is its smallest node.
    """
    from tidewatch.sources.tables import pin

    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    nodes = edges.select(F.col(a).alias("node")).union(edges.select(F.col(b).alias("node"))).distinct()

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        if large:
            near = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:
            near = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        hop = near.join(low, "u")
        if large:
            moved = hop.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            moved = hop.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        return moved.filter("u <> v").distinct()

    e, state = pin(e.distinct()), None
    for _ in range(limit):
        # each step reads its input twice, so it is written out rather than recomputed
        e = pin(star(pin(star(e, large=True)), large=False))
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return nodes.join(roots, "node", "left").withColumn("component", F.coalesce("component", "node"))


def independent_features(features: DataFrame, groups: DataFrame) -> DataFrame:
    """The features of a list (`feature`, ...) that are in no group of at least two."""
    grouped = groups.join(groups.groupBy("component").agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 2"), "component")
    return features.join(grouped.select(F.col("node").alias("feature")), "feature", "left_anti")


def ordered_groups(groups: DataFrame) -> DataFrame:
    """Components of at least two nodes, numbered by size (large first) then name."""
    size = groups.groupBy("component").agg(F.count(F.lit(1)).alias("group_size")).filter("group_size >= 2")
    numbered = rank_first(size, [], "group_size", ["component"], "group_no")
    return groups.join(numbered, "component").select("group_no", "group_size", F.col("node").alias("feature"))
