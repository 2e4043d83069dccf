"""Exact quantiles in two narrow passes, without sorting or collecting a group."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELLS_PER_OCTAVE = 1 << 15


def value_cell(v: Column, per_octave: int = CELLS_PER_OCTAVE) -> Column:
    """Monotone integer cell of a number: equal steps per power of two, mirrored for negatives.

    It depends on the value alone, so every task and every retry agrees on it.
    """
    v = v.cast("double")
    size = F.floor(F.log2(F.abs(v)) * per_octave) + 1100 * per_octave
    return F.when(v > 0, size).when(v < 0, -size).otherwise(F.lit(0)).cast("long")


def unpivot(df: DataFrame, ids: list[str], cols: list[str], name: str = "feature", value: str = "value") -> DataFrame:
    """Tall form (ids, feature, value) of numeric columns."""
    items = [F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in cols]
    return df.select(*ids, F.inline(F.array(*items)))


def _refined(src: DataFrame, keys: list[str], few_groups: bool) -> DataFrame:
    """Cells of all rows: steps per power of two and, inside them, equal parts of the
    group's range, so neither heavy tails nor a narrow range crowd into one cell. Both parts
    grow with the value, hence their pairs are ordered and at most as many as both together."""
    span = src.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    if keys:
        out = src.join(F.broadcast(span) if few_groups else span, keys)
    else:
        out = src.withColumns({c: span.select(c).scalar() for c in ("_lo", "_hi")})
    part = F.floor(F.coalesce(F.try_divide(F.col("_v") - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0)) * (1 << 18)).cast("long")
    return out.withColumn("_cell", F.struct(value_cell(F.col("_v")).alias("a"), part.alias("b"))).drop("_lo", "_hi")


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, probs: dict[str, float], few_groups: bool = False
) -> DataFrame:
    """Linear-interpolated quantiles per group; `probs` maps column names to fractions.

    Pass 1 counts values per monotone cell (map-side combined, no row shuffle). The running
    count finds the cells that hold the wanted positions. Pass 2 reads only those cells and
    counts their distinct values. `few_groups` says the number of groups is bounded by the
    caller (features, labels, datasets): the wanted cells, two per group and fraction, may
    then be broadcast.
    """
    src = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    src = _refined(src, keys, few_groups)
    per_key = Window.partitionBy(*keys)
    before = per_key.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    hist = (
        src.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .withColumn("_all", F.sum("_n").over(per_key))
    )
    wanted = F.array(*[F.struct(F.lit(n).alias("_q"), F.lit(float(p)).alias("_p")) for n, p in probs.items()])
    h = (F.col("_all") - 1) * F.col("_p")
    spots = hist.select("*", F.inline(wanted)).withColumn("_h", h)
    inside = lambda pos: (pos >= F.col("_start")) & (pos < F.col("_start") + F.col("_n"))
    spots = spots.filter(inside(F.floor("_h")) | inside(F.ceil("_h"))).select(*keys, "_cell", "_start", "_q", "_h")
    cells = spots.select(*keys, "_cell").distinct()
    near = src.join(F.broadcast(cells) if few_groups else cells, [*keys, "_cell"])
    in_cell = Window.partitionBy(*keys, "_cell").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    steps = (
        near.groupBy(*keys, "_cell", "_v").agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_b", F.coalesce(F.sum("_c").over(in_cell), F.lit(0)))
    )
    at = steps.join(spots, [*keys, "_cell"])
    from_, to = F.col("_start") + F.col("_b"), F.col("_start") + F.col("_b") + F.col("_c")
    hit = lambda pos: (pos >= from_) & (pos < to)
    ends = at.groupBy(*keys, "_q", "_h").agg(
        F.max(F.when(hit(F.floor("_h")), F.col("_v"))).alias("_lo"), F.max(F.when(hit(F.ceil("_h")), F.col("_v"))).alias("_hi")
    )
    val = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_h") - F.floor("_h"))
    return ends.groupBy(*keys).agg(*[F.max(F.when(F.col("_q") == n, val)).alias(n) for n in probs])


def approximate_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], accuracy: int = 10000) -> DataFrame:
    """One-pass sketch form of `exact_quantiles`, with rank error 1 / accuracy."""
    return df.groupBy(*keys).agg(*[F.percentile_approx(value, p, accuracy).alias(n) for n, p in probs.items()])
