"""Sorts, limits and per-group leaders."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str | None = None) -> DataFrame:
    """First k rows of each group. Spark limits each group before the exchange, so a hot
    group sends k rows per task."""
    name = rank or "_rank"
    w = Window.partitionBy(*group).orderBy(*order) if group else Window.orderBy(*order)
    if not group:
        # TakeOrdered keeps k rows per task; numbering then touches k rows only.
        df = df.orderBy(*order).limit(k)
    out = df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)
    return out if rank else out.drop(name)


def latest(df: DataFrame, order: list[Column], n: int = 1) -> DataFrame:
    return df.orderBy(*order).limit(n)


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row of each key as one map-side combined aggregate (no sort, no window)."""
    rest = [c for c in df.columns if c not in keys]
    row = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, "_row.*")


def rank_first(df: DataFrame, group: list[str], score: str, ties: list[str], name: str, descending: bool = True) -> DataFrame:
    """Rank 1, 2, 3 … inside a group; equal scores are numbered by the tie columns. Ranks are
    positions along a series ordered by score, so a hot group is cut by score ranges."""
    from tidewatch.operators.quantiles import value_cell
    from tidewatch.operators.series import Series

    keyed = df.withColumn("_by", -F.col(score) if descending else F.col(score))
    out = Series(group, ["_by", *ties], cell=value_cell(F.col("_by"))).frame(keyed).position(name).rows()
    return out.withColumn(name, F.col(name) + 1).drop("_by")


def rank_min(df: DataFrame, group: list[str], score: str, name: str, descending: bool = True) -> DataFrame:
    """Rank inside a group where equal scores share the lowest rank: one more than the rows
    with a better score, counted on distinct scores and joined back."""
    from tidewatch.operators.quantiles import value_cell
    from tidewatch.operators.series import Series

    keyed = df.withColumn("_by", -F.col(score) if descending else F.col(score))
    counts = keyed.groupBy(*group, "_by").agg(F.count(F.lit(1)).alias("_n"))
    better = Series(group, ["_by"], cell=value_cell(F.col("_by"))).frame(counts).running_sum(name, F.col("_n"), inclusive=False).rows()
    out = keyed.join(better.drop("_n"), [*group, "_by"])
    return out.withColumn(name, F.col(name) + 1).drop("_by")


def category_order(df: DataFrame, column: str, categories: list[str], *then: Column) -> DataFrame:
    rank = F.coalesce(F.array_position(F.array(*[F.lit(c) for c in categories]), F.col(column)), F.lit(0))
    return df.orderBy(F.when(rank == 0, len(categories) + 1).otherwise(rank), *then)


def closest_to_reference(df: DataFrame, name: str, reference: str, metric: str, then: list[str]) -> DataFrame:
    """Candidates by their distance to the reference in one metric: distance, rank (ties share
    the lowest) and status; the next columns decide between equal distances. One row per
    candidate."""
    ref = df.filter(F.col(name) == reference).select(metric).scalar()
    is_ref = F.col(name) == reference
    out = df.withColumn("abs_difference", F.when(is_ref, F.lit(0.0)).otherwise(F.abs(F.col(metric) - ref)))
    best = out.filter(~is_ref).agg(F.min_by(name, F.struct("abs_difference", *then, name))).scalar()
    others = Window.partitionBy(is_ref).orderBy("abs_difference")
    return out.withColumns({
        "closeness_rank": F.when(is_ref, 0).otherwise(F.rank().over(others)),
        "selection_status": F.when(is_ref, "FULL_REFERENCE").when(F.col(name) == best, "SELECTED_COMPACT_REFERENCE").otherwise("NOT_SELECTED"),
    })


def evenly_spaced(df: DataFrame, series, k: int) -> DataFrame:
    """At most k rows at evenly spaced positions (first and last included) of an ordered table."""
    from tidewatch.operators.windows import positions

    placed = positions(df, series, "position", "_total")
    n, p = F.col("_total"), F.col("position")
    # position i is picked when some j in 0..k-1 has trunc(j * (n-1) / (k-1)) = i
    if k < 2:
        return placed.filter(p < k).drop("_total")
    j = F.ceil(p * (k - 1) / F.greatest(n - 1, F.lit(1)))
    picked = (j < k) & (F.floor(j * (n - 1) / (k - 1)) == p)
    return placed.filter((n <= k) | picked).drop("_total")


def best_labels(scores: dict[str, Column], k: int = 5) -> Column:
    """Array of structs (rank, label, score): the k highest scores of a row, high first; ties go to the first label. A label
    without a score (null) is left out."""
    items = [F.struct(s.alias("score"), F.lit(-i).alias("o"), F.lit(label).alias("label")) for i, (label, s) in enumerate(scores.items())]
    present = F.filter(F.array(*items), lambda x: x["score"].isNotNull())
    first = F.slice(F.sort_array(present, asc=False), 1, k)
    return F.transform(first, lambda x, i: F.struct((i + 1).cast("int").alias("rank"), x["label"].alias("label"), x["score"].alias("score")))


def argmax(scores: dict[str, Column]) -> Column:
    """Struct (label, score) of the highest score in a row; ties go to the first label."""
    items = [
        F.struct(s.alias("score"), F.lit(-i).alias("o"), F.lit(label).alias("label")) for i, (label, s) in enumerate(scores.items())
    ]
    best = F.array_max(F.array(*items))
    return F.struct(best["label"].alias("label"), best["score"].alias("score"))
