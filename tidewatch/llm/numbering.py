"""Gapless numbers for the rows of a table or of each of its groups, without one task holding a group."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.sources.tables import pin

#: Column of row numbers as `rows_once` adds it; an input column of this name is replaced.
ROW = "__row"


def rows_once(docs: DataFrame, stored: bool) -> DataFrame:
    """The rows with a number `ROW` each that every later reading finds again.

    Computed rows (a join, a group, a lost executor's second run) may come in another order and in other partitions each time they
    are asked for, so they are written with their numbers once. `stored` says that the rows are a scan of files, at most filtered
    and projected, that is split alike each time: their numbers are then taken as they are read, and nothing is written.
    """
    numbered = docs.withColumn(ROW, F.monotonically_increasing_id())
    return numbered if stored else pin(numbered)


#: Hash cells a group is cut into; the table of cell counts has at most this many rows per group.
CELLS = 4096


def number_rows(df: DataFrame, by: list[str], group: list[str] | None = None, name: str = "row_number", total: str | None = None,
                cells: int = CELLS) -> DataFrame:
    """Adds `name`, 0, 1, 2, ... over all rows or within each `group`, and `total`, the row count of the group.

    The order is a hash cell of the first column of `by`, then the columns of `by`: it depends on the rows alone, not on files,
    partitions or retries. Rows equal in all of `by` share a run of numbers in any order. A null group is a group. An existing
    column of these names is replaced. The first column of `by` should differ between most rows, as an id does.
    """
    group = group or []
    rows = df.withColumn("__cell", F.pmod(F.xxhash64(by[0]), F.lit(cells)).cast("int"))
    counts = rows.groupBy(*group, "__cell").agg(F.count(F.lit(1)).alias("__n"))
    within = Window.partitionBy(*group)
    starts = counts.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.col("__cell").alias("__c"),
                           (F.sum("__n").over(within.orderBy("__cell")) - F.col("__n")).alias("__start"),
                           F.sum("__n").over(within).alias("__total"))
    if not group:
        starts = F.broadcast(starts)  # at most `cells` rows
    ranked = rows.withColumn("__rank", F.row_number().over(Window.partitionBy(*group, "__cell").orderBy(*by)))
    same = F.col("__cell") == F.col("__c")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    out = ranked.join(starts, same).withColumn(name, F.col("__start") + F.col("__rank") - 1)
    if total:
        out = out.withColumn(total, F.col("__total"))
    return out.drop("__cell", "__c", "__start", "__total", "__rank", *[f"__g{i}" for i in range(len(group))])
