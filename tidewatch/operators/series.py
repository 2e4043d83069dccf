"""Ordered work on keyed series that stays balanced when one key holds most rows.

A window partitioned by the series key puts a whole series into one task. `Series`
first looks for series above `target_rows` and cuts only those into time chunks:

* cells: rows are counted per (key, cell), where `cell` is a coarse monotone function of
  the order column. The count is a map-side combined aggregate over two narrow columns.
* chunks: consecutive cells of a hot series are grouped by their running row count, so a
  burst gets more chunks than a quiet month.
* parts: a cell that alone is above the target (all rows in one second, say) is cut by the
  whole order key, at bounds taken from a range partitioning of its rows.
* halo: a window that looks k rows back needs the last k rows before its chunk. They are
  fetched by exact row position, hence short or empty neighbours are handled too.
* carry: running sums and positions add the totals of the earlier chunks.

The counts are taken at every table size. When no series is above the target (the usual case)
the frame is the input itself and the plan is the plain one: one exchange on the key and one sort.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.sources.tables import pin

CHUNK, HALO, CELL, START, SIZE, POS = "_chunk", "_halo", "_cell", "_start", "_size", "_pos"
PART, BOUNDS = "_part", "_bounds"

def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join where a missing key equals a missing key. Keys of the right side are renamed
    first, so tables that stem from one another can be joined."""
    other = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(other, on, how).drop(*[f"_r_{k}" for k in keys])


def with_group_value(df: DataFrame, source: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """Add an aggregate of the row's group: a join on the keys, or a scalar subquery without keys."""
    if not keys:
        return df.withColumn(name, source.agg(value).scalar())
    return join_on(df, source.groupBy(*keys).agg(value.alias(name)), list(keys), "left")


class Series:
    def __init__(
        self,
        keys: list[str],
        order: list[str],
        cell: Column | None = None,
        target_rows: int = 2_000_000,
    ):
        self.keys, self.order = list(keys), list(order)
        self._cell = cell
        self.target_rows = target_rows
        self._known: tuple[DataFrame | None, DataFrame | None] | None = None

    @property
    def cell(self) -> Column:
        return self._cell if self._cell is not None else F.date_trunc("hour", F.col(self.order[0]))

    def measured(self, df: DataFrame) -> "Series":
        """This series with its hot groups looked up once, for several frames over tables
        that hold the same rows (columns may be added)."""
        out = Series(self.keys, self.order, self._cell, self.target_rows)
        out._known = out._hot_cells(df)
        return out

    def frame(self, df: DataFrame, before: int = 0, after: int = 0) -> "Frame":
        """Open a frame whose windows may look `before` rows back and `after` rows ahead."""
        cells, bounds = self._known or self._hot_cells(df)
        if cells is None:
            return Frame(self, df.withColumn(CHUNK, F.lit(0)).withColumn(HALO, F.lit(False)), None)
        at = cells.select(*self.keys, CELL, PART, CHUNK)
        rows = join_on(self._in_parts(df.withColumn(CELL, self.cell), bounds), at, [*self.keys, CELL, PART], "left")
        rows = rows.select(*df.columns, F.coalesce(CHUNK, F.lit(0)).alias(CHUNK))
        chunks = cells.groupBy(*self.keys, CHUNK).agg(F.min(START).alias(START), F.sum(SIZE).alias(SIZE))
        out = rows.withColumn(HALO, F.lit(False))
        if before:
            out = out.unionByName(self._halo(rows, chunks, before, back=True))
        if after:
            out = out.unionByName(self._halo(rows, chunks, after, back=False))
        return Frame(self, out, chunks)

    def _hot_cells(self, df: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
        """Cells of series above the target with their chunks, and the bounds that cut single cells above it; None where none are."""
        per_key = Window.partitionBy(*self.keys)
        so_far = per_key.orderBy(CELL, PART).rowsBetween(Window.unboundedPreceding, -1)
        # Small: hot groups only. Written once, so every use agrees on it and Spark knows its
        # size when it chooses between broadcast and shuffle for the join with the rows.
        sizes = df.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("_all"))
        keys = pin(sizes.filter(F.col("_all") > self.target_rows))
        if keys.isEmpty():
            return None, None
        # cells are counted for hot groups alone, so a table without any pays one count per group
        near = join_on(df, keys.drop("_all"), self.keys) if self.keys else df
        hot = pin(near.groupBy(*self.keys, self.cell.alias(CELL)).agg(F.count(F.lit(1)).alias(SIZE)))
        bounds, parted = None, hot.withColumn(PART, F.lit(0))
        heavy = hot.filter(F.col(SIZE) > self.target_rows)
        most = heavy.agg(F.sum(SIZE)).first()[0]
        if most:
            bounds = self._bounds(df, heavy, int(2 * most // self.target_rows) + 2)
            rows = join_on(df.withColumn(CELL, self.cell), heavy.drop(SIZE), [*self.keys, CELL])
            parts = self._in_parts(rows, bounds).groupBy(*self.keys, CELL, PART).agg(F.count(F.lit(1)).alias(SIZE))
            parted = hot.filter(F.col(SIZE) <= self.target_rows).withColumn(PART, F.lit(0)).unionByName(parts)
        cells = parted.withColumn(START, F.coalesce(F.sum(SIZE).over(so_far), F.lit(0)))
        return pin(cells.withColumn(CHUNK, (F.floor(F.col(START) / F.lit(self.target_rows)) + 1).cast("int"))), bounds

    def _bounds(self, df: DataFrame, heavy: DataFrame, parts: int) -> DataFrame:
        """Order keys at which heavy cells are cut, about `parts` in all: the first ones of a range partitioning of their rows."""
        rows = join_on(df.withColumn(CELL, self.cell), heavy.select(*self.keys, CELL), [*self.keys, CELL])
        rows = rows.select(*self.keys, CELL, F.struct(*self.order).alias("_o")).repartitionByRange(parts, *self.keys, CELL, "_o")
        firsts = rows.groupBy(*self.keys, CELL, F.spark_partition_id().alias("_p")).agg(F.min("_o").alias("_o"))
        return pin(firsts.groupBy(*self.keys, CELL).agg(F.sort_array(F.collect_list("_o")).alias(BOUNDS)))

    def _in_parts(self, df: DataFrame, bounds: DataFrame | None) -> DataFrame:
        """Rows with the part of their cell: how many of the cell's bounds do not lie behind them."""
        if bounds is None:
            return df.withColumn(PART, F.lit(0))
        own = F.struct(*self.order)
        part = F.size(F.filter(BOUNDS, lambda b: b <= own))
        return join_on(df, bounds, [*self.keys, CELL], "left").withColumn(PART, F.when(F.col(BOUNDS).isNull(), 0).otherwise(part)).drop(BOUNDS)

    def _halo(self, rows: DataFrame, chunks: DataFrame, k: int, back: bool) -> DataFrame:
        """Copies of the k rows next to each chunk of a hot series, labelled with that chunk."""
        per_chunk = Window.partitionBy(*self.keys, CHUNK)
        order = [F.col(c).desc_nulls_last() if back else F.col(c).asc_nulls_first() for c in self.order]
        # row_number <= k becomes a group limit below the exchange: only edges are shuffled.
        edge = (
            rows.filter(F.col(CHUNK) > 0)
            .withColumn("_r", F.row_number().over(per_chunk.orderBy(*order)))
            .filter(F.col("_r") <= k)
        )
        start, size = F.col(START), F.col(SIZE)
        plain = [c for c in rows.columns if c != CHUNK]
        placed = join_on(edge, chunks, [*self.keys, CHUNK])
        edge = placed.select(*plain, (start + size - F.col("_r") if back else start + F.col("_r") - 1).alias(POS))
        first, last = (start - k, start - 1) if back else (start + size, start + size + k - 1)
        need = (
            chunks.filter(last >= 0)
            .select(*self.keys, CHUNK, F.explode(F.sequence(F.greatest(first, F.lit(0)), last)).alias(POS))
        )
        return join_on(edge, need, [*self.keys, POS]).select(*rows.columns, F.lit(True).alias(HALO))


class Frame:
    """Rows of a series with their chunk and halo marks."""

    def __init__(self, series: Series, df: DataFrame, chunks: DataFrame | None):
        self.series, self.df, self.chunks = series, df, chunks

    def window(self) -> Window:
        """Ordered window over a series or, for a hot one, over a chunk of it."""
        return Window.partitionBy(*self.series.keys, CHUNK).orderBy(*self.series.order)

    def map(self, fn) -> "Frame":
        return Frame(self.series, fn(self.df), self.chunks)

    def with_columns(self, cols: dict[str, Column]) -> "Frame":
        return self.map(lambda d: d.withColumns(cols))

    def core(self) -> "Frame":
        """Drop the halo copies."""
        if self.chunks is None:
            return self
        return self.map(lambda d: d.filter(~F.col(HALO)))

    def running_sum(self, name: str, value: Column, inclusive: bool = True) -> "Frame":
        """Cumulative sum along the series (call on a core frame)."""
        end = 0 if inclusive else -1
        keys = self.series.keys
        local = F.sum(value).over(self.window().rowsBetween(Window.unboundedPreceding, end))
        out = self.df.withColumn(name, F.coalesce(local, F.lit(0)))
        if self.chunks is None:
            return self.map(lambda _: out)
        carry = self._carry(self.df.filter(F.col(CHUNK) > 0).groupBy(*keys, CHUNK).agg(F.sum(value).alias("_s")), "_s")
        joined = join_on(out, carry, [*keys, CHUNK], "left").withColumn(name, F.col(name) + F.coalesce("_carry", F.lit(0))).drop("_carry")
        return self.map(lambda _: joined)

    def running_max(self, name: str, value: Column, inclusive: bool = True) -> "Frame":
        """Largest non-null value so far along the series (call on a core frame)."""
        end = 0 if inclusive else -1
        keys = self.series.keys
        out = self.df.withColumn(name, F.max(value).over(self.window().rowsBetween(Window.unboundedPreceding, end)))
        if self.chunks is None:
            return self.map(lambda _: out)
        earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
        tops = self.df.filter(F.col(CHUNK) > 0).groupBy(*keys, CHUNK).agg(F.max(value).alias("_m"))
        carry = tops.select(*keys, CHUNK, F.max("_m").over(earlier).alias("_carry"))
        joined = join_on(out, carry, [*keys, CHUNK], "left").withColumn(name, F.greatest(name, "_carry")).drop("_carry")
        return self.map(lambda _: joined)

    def _carry(self, totals: DataFrame, col: str) -> DataFrame:
        earlier = Window.partitionBy(*self.series.keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
        return totals.select(*self.series.keys, CHUNK, F.coalesce(F.sum(col).over(earlier), F.lit(0)).alias("_carry"))

    def position(self, name: str) -> "Frame":
        """Zero-based row position along the series (call on a core frame)."""
        local = self.df.withColumn(name, (F.row_number().over(self.window()) - 1).cast("long"))
        if self.chunks is None:
            return self.map(lambda _: local)
        chunks, keys = self.chunks, self.series.keys
        starts = chunks.select(*keys, CHUNK, START)
        joined = join_on(local, starts, [*keys, CHUNK], "left").withColumn(name, F.col(name) + F.coalesce(START, F.lit(0))).drop(START)
        return self.map(lambda _: joined)

    def rows(self) -> DataFrame:
        return self.core().df.drop(CHUNK, HALO)
