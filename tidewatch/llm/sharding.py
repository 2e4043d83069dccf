"""Reproducible shuffle into shards: a keyed permutation of global row numbers gives each row its shard and slot."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.numbering import number_rows

ROUNDS = 4


def _let(value: Column, body) -> Column:
    """`body(value)` with the value computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _sides(n: Column) -> tuple[Column, Column]:
    """The grid a x b with a * b >= n, both about the root of n: at most 2 * sqrt(n) + 1 cells lie outside 0 .. n-1."""
    a = F.greatest(F.ceil(F.sqrt(n.cast("double"))).cast("long"), F.lit(1).cast("long"))
    return a, F.greatest(F.ceil(n.cast("double") / a.cast("double")).cast("long"), F.lit(1).cast("long"))


def _round_keys(seed: int, backwards: bool = False) -> Column:
    keys = [F.struct(F.lit(i).alias("i"), F.lit(seed * 1_000_003 + i).cast("long").alias("key")) for i in range(ROUNDS)]
    return F.array(*(keys[::-1] if backwards else keys))


def _network(x: Column, a: Column, b: Column, seed: int, backwards: bool = False) -> Column:
    """Feistel rounds on the cell x = left * b + right; each round shifts one half by a hash of the other."""
    def one(v: Column, r: Column) -> Column:
        left, right = F.floor(v / b).cast("long"), F.pmod(v, b)
        by_right, by_left = F.xxhash64(right, r["key"]), F.xxhash64(left, r["key"])
        sign = F.lit(-1 if backwards else 1).cast("long")
        return F.when(F.pmod(r["i"], F.lit(2)) == 0, F.pmod(left + sign * F.pmod(by_right, a), a) * b + right).otherwise(
            left * b + F.pmod(right + sign * F.pmod(by_left, b), b))

    return F.aggregate(_round_keys(seed, backwards), x, one)


def permuted(number: Column, n: Column, seed: int = 0, backwards: bool = False) -> Column:
    """Position of row `number` (0 .. n-1) under the keyed permutation of 0 .. n-1, or the way back.

    The network permutes a grid of a * b >= n cells; a value outside 0 .. n-1 is sent through again until it is inside (cycle
    walking). The walk meets no cell twice, so it ends within a * b - n + 1 steps; the long sequence of that many steps is built
    only for the few rows that eight steps leave outside.
    """
    a, b = _sides(n)

    def walk(start: Column, sides: Column, steps: Column) -> Column:
        more = F.when(start < n, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), steps.cast("int")))
        return F.aggregate(more, start, lambda v, _: F.when(v < n, v).otherwise(_network(v, sides["a"], sides["b"], seed, backwards)))

    def whole(sides: Column) -> Column:
        first = _network(number.cast("long"), sides["a"], sides["b"], seed, backwards)
        spare = sides["a"] * sides["b"] - n + 1
        return _let(_let(first, lambda v: walk(v, sides, F.lit(8))), lambda v: walk(v, sides, spare))

    return _let(F.struct(a.alias("a"), b.alias("b")), whole)


def shard_rows(df: DataFrame, shards: int = 8, seed: int = 0, by: list[str] | None = None) -> DataFrame:
    """Adds `row_number`, `position`, `shard` and `slot` to every row.

    Rows get gapless global numbers in an order given by `by` (first column: an id); position is the permuted number, shard is
    position modulo `shards` and slot is position divided by `shards`. So shards differ by at most one row, slots run gapless
    from 0, and a row's place follows from its number and the row count alone (`permuted`; the way back with `backwards`).
    Null ids take part like others; rows equal in all of `by` get different places; an empty table stays empty; existing columns
    of the four names are replaced. Pass narrow rows: what is passed is shuffled once.
    """
    by = by or ["doc_id"]
    numbered = number_rows(df, by, name="row_number", total="__rows")
    placed = numbered.withColumn("position", permuted(F.col("row_number"), F.col("__rows"), seed)).drop("__rows")
    return placed.withColumn("shard", F.pmod("position", F.lit(shards)).cast("int")).withColumn(
        "slot", F.floor(F.col("position") / F.lit(shards)).cast("long"))
