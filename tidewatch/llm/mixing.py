"""Mixing of sources: token weights raked to target shares, then documents drawn at calibrated rates."""
from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Name that values without a target of their own are counted under.
OTHER = "other"


def token_count(text: Column) -> Column:
    """Words of a text, parted by space, tab and line ends; 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^ \t\n\r]+")).cast("long")


def form_topic(text: Column) -> Column:
    """A document's form, used as its topic: table, marked, list, note or prose.

    Shares are per character: table from one bar in 40, marked from one sign out of !#$%&* in 20, list from one line end in 60;
    otherwise note below 400 characters, and prose.
    """
    t = F.coalesce(text, F.lit(""))
    n = F.length(t)

    def count(chars: str) -> Column:  # of signs of one byte each
        bare = t
        for c in chars:
            bare = F.replace(bare, F.lit(c), F.lit(""))
        return F.octet_length(t) - F.octet_length(bare)

    return (F.when(n == 0, "note").when(count("|") * 40 >= n, "table").when(count("!#$%&*") * 20 >= n, "marked")
            .when(count("\n") * 60 >= n, "list").when(n < 400, "note").otherwise("prose"))


def rake(tokens: np.ndarray, targets: list[np.ndarray], rounds: int = 500, tolerance: float = 1e-10) -> np.ndarray:
    """Iterative proportional fitting: the table scaled along each axis in turn until its shares meet the targets.

    Values of an axis without any tokens cannot be raised; their target share goes to the others of the axis in proportion.
    """
    table = tokens.astype(float) / max(tokens.sum(), 1)
    axes = range(table.ndim)
    held = []
    for axis in axes:
        here = table.sum(axis=tuple(a for a in axes if a != axis)) > 0
        share = np.where(here, targets[axis], 0.0)
        held.append(share / share.sum() if share.sum() > 0 else share)
    for _ in range(rounds):
        worst = 0.0
        for axis in axes:
            now = table.sum(axis=tuple(a for a in axes if a != axis))
            worst = max(worst, float(np.abs(now - held[axis]).max(initial=0)))
            factor = np.divide(held[axis], now, out=np.zeros_like(now), where=now > 0)
            table = table * factor.reshape([-1 if a == axis else 1 for a in axes])
        if worst < tolerance:
            break
    return table


def mixture(docs: DataFrame, targets: Mapping[str, Mapping[str, float]], tokens: str = "tokens", id_col: str = "doc_id", least: float = 0.0,
            seed: int = 0, keep_unlisted: bool = False) -> DataFrame:
    """Adds `weight, probability, kept` to every row; existing columns of these names are replaced.

    `targets` names the columns to rake by and the share of tokens that each value shall have; values without a target, and null,
    count together as `other`, whose share is its own entry or what the rest leave. With `keep_unlisted`, an `other` without an entry
    to which the rest leave nothing has the share that it has in the rows, and the targets part what remains; without, such rows have
    weight 0. The token counts of all rows are summed by the targets' values - a table whose size the targets bound - and raked (`rake`). A cell's weight is its raked share over its own;
    probabilities are the weights over the greatest weight, so no document is taken twice, but at least `least`. A document is
    kept when a hash of its id, between 0 and 1, lies below its probability: the same draw in every run. Rows that repeat an id
    are drawn alike. Rows without tokens have the weight of their cell, or 0 where the cell has none.
    """
    names = list(targets)
    values = {c: [*(v for v in sorted(targets[c]) if v != OTHER), OTHER] for c in names}
    cell = F.lit(0)
    for c in names:
        place = F.lit(len(values[c]) - 1)
        for i, v in enumerate(values[c][:-1]):
            place = F.when(F.col(c) == v, i).otherwise(place)
        cell = cell * len(values[c]) + place
    rows = docs.drop("weight", "probability", "kept").withColumn("__cell", cell)
    sums = rows.groupBy("__cell").agg(F.sum(tokens).alias("n")).collect()  # at most the product of the targets' lengths
    shape = [len(values[c]) for c in names]
    table = np.zeros(int(np.prod(shape)))
    for r in sums:
        table[r["__cell"]] = r["n"] or 0
    shares = []
    for axis, c in enumerate(names):
        rest = max(0.0, 1 - sum(s for v, s in targets[c].items() if v != OTHER))
        share = np.array([targets[c].get(v, rest if v == OTHER else 0.0) for v in values[c]])
        share = share / share.sum()
        if keep_unlisted and OTHER not in targets[c] and rest < 1e-9:
            own = table.reshape(shape).sum(axis=tuple(a for a in range(len(shape)) if a != axis)) / max(table.sum(), 1)
            listed = np.where(own[:-1] > 0, share[:-1], 0.0)  # values without tokens would hand part of their share to the unlisted ones
            if own[-1] > 0:
                share = np.r_[listed / (listed.sum() or 1.0) * (1 - own[-1]), own[-1]]
        shares.append(share)
    raked = rake(table.reshape(shape), shares).ravel()
    own = table / max(table.sum(), 1)
    weight = np.divide(raked, own, out=np.zeros_like(raked), where=own > 0)
    rate = np.maximum(weight / weight.max(), least) if weight.max() > 0 else np.ones_like(weight)
    weights, rates = (F.array(*[F.lit(float(x)) for x in v]) for v in (weight, rate))
    out = rows.withColumn("weight", F.get(weights, F.col("__cell"))).withColumn("probability", F.get(rates, F.col("__cell")))
    return out.withColumn("kept", draw(F.col(id_col), seed) < F.col("probability")).drop("__cell")


def draw(id_col: Column, seed: int) -> Column:
    """A number from 0 to below 1 that the id and the seed decide."""
    said = F.md5(F.concat_ws(":", F.lit(seed).cast("string"), id_col.cast("string")).cast("binary"))
    return F.conv(F.substring(said, 1, 8), 16, 10).cast("double") / float(2**32)
