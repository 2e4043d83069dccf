"""Connected components of a link table by alternating stars."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.sources.tables import pin


def _towards(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on links (u, v): each node's neighbours are linked to the least of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:
        both = both.where(F.col("v") < F.col("u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    near = both.join(least, F.col("u") == F.col("w"))
    if large:
        out = near.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """`node, root` for every node that has a link; root is the least node of its component.

    `edges` has long columns u and v; self links, nulls and repeats are ignored. Each round is a large and a small star step: minima
    are combined before the shuffle and meet the links in a join that can be split when one node has very many links. Rounds are
    written tables, and end when the links no longer change; their number grows with the logarithm of the components' width.
    """
    edges = pin(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        edges = pin(_towards(_towards(edges, large=True), large=False))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    linked = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return linked.unionByName(linked.select(F.col("root").alias("node"), "root").distinct())
