"""Nearest neighbours by an inverted multi-index: halves quantised apart, cells of centroid pairs visited in order of distance."""
from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.sources.tables import pin


@dataclass(frozen=True)
class Settings:
    """Size of the index and reach of a search."""
    centroids: int = 128       # per half: at most 128 x 128 cells
    sample: int = 20_000       # vectors that the centroids are fitted to, about
    rounds: int = 12
    share: float = 0.38        # share of all entries that a query's cells hold at least
    least: int = 1_000         # entries that they hold at least
    entries: int = 20_000      # entries compared in one group
    queries: int = 2_048       # queries compared in one group
    seed: int = 5


def usable(vector: Column, size: int) -> Column:
    """Whether a vector has `size` finite components, not all of them zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == size) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _fit(points: np.ndarray, k: int, settings: Settings) -> np.ndarray:
    """Centroids by k-means; an empty one is put on the point farthest from its own."""
    rng = np.random.default_rng(settings.seed)
    points = np.unique(points, axis=0)
    centres = points[rng.choice(len(points), min(k, len(points)), replace=False)]
    for _ in range(settings.rounds):
        far = _squares(points, centres)
        own = far.argmin(axis=1)
        for c in range(len(centres)):
            mine = points[own == c]
            centres[c] = mine.mean(axis=0) if len(mine) else points[far.min(axis=1).argmax()]
    return centres


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


def visited_cells(first: np.ndarray, second: np.ndarray, counts: np.ndarray, need: int) -> list[tuple[int, int]]:
    """Cells (i, j) in order of first[i] + second[j] until they hold `need` entries, or all cells.

    The heap holds the next cell of each row reached: cell (i, j) in sorted order is pushed once (i - 1, j) and (i, j - 1) are out.
    """
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, out, held, gone = [(first[a[0]] + second[b[0]], 0, 0)], [], 0, np.full(len(a) + 1, 0)
    while heap and held < need:
        _, i, j = heapq.heappop(heap)
        gone[i] = j + 1
        cell = (int(a[i]), int(b[j]))
        if counts[cell]:
            out.append(cell)
            held += int(counts[cell])
        if i + 1 < len(a) and gone[i + 1] == j:
            heapq.heappush(heap, (first[a[i + 1]] + second[b[j]], i + 1, j))
        if j + 1 < len(b) and (i == 0 or gone[i - 1] > j + 1):
            heapq.heappush(heap, (first[a[i]] + second[b[j + 1]], i, j + 1))
    return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
            settings: Settings = Settings()) -> DataFrame:
    """Each query's `k` nearest found: `query_id, rank, vec_id, score`, by Euclidean distance, ties to the smaller id.

    Centroids of either half are fitted to a bounded sample of the vectors; every vector is filed under its pair of nearest
    centroids. A query visits cells by the sum of both distances, taken from a heap, until they hold `share` of all entries, and
    every entry of these cells is compared on the original vectors in double precision. Entries meet queries by first centroid:
    a frequent centroid's entries and many queries are cut into blocks, each giving a query's best `k`, so no group grows with the
    table. Vectors that are null, zero, hold null or non-finite components, or differ in length from the most frequent length take
    no part, nor do null ids; a query is no candidate for its own id. Fewer candidates than `k` are all returned; no usable vector,
    no rows.
    """
    spark = vectors.sparkSession
    schema = f"query_id {vectors.schema[id_col].dataType.simpleString()}, rank int, vec_id {vectors.schema[id_col].dataType.simpleString()}, score double"
    sizes = vectors.where(F.size(vector_col) > 0).groupBy(F.size(vector_col).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    sized = sizes.orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not sized:
        return spark.createDataFrame([], schema)
    size = sized[0]["d"]
    half = (size + 1) // 2
    entries = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col), size)).select(
        F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    asked = queries.where(F.col(id_col).isNotNull() & usable(F.col(vector_col), size)).select(
        F.col(id_col).alias("query_id"), F.col(vector_col).cast("array<double>").alias("v"))
    total = entries.count()
    rate = min(1.0, settings.sample / max(total, 1))
    drawn = entries.where(F.pmod(F.xxhash64("vec_id", F.lit(settings.seed)), F.lit(1_000_000)) < rate * 1_000_000)
    sample = [r["v"] for r in drawn.orderBy("vec_id").select("v").collect()] or [r["v"] for r in entries.limit(1).collect()]
    if not sample:
        return spark.createDataFrame([], schema)
    sample = np.array(sample)
    k_half = max(1, min(settings.centroids, int(np.sqrt(len(sample)))))
    books = [_fit(sample[:, :half], k_half, settings), _fit(sample[:, half:], k_half, settings) if size > half else np.zeros((1, 0))]

    def file(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.array(b["v"].tolist()).reshape(len(b), size)
            yield b.assign(c1=_squares(x[:, :half], books[0]).argmin(axis=1), c2=_squares(x[:, half:], books[1]).argmin(axis=1))

    id_type = entries.schema["vec_id"].dataType.simpleString()
    filed = pin(entries.mapInPandas(file, f"vec_id {id_type}, v array<double>, c1 int, c2 int"))
    counts = np.zeros((len(books[0]), len(books[1])), np.int64)
    for r in filed.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("n")).collect():  # one row per cell at most
        counts[r["c1"], r["c2"]] = r["n"]
    need = max(int(np.ceil(settings.share * total)), settings.least)
    parts = [int(n) for n in np.maximum(1, -(-counts.sum(axis=1) // settings.entries))]
    blocks = max(1, -(-asked.count() // settings.queries))

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.array(b["v"].tolist()).reshape(len(b), size)
            one, two = _squares(x[:, :half], books[0]), _squares(x[:, half:], books[1])
            rows = []
            for q, v, a, d in zip(b["query_id"], b["v"], one, two):
                by_first: dict[int, list[int]] = {}
                for i, j in visited_cells(a, d, counts, need):
                    by_first.setdefault(i, []).append(j)
                rows += [(q, v, i, js) for i, js in by_first.items()]
            yield pd.DataFrame(rows, columns=["query_id", "v", "c1", "cells"])

    visits = asked.mapInPandas(visit, f"query_id {id_type}, v array<double>, c1 int, cells array<int>")
    parts_of = F.array(*[F.lit(n) for n in parts])
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
    left = visits.withColumn("block", block).withColumn("part", F.explode(F.sequence(F.lit(0), F.get(parts_of, F.col("c1")) - 1)))
    right = filed.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.get(parts_of, F.col("c1"))).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def best(q: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(e):
            x, ids, cells = np.array(e["v"].tolist()), e["vec_id"].to_numpy(), e["c2"].to_numpy()
            order = np.lexsort((ids, cells))
            x, ids, cells = x[order], ids[order], cells[order]
            starts = {int(c): (np.searchsorted(cells, c, "left"), np.searchsorted(cells, c, "right")) for c in np.unique(cells)}
            for query, v, js in zip(q["query_id"], q["v"], q["cells"]):
                runs = [np.arange(*starts[int(j)]) for j in js if int(j) in starts]
                at = np.concatenate(runs) if runs else np.zeros(0, np.int64)
                at = at[ids[at] != query]
                if not len(at):
                    continue
                far = np.sqrt(((x[at] - np.asarray(v)) ** 2).sum(axis=1))
                if len(far) > k:
                    close = far <= np.partition(far, k - 1)[k - 1]
                    at, far = at[close], far[close]
                first = np.lexsort((ids[at], far))[:k]
                out.append(pd.DataFrame({"query_id": query, "vec_id": ids[at][first], "score": far[first]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": q["query_id"].dtype, "vec_id": q["query_id"].dtype})

    keys = ["c1", "part", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(best, f"query_id {id_type}, vec_id {id_type}, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
