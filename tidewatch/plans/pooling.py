"""Calibration curves of all labels at once: isotonic blocks that merge, and sigmoids by Newton sums."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.sources.tables import small_table

BLOCKS = "label string, low double, high double, total double, weight double"


def pooled(low: np.ndarray, high: np.ndarray, total: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
    """Neighbouring blocks whose means do not rise are merged until all rise.

    Blocks of a part stay merged in the whole, so pooling parts first and their blocks in order afterwards gives the same result.
    """
    while len(low):
        mean = total / weight
        first = np.flatnonzero(np.r_[True, mean[1:] > mean[:-1]])
        if len(first) == len(mean):
            break
        last = np.r_[first[1:], len(mean)] - 1
        low, high, total, weight = low[first], high[last], np.add.reduceat(total, first), np.add.reduceat(weight, first)
    return low, high, total, weight


def _batch(label: str, blocks: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([label] * len(blocks[0]), pa.string()), *[pa.array(b) for b in blocks]], ["label", "low", "high", "total", "weight"])


def _pool_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by label and score: what a task holds is one label's blocks."""
    held = None
    for batch in batches:
        names = batch["label"].to_numpy(zero_copy_only=False)
        columns = [batch[c].to_numpy() for c in ("low", "high", "total", "weight")]
        cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1), len(names)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            part = tuple(c[a:b] for c in columns)
            if held is not None and held[0] == names[a]:
                part = tuple(np.concatenate(x) for x in zip(held[1], part))
            elif held is not None:
                yield _batch(*held)
            held = names[a], pooled(*part)
    if held is not None:
        yield _batch(*held)


def isotonic_blocks(folded: DataFrame) -> DataFrame:
    """`label, low, high, total, weight`: the isotonic fit of y on p for every label, as blocks of equal mean.

    `folded` has one row per label and score: label, p, total (sum of y) and weight. Ranges of (label, p) are pooled in separate
    tasks, so a label with all rows is spread over them; only its blocks, whose means rise, are then pooled in one task.
    """
    rows = folded.select("label", F.col("p").alias("low"), F.col("p").alias("high"), F.col("total").cast("double"), F.col("weight").cast("double"))
    parts = rows.repartitionByRange("label", "low").sortWithinPartitions("label", "low").mapInArrow(_pool_part, BLOCKS)

    def whole(blocks: pa.Table) -> pa.Table:
        blocks = blocks.sort_by("low")
        done = pooled(*[blocks[c].to_numpy() for c in ("low", "high", "total", "weight")])
        return pa.Table.from_batches([_batch(blocks["label"][0].as_py(), done)])

    return parts.groupBy("label").applyInArrow(whole, BLOCKS)


def sigmoids(folded: DataFrame, labels: list[str], iterations: int = 100) -> dict[str, tuple[float, float]]:
    """Per label the intercept and slope of the ridge logistic fit (penalty slope^2 / 2) of y on p, all by the same Newton passes.

    A pass is one grouped sum over the folded scores; a label whose loss rose goes back half a step.
    """
    state = {x: {"at": np.zeros(2), "step": np.zeros(2), "loss": np.inf} for x in labels}
    p, z = F.col("p"), F.col("a") + F.col("b") * F.col("p")
    q = 1 / (1 + F.exp(-z))
    rest, curve = F.col("weight") * q - F.col("total"), F.col("weight") * q * (1 - q)
    softplus = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))
    sums = {"loss": F.col("weight") * softplus - F.col("total") * z, "g0": rest, "g1": rest * p, "h00": curve, "h01": curve * p, "h11": curve * p * p}
    open_ = list(labels)
    for _ in range(iterations):
        if not open_:
            break
        points = small_table(folded.sparkSession, [(x, *map(float, state[x]["at"])) for x in open_], "label STRING, a DOUBLE, b DOUBLE")
        # one row per label that is still open
        found = folded.join(F.broadcast(points), "label").groupBy("label").agg(*[F.sum(v).alias(k) for k, v in sums.items()]).collect()
        for r in found:
            s = state[r["label"]]
            b = s["at"][1]
            loss = r["loss"] + b * b / 2
            if loss > s["loss"] + 1e-12 * abs(s["loss"]):
                s["step"] = s["step"] / 2
                s["at"] = s["at"] - s["step"]
            else:
                s["loss"] = loss
                gradient = np.array([r["g0"], r["g1"] + b])
                s["step"] = -np.linalg.solve(np.array([[r["h00"] + 1e-12, r["h01"]], [r["h01"], r["h11"] + 1]]), gradient)
                s["at"] = s["at"] + s["step"]
            if np.abs(s["step"]).max() < 1e-11 * (1 + np.abs(s["at"]).max()):
                open_.remove(r["label"])
    return {x: (float(s["at"][0]), float(s["at"][1])) for x, s in state.items()}
