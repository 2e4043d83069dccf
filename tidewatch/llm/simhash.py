"""Near duplicates by SimHash: fingerprints of word shingles, joined with themselves in a binary trie."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.components import connected_components
from tidewatch.llm.numbering import ROW, rows_once
from tidewatch.sources.tables import pin

BITS, BLOCK = 64, 16
#: Hashes whose bits are spread out at a time.
CHUNK = 1 << 16
#: Node pairs worked on at a time, and fingerprints of one trie.
FRONTIER, NODE_ROWS = 1 << 20, 1 << 20
#: Pairs of nodes with at most so many fingerprint pairs are compared at once.
SMALL = 32


def fingerprint(text: str | None, words: int = 3) -> int:
    """SimHash of a text's word shingles, repeats included: a bit is set where more than half of the XXH64 values have it.

    A-Z count as a-z; words are parted by space and the control characters 9 to 13. A text with fewer words than a shingle has
    one shingle, its words; a text without words, or null, has fingerprint 0.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only those characters part words
    if not parts:
        return 0
    join, digest = b" ".join, xxhash.xxh64_intdigest
    runs = zip(*(parts[i:] for i in range(words))) if len(parts) >= words else [parts]
    hashes = np.array([digest(join(r), 42) for r in runs], dtype=np.uint64)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), CHUNK):
        part = np.ascontiguousarray(hashes[i:i + CHUNK])
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, row_col: str | None = None) -> DataFrame:
    """`row_id, doc_id, fp` for every row; fp holds the 64 bits as a signed long, row_id is `row_col` or numbers the rows as read."""
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    # ids pass Python as text: with nulls among them pandas would make them floats
    rows = docs.select(row.alias("row_id"), F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))

    def prints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fps = np.array([fingerprint(t, words) for t in b["text"]], dtype=np.uint64)
            yield b[["row_id", "doc_id"]].assign(fp=fps.view(np.int64))

    found = rows.mapInPandas(prints, "row_id long, doc_id string, fp long")
    return found.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def _spread(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo, lo+1, .. for each of the runs with n members, one after the other."""
    start = np.cumsum(n) - n
    return np.repeat(lo - start, n) + np.arange(n.sum())


def trie_pairs(keys: np.ndarray, pairs: np.ndarray, errors: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of keys with at most `errors` differing bits, found by walking trie nodes in pairs.

    A node is a range of `keys` that share the bits above a level; keys are sorted within each range. `pairs` has rows
    (a_from, a_to, b_from, b_to), where a and b may be one node. A level splits each node at one bit: like children keep the
    number of differing bits, unlike children add one, and a pair goes once the budget is exceeded or a side is empty. Pairs of
    few keys are compared at once. Pairs come in pieces of bounded size.
    """
    stack = [(BITS - 1, pairs[i:i + FRONTIER], np.zeros(len(pairs[i:i + FRONTIER]), np.int8)) for i in range(0, len(pairs), FRONTIER)]
    while stack:
        bit, at, err = stack.pop()
        a0, a1, b0, b1 = at.T
        same = a0 == b0
        na, nb = a1 - a0, b1 - b0
        live = (na > 0) & (nb > 0) & ~(same & (na == 1))
        few = live & (na * nb <= SMALL)
        if few.any():
            n = (na * nb)[few]
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            i, j = np.repeat(a0[few], n) + k // np.repeat(nb[few], n), np.repeat(b0[few], n) + k % np.repeat(nb[few], n)
            near = ((i < j) | ~np.repeat(same[few], n)) & (_popcount(keys[i] ^ keys[j]) <= errors)
            if near.any():
                yield i[near], j[near]
        at, err, same = at[live & ~few], err[live & ~few], same[live & ~few]
        if not len(at):
            continue
        if bit < 0:  # no bit is left: all keys of a are equal, and all of b
            rows = [(_spread(x[0], x[1] - x[0]), _spread(x[2], x[3] - x[2])) for x in at[:, :, None]]
            for (i, j), one in zip(rows, same):
                for k in i:
                    rest = j[j > k] if one else j
                    yield np.full(len(rest), k), rest
            continue
        lo, inverse = np.unique(at.reshape(-1, 2), axis=0, return_inverse=True)
        inverse = inverse.reshape(-1, 2)
        probe = _spread(lo[:, 0], lo[:, 1] - lo[:, 0])
        ones = np.add.reduceat(((keys[probe] >> np.uint64(bit)) & np.uint64(1)).astype(np.int64), np.cumsum(lo[:, 1] - lo[:, 0]) - (lo[:, 1] - lo[:, 0]))
        mid = lo[:, 1] - ones
        am, bm = mid[inverse[:, 0]], mid[inverse[:, 1]]
        a0, a1, b0, b1 = at.T
        more = err + 1
        kids = [(np.stack([a0, am, b0, bm], 1), err), (np.stack([am, a1, bm, b1], 1), err), (np.stack([a0, am, bm, b1], 1), more),
                (np.stack([am, a1, b0, bm], 1)[~same], more[~same])]
        at, err = np.concatenate([k for k, _ in kids]), np.concatenate([e for _, e in kids])
        stays = (err <= errors) & (at[:, 0] < at[:, 1]) & (at[:, 2] < at[:, 3])
        at, err = at[stays], err[stays]
        stack += [(bit - 1, at[i:i + FRONTIER], err[i:i + FRONTIER]) for i in range(0, len(at), FRONTIER)]


def _joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Roots after linking i and j: the greater root is hung below the lesser until both ends agree."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j = i[apart], j[apart]
        np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def _forest(rows: pd.DataFrame, errors: int) -> pd.DataFrame:
    """Links (u, v) that join each fingerprint of a bucket to the root of its component there."""
    group = rows.groupby(["rot", "block", "lo", "hi"], sort=False).ngroup().to_numpy()
    turn = rows["rot"].to_numpy().astype(np.uint64) * np.uint64(BLOCK)
    fp = rows["fp"].to_numpy().view(np.uint64)
    key = np.where(turn > 0, (fp << turn) | (fp >> ((np.uint64(BITS) - turn) % np.uint64(BITS))), fp)
    second = (rows["side"].to_numpy() != rows["lo"].to_numpy()).astype(np.int8)
    order = np.lexsort((key, second, group))
    key, group, second, fp = key[order], group[order], second[order], fp[order]
    two = (rows["lo"].to_numpy() != rows["hi"].to_numpy())[order]
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    end = np.r_[start[1:], len(group)]
    middle = end - np.add.reduceat(second, start, dtype=np.int64)
    pairs = np.where(two[start][:, None], np.stack([start, middle, middle, end], 1), np.stack([start, end, start, end], 1))
    label = np.arange(len(key))
    for i, j in trie_pairs(key, pairs, errors):
        label = _joined(label, i, j)
    linked = label != np.arange(len(key))
    return pd.DataFrame({"u": fp[linked].view(np.int64), "v": fp[label[linked]].view(np.int64)})


def _hot_bits(rows: DataFrame, node_rows: int) -> DataFrame:
    """For buckets with more than `node_rows` fingerprints: the bits that part them best, enough for nodes of that size."""
    ones = [F.sum(F.shiftrightunsigned("fp", i).bitwiseAND(F.lit(1))).alias(f"b{i}") for i in range(BITS)]
    sizes = rows.groupBy("rot", "block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > node_rows).select(
        F.col("rot").alias("h_rot"), F.col("block").alias("h_block"), "n")
    mine = (F.col("rot") == F.col("h_rot")) & (F.col("block") == F.col("h_block"))
    hot = rows.join(sizes, mine).groupBy("rot", "block").agg(F.max("n").alias("n"), *ones)
    balance = F.array(*[F.struct(F.abs(2 * F.col(f"b{i}") - F.col("n")).alias("lean"), F.lit(i).alias("bit")) for i in range(BITS)])
    want = F.least(F.lit(12), F.ceil(F.log2(F.col("n") / F.lit(node_rows))) + 1).cast("int")
    return hot.select(F.col("rot").alias("h_rot"), F.col("block").alias("h_block"),
                      F.transform(F.slice(F.array_sort(balance), F.lit(1), want), lambda s: s["bit"]).alias("bits"))


def linked_fingerprints(prints: DataFrame, errors: int = 3, node_rows: int = NODE_ROWS) -> DataFrame:
    """Links `u, v` between different fingerprints that span the components of "at most `errors` bits differ" (errors up to 3).

    Four tries are kept, each with another 16 bits in front: of two fingerprints at most three bits apart one such block agrees, so
    every pair meets below a common node 16 levels down. Fingerprints are dealt out by that node and walked in node pairs there
    (`trie_pairs`). A node with more than `node_rows` fingerprints is parted further, by the bits that divide it best, into
    nodes whose pairs are dealt out in turn, leaving out pairs that these bits put beyond the budget. A task hands on one link
    per linked fingerprint, not the pairs. `prints` has a column fp; repeats are folded first.
    """
    if not 0 <= errors <= BITS // BLOCK - 1:
        raise ValueError("one of the blocks has to agree: errors must be below the number of blocks")
    rows = prints.select("fp").distinct().select("fp", F.explode(F.array(*[F.lit(i) for i in range(BITS // BLOCK)])).alias("rot"))
    shift = (F.lit(BITS - BLOCK) - F.col("rot") * BLOCK).cast("int")
    rows = rows.withColumn("block", F.call_function("shiftrightunsigned", F.col("fp"), shift).bitwiseAND(F.lit((1 << BLOCK) - 1)).cast("int"))
    rows = pin(rows)
    hot = _hot_bits(rows, node_rows)
    dealt = rows.join(hot, (F.col("rot") == F.col("h_rot")) & (F.col("block") == F.col("h_block")), "left").drop("h_rot", "h_block")
    bits = F.coalesce(F.col("bits"), F.array().cast("array<int>"))
    node = F.aggregate(bits, F.lit(0), lambda v, b: v * 2 + F.call_function("shiftrightunsigned", F.col("fp"), b).bitwiseAND(F.lit(1)).cast("int"))
    dealt = dealt.select("rot", "block", "fp", node.alias("side"), F.size(bits).alias("k"))
    masks = F.filter(F.sequence(F.lit(0), F.pow(F.lit(2), F.col("k")).cast("int") - 1), lambda m: F.bit_count(m) <= errors)
    dealt = dealt.select("rot", "block", "fp", "side", F.explode(masks).alias("mask"))
    other = F.col("side").bitwiseXOR(F.col("mask"))
    dealt = dealt.select("rot", "block", "fp", "side", F.least("side", other).alias("lo"), F.greatest("side", other).alias("hi"))
    keys = ["rot", "block", "lo", "hi"]

    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for b in batches:
            held.append(b)
            if sum(map(len, held)) >= node_rows:  # all but the last bucket are whole
                rows = pd.concat(held, ignore_index=True)
                open_ = (rows[keys] == rows[keys].iloc[-1]).all(axis=1).to_numpy()
                if not open_.all():
                    yield _forest(rows[~open_], errors)
                held = [rows[open_]]
        if held and sum(map(len, held)):
            yield _forest(pd.concat(held, ignore_index=True), errors)

    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(links, "u long, v long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, errors: int = 3,
                node_rows: int = NODE_ROWS) -> DataFrame:
    """`row_id, doc_id, fp, root, component_id` for every row: the component's least fingerprint, and the least doc_id reachable over
    links of at most `errors` differing bits.

    Texts with equal fingerprints are linked, those without words (empty, null) among themselves as well. Rows with repeated ids
    keep one row each; null ids take part but are never a component's id unless it has no other. An empty table gives no rows.
    """
    return _near_groups(fingerprints(docs, id_col, text_col, words), errors, node_rows)


def _near_groups(found: DataFrame, errors: int, node_rows: int) -> DataFrame:
    prints = pin(found)
    firsts = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = connected_components(linked_fingerprints(prints, errors, node_rows))
    rooted = firsts.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = pin(rooted)
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id")).select(F.col("root").alias("r"), "component_id")
    known = rooted.join(least, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "root", "component_id")
    return prints.join(known, F.col("fp") == F.col("f")).select("row_id", "doc_id", "fp", "root", "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, errors: int = 3,
               stored: bool = False) -> DataFrame:
    """One row of each component stays, with its columns as they were: the one with the least id, of repeats the first read.

    `stored` as in `rows_once`. A column named `__row` would be lost.
    """
    numbered = rows_once(docs, stored)
    groups = pin(_near_groups(fingerprints(numbered, id_col, text_col, words, ROW), errors, NODE_ROWS))
    stays = groups.groupBy("root").agg(F.min_by("row_id", F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row_id")).alias("stay"))
    gone = groups.select(F.col("row_id").alias(ROW)).join(stays.select(F.col("stay").alias(ROW)), ROW, "left_anti")
    return numbered.join(gone, ROW, "left_anti").drop(ROW)
