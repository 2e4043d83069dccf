"""Line dedup by an exact set-similarity join: rare-first prefixes, position and length filters, verified Jaccard."""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.numbering import ROW, rows_once
from tidewatch.sources.tables import pin


@dataclass(frozen=True)
class Settings:
    """The join's threshold, and sizes of its parts."""
    similarity: float = 0.8    # Jaccard of word sets from which lines match
    words: int = 5             # lines with fewer different words are left alone
    counters: int = 22         # word counts are kept in 2 ** counters cells
    group: int = 20_000        # lines compared in one group
    marks: int = 25            # lines to verify are looked up in 2 ** marks bits first
    at_once: int = 1 << 18     # bytes of text taken apart at a time
    bucket: int = 500_000      # postings filtered at a time


_ODD, _BLOCK = 0x9E3779B97F4A7C15, 4096
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """1, base, base ** 2, .. modulo 2 ** 64."""
    if len(_powers.get(base, ())) < n:
        v = np.full(n, base, np.uint64)
        v[0] = 1
        _powers[base] = np.multiply.accumulate(v)
    return _powers[base][:n]


def _mixed(x: np.ndarray, by: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(by)
    return x ^ (x >> np.uint64(29))


def words_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and line number of every word; A-Z count as a-z, lines end with a line feed.

    A word's hash is a polynomial of its bytes, taken from running sums over the whole text and then mixed.
    """
    a = np.frombuffer(data.lower(), np.uint8)
    blank = np.ones(len(a) + 2, bool)
    np.less(a - np.uint8(9), 5, out=blank[1:-1])  # tab to carriage return
    blank[1:-1] |= a == 32
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    start, end = edge[::2], edge[1::2]
    power = _power(_ODD, len(a))
    sums = np.zeros(len(a) + 1, np.uint64)
    np.multiply(a, power, out=sums[1:])
    sums[1:] += power
    np.cumsum(sums, out=sums)
    back = _power(pow(_ODD, -1, 1 << 64), len(a))
    hashes = _mixed(_mixed((sums[end] - sums[start]) * back[start], 0xD6E8FEB86659FD93), 0xC2B2AE3D27D4EB4F)
    before = np.searchsorted(start, np.flatnonzero(a == 10))  # words before each line feed
    return hashes, np.repeat(np.arange(len(before) + 1), np.diff(np.r_[0, before, len(start)]))


def _pieces(texts: list[str | None], at_once: int) -> Iterator[tuple[int, list[bytes]]]:
    """Whole texts in runs of about `at_once` bytes, with the number of the first."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        held.append((t or "").encode("utf-8", "surrogatepass"))
        size += len(held[-1])
        if size >= at_once:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


#: What a cell's byte stands for: counts below 128 themselves, then six steps to a doubling.
_VALUES = np.r_[np.arange(128), np.ceil(128 * 2 ** (np.arange(128) / 6))].astype(np.int64)


def _coded(counts: np.ndarray) -> np.ndarray:
    return (np.searchsorted(_VALUES, counts, "right") - 1).astype(np.uint8)


def _cells_used(seen: np.ndarray) -> Iterator[pd.DataFrame]:
    """One task's cell counts, in blocks, as bytes."""
    rows = _coded(seen).reshape(-1, _BLOCK)
    used = np.flatnonzero(rows.any(axis=1))
    for i in range(0, len(used), 64):
        yield pd.DataFrame({"block": used[i:i + 64], "n": [rows[k].tobytes() for k in used[i:i + 64]]})


def _cell_counts(parts: DataFrame, cells: int) -> np.ndarray:
    """The sum of all tasks' cell counts, as bytes: exact up to 127, one order for all sizes beyond."""
    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for b in batches:  # a block's rows are added up as they come
            for k, n in zip(b["block"], b["n"]):
                held[k] = held.get(k, 0) + _VALUES[np.frombuffer(n, np.uint8)]
        if held:
            yield pd.DataFrame({"block": list(held), "n": [_coded(v).tobytes() for v in held.values()]})

    out = np.zeros((cells // _BLOCK, _BLOCK), np.uint8)
    for r in parts.repartition("block").mapInPandas(add, "block int, n binary").collect():  # cells bytes in all
        out[r["block"]] = np.frombuffer(r["n"], np.uint8)
    return out.ravel()


def word_counts(docs: DataFrame, text_col: str, settings: Settings) -> np.ndarray:
    """How often words occur in all texts, counted in hash cells of a byte each (`_VALUES`): a bounded table, whatever the vocabulary."""
    cells, shift, at_once = 1 << settings.counters, np.uint64(64 - settings.counters), settings.at_once

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(cells, np.int64)
        for b in batches:
            for _, data in _pieces(b["text"].tolist(), at_once):
                np.add.at(seen, (words_of(b"\n".join(data))[0] >> shift).astype(np.int64), 1)
        yield from _cells_used(seen)

    return _cell_counts(docs.select(F.col(text_col).alias("text")).mapInPandas(count, "block int, n binary"), cells)


def _ordered(hashes: np.ndarray, lines: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of each line once, rare ones first: by count, then by hash, one order for all lines."""
    bits = np.uint64(64 - int(np.log2(len(counts))))
    rarity = counts[(hashes >> bits).astype(np.int64)].astype(np.uint64)
    key = (lines.astype(np.uint64) << np.uint64(40)) | (rarity << np.uint64(32)) | (hashes >> np.uint64(32))
    order = np.argsort(key)
    hashes, lines = hashes[order], lines[order]
    new = np.r_[True, (hashes[1:] != hashes[:-1]) | (lines[1:] != lines[:-1])] if len(hashes) else np.zeros(0, bool)
    return hashes[new], lines[new]


def _shared(n: np.ndarray, m: np.ndarray, similarity: float) -> np.ndarray:
    """Words that sets of n and m must share to be similar enough."""
    return np.ceil(similarity / (1 + similarity) * (n + m) - 1e-9)


#: Bytes of a prefix's word: 40 bits of its hash and its place.
PLACED = 6


def _new_sets(k1: np.ndarray, k2: np.ndarray, given: np.ndarray) -> np.ndarray:
    """Which sets come for the first time, as far as `given` remembers."""
    new = np.zeros(len(k1), bool)
    order = np.lexsort((k2, k1))
    first, second = k1[order], k2[order]
    new[order[np.r_[True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])]]] = True
    slot = (k1 % np.uint64(len(given))).astype(np.int64)
    new &= (given[slot, 0] != k1) | (given[slot, 1] != k2)
    given[slot[new]] = np.c_[k1, k2][new]
    return new


def line_rows(docs: DataFrame, counts: np.ndarray, id_col: str, text_col: str, settings: Settings) -> DataFrame:
    """A row for each line of enough words: `row_id, doc_id, line, n, k1, k2`, its bit map in two parts, and its prefix of rare words.

    The prefix has six bytes a word, 40 bits of its hash and its place; it is empty where the task has given that of an equal set before.
    """
    # ids pass Python as text: with nulls among them pandas would make them floats
    rows = docs.select(F.col(ROW).alias("row_id"), F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    schema = rows.select("row_id", "doc_id").schema.add("line", "integer").add("n", "integer").add("k1", "long").add("k2", "long").add(
        "bits", "long").add("more", "long").add("prefix", "binary")
    shared = rows.sparkSession.sparkContext.broadcast(counts)  # 2 ** counters bytes

    def frame(b: pd.DataFrame, held: list[dict]) -> pd.DataFrame:
        whole = {c: np.concatenate([x[c] for x in held]) for c in ("of", "line", "n", "k1", "k2", "bits", "more")}
        return b[["row_id", "doc_id"]].iloc[whole.pop("of")].reset_index(drop=True).assign(**whole, prefix=[p for x in held for p in x["prefix"]])

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        given = np.zeros((1 << 18, 2), np.uint64)  # sets of late, each at a place of its own
        for b in batches:
            held: list[dict] = []
            for first, data in _pieces(b["text"].tolist(), settings.at_once):
                hashes, lines = _ordered(*words_of(b"\n".join(data)), shared.value)
                if not len(lines):
                    continue
                start = np.flatnonzero(np.r_[True, lines[1:] != lines[:-1]])
                n = np.diff(np.r_[start, len(lines)])
                add = lambda v: np.add.reduceat(v, start)
                k1, k2 = add(_mixed(hashes, 0xFF51AFD7ED558CCD)), add(_mixed(hashes ^ np.uint64(_ODD), 0xC4CEB9FE1A85EC53))
                bit, upper = np.uint64(1) << (hashes & np.uint64(63)), hashes & np.uint64(64) > 0  # one of 128 for a word
                bits, more = np.bitwise_xor.reduceat(np.where(upper, bit, 0), start), np.bitwise_xor.reduceat(np.where(upper, 0, bit), start)
                ends = np.cumsum([d.count(b"\n") + 1 for d in data])
                at = np.searchsorted(ends, lines[start], "right")
                long = np.flatnonzero(n >= settings.words)
                if not len(long):
                    continue
                reach = n - np.ceil(settings.similarity * n - 1e-9).astype(np.int64) + 1
                place = np.arange(len(lines)) - np.repeat(start, n)
                # a set that only its equals match needs no postings: up to 3 words at 0.8
                reach[(np.ceil(settings.similarity * n - 1e-9) == n) & (_longest(n, settings.similarity) == n)] = 0
                # a word counted once, in all texts, has no line to share
                useful = (place < np.repeat(reach, n)) & (shared.value[(hashes >> np.uint64(64 - settings.counters)).astype(np.int64)] > 1)
                useful &= np.repeat(_new_sets(k1, k2, given) & (n >= settings.words), n)
                upto = PLACED * np.r_[0, np.cumsum(useful)]
                packed = np.empty((int(useful.sum()), PLACED), np.uint8)
                packed[:, :5] = (hashes[useful] >> np.uint64(24)).view(np.uint8).reshape(-1, 8)[:, :5]
                packed[:, 5] = np.minimum(place[useful], 255)  # a lower place only permits more
                packed = packed.tobytes()
                held.append({"of": first + at[long], "line": (lines[start] - np.r_[0, ends][at])[long], "n": n[long], "k1": k1[long].view(np.int64),
                             "k2": k2[long].view(np.int64), "bits": bits[long].view(np.int64), "more": more[long].view(np.int64),
                             "prefix": [packed[i:k] for i, k in zip(upto[start[long]].tolist(), upto[(start + n)[long]].tolist())]})
                if len(held) == 32:
                    yield frame(b, held)
                    held = []
            if held:
                yield frame(b, held)

    return rows.mapInPandas(take, schema).withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))


def _chunks(batches: Iterator[pd.DataFrame], key: str, rows: int, text: str | None = None, size: int = 0) -> Iterator[pd.DataFrame]:
    """Rows that come sorted by `key`, in frames that part no group: of about `rows` rows, and about `size` characters of `text`."""
    held: list[pd.DataFrame] = []
    count = weight = 0
    for b in batches:
        cuts = [*range(0, len(b), rows), len(b)]
        if text is not None:
            cuts = sorted({*cuts, *(np.flatnonzero(np.diff(b[text].str.len().cumsum().to_numpy() // size)) + 1).tolist()})
        for lo, hi in zip(cuts, cuts[1:]):
            part = b.iloc[lo:hi]
            held.append(part)
            count += len(part)
            weight += int(part[text].str.len().sum()) if text is not None else 0
            if count < rows and (text is None or weight < size):
                continue
            together = pd.concat(held, ignore_index=True)
            open_ = (together[key] == together[key].iloc[-1]).to_numpy()
            if not open_.all():
                yield together[~open_].reset_index(drop=True)
            held = [together[open_]]
            count, weight = int(open_.sum()), int(held[0][text].str.len().sum()) if text is not None else 0
    if held and count:
        yield pd.concat(held, ignore_index=True)


def _pairs(group: np.ndarray, n: np.ndarray, upto: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs i < j of one group with n[j] <= upto[i], for rows sorted by group and n, in pieces of about `most`."""
    place = group.astype(np.int64) * (1 << 32) + n
    last = np.searchsorted(place, group.astype(np.int64) * (1 << 32) + upto, "right")
    count = np.maximum(last - np.arange(len(n)) - 1, 0)
    total, first = np.cumsum(count), 0
    while first < len(n):
        stop = max(int(np.searchsorted(total, (total[first - 1] if first else 0) + most)), first + 1)
        c = count[first:stop]
        i = np.repeat(np.arange(first, first + len(c)), c)
        if len(i):
            yield i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
        first = stop


def _longest(n: np.ndarray, similarity: float) -> np.ndarray:
    """The most words that a set can have to match one of n."""
    return np.floor(n / similarity + 1e-9).astype(np.int64)


def _sides_fit(key: np.ndarray, side: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """In a group that stands for two parts of a frequent word's lines, pairs lie across the parts."""
    lo, hi = (key[i] >> 16) & 0xFFFF, key[i] & 0xFFFF
    return (lo == hi) | (side[i] != side[j])


#: A posting is five numbers: its key; its set's word count and 32 bits of its set; its set's map, place and side;
#: the rest of the map; and the word before it.
ID_BITS, AT_BITS = 32, 17


def _prefixes(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """40 bits of each word, its place, and the row it belongs to."""
    rows = np.frombuffer(b"".join(packed), np.uint8).reshape(-1, PLACED)
    words = np.zeros((len(rows), 8), np.uint8)
    words[:, :5] = rows[:, :5]
    sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // PLACED
    return words.view(np.uint64).ravel(), rows[:, 5].astype(np.uint64), np.repeat(np.arange(len(packed)), sizes)


def posting_counts(lines: DataFrame, settings: Settings) -> np.ndarray:
    """How many postings words have, in the cells of `word_counts`."""
    shift = np.uint64(40 - settings.counters)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(1 << settings.counters, np.int64)
        for b in batches:
            np.add.at(seen, (_prefixes(b["prefix"].tolist())[0] >> shift).astype(np.int64), 1)
        yield from _cells_used(seen)

    return _cell_counts(lines.select("prefix").mapInPandas(count, "block int, n binary"), 1 << settings.counters)


def _postings(rows: pd.DataFrame, counts: np.ndarray, settings: Settings, at_once: int = 1 << 18) -> Iterator[np.ndarray]:
    """The postings of lines (five rows of numbers), those of hot words once for each pair of parts that their part takes part in."""
    words, place, own = _prefixes(rows["prefix"].tolist())
    last = np.zeros(len(words), np.uint64)  # 0 where there is none
    last[1:] = np.where(own[1:] == own[:-1], words[:-1] + np.uint64(1), 0)
    many = _VALUES[counts[(words >> np.uint64(40 - settings.counters)).astype(np.int64)]]
    met = many > 1  # a posting alone in its cell has none to meet
    words, place, own, last = words[met], place[met], own[met], last[met]
    parts = np.minimum(65000, -(-many[met] // settings.group))
    k1, n, bits, more = (rows[c].to_numpy().astype(np.int64).view(np.uint64)[own] for c in ("k1", "n", "bits", "more"))
    ids = k1 & np.uint64((1 << ID_BITS) - 1)
    part = ids % parts.astype(np.uint64)
    total, first = np.cumsum(parts), 0
    while first < len(words):
        stop = max(int(np.searchsorted(total, (total[first - 1] if first else 0) + at_once)), first + 1)
        p = parts[first:stop]
        i = np.repeat(np.arange(first, first + len(p)), p)
        other = (np.arange(len(i)) - np.repeat(np.cumsum(p) - p, p)).astype(np.uint64)
        low, high = np.minimum(other, part[i]), np.maximum(other, part[i])
        yield np.stack([words[i] >> np.uint64(8) << np.uint64(32) | low << np.uint64(16) | high, n[i] << np.uint64(ID_BITS) | ids[i],
                        bits[i] >> np.uint64(AT_BITS + 1) << np.uint64(AT_BITS + 1) | place[i] << np.uint64(1) | (low != part[i]).astype(np.uint64),
                        more[i], last[i]])
        first = stop


def _packed(posts: np.ndarray) -> bytes:
    """Postings with like bytes of all side by side, which a shuffle compresses well."""
    return np.ascontiguousarray(posts).view(np.uint8).reshape(5, -1, 8).transpose(0, 2, 1).tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(5, 8, -1).transpose(0, 2, 1)).view(np.uint64)[..., 0]


def postings(lines: DataFrame, settings: Settings) -> DataFrame:
    """The postings of all lines in arrays, dealt out in buckets by their keys: `bucket, posts`. A bucket has about `settings.bucket`."""
    spark = lines.sparkSession
    counts = posting_counts(lines, settings)
    # some to each partition, so that partitions are alike
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), int(_VALUES[counts].sum()) // settings.bucket + 1)
    shared = spark.sparkContext.broadcast(counts)  # 2 ** counters bytes

    def dealt(posts: np.ndarray) -> pd.DataFrame:
        bucket = (_mixed(posts[0], 0xD6E8FEB86659FD93) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((posts[0], bucket))
        posts, bucket = posts[:, order], bucket[order]
        start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        ends = np.r_[start[1:], len(bucket)]
        return pd.DataFrame({"bucket": bucket[start], "posts": [_packed(posts[:, i:k]) for i, k in zip(start, ends)]})

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for b in batches:
            for posts in _postings(b, shared.value, settings):
                held.append(posts)
                size += posts.shape[1]
                if size >= 1 << 18:
                    yield dealt(np.concatenate(held, axis=1))
                    held, size = [], 0
        if size:
            yield dealt(np.concatenate(held, axis=1))

    return lines.where(F.length("prefix") > 0).select("k1", "n", "bits", "more", "prefix").mapInPandas(deal, "bucket int, posts binary")


def _with_partner(posts: np.ndarray, similarity: float) -> pd.DataFrame:
    """The postings that have a possible partner in their group, by length, position and bit map, and by the word before: a pair that
    shares it meets in an earlier word's group."""
    posts = posts[:, np.lexsort((posts[1], posts[0]))]
    # a set may come from several tasks
    posts = posts[:, np.r_[True, (posts[0, 1:] != posts[0, :-1]) | (posts[1, 1:] != posts[1, :-1]) | (posts[2, 1:] != posts[2, :-1])]]
    group = np.cumsum(np.r_[0, posts[0, 1:] != posts[0, :-1]])
    met = np.bincount(group)[group] > 1
    group, (key, a, b, more, last) = group[met], posts[:, met]
    key, n = key.view(np.int64), (a >> np.uint64(ID_BITS)).astype(np.int64)
    at, side = (b >> np.uint64(1)).astype(np.int64) & ((1 << AT_BITS) - 1), (b & np.uint64(1)).astype(np.int64)
    bits = b >> np.uint64(AT_BITS + 1)
    rest = n - at  # words from the place on: no fewer must be shared
    found = np.zeros(len(n), bool)
    # as the shorter of a pair, a row can share `rest` words at most, which bounds the longer one's length
    upto = np.minimum(_longest(n, similarity), np.floor(rest * (1 + similarity) / similarity + 1e-6).astype(np.int64) - n)
    for i, j in _pairs(group, n, upto):
        both = n[i] + n[j]
        near = np.flatnonzero(np.bitwise_count(bits[i] ^ bits[j]) + np.bitwise_count(more[i] ^ more[j]) <= both * ((1 - similarity) / (1 + similarity)) + 1e-6)
        i, j = i[near], j[near]
        fits = (np.minimum(rest[i], rest[j]) >= _shared(n[i], n[j], similarity)) & _sides_fit(key, side, i, j)
        fits &= (last[i] != last[j]) | (last[i] == 0)
        found[i[fits]] = True
        found[j[fits]] = True
    return pd.DataFrame({"key": key[found], "id": (a[found] & np.uint64((1 << ID_BITS) - 1)).astype(np.int64), "side": side[found]})


def _verified(rows: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """Links of each row within its groups, each pair counted where its first common word is the group's: `k1, k2, links, later`.

    The words of a group that several rows have are numbered, so a row is a bit string, a pair's common words are two strings' common
    bits, and the group's word is the first of them when the strings of the words before it have none in common.
    """
    words, own = _sets(rows["words"].tolist())
    key, side, n = rows["key"].to_numpy(), rows["side"].to_numpy(), np.bincount(own, minlength=len(rows))
    links, later = np.zeros(len(rows), np.int64), np.zeros(len(rows), bool)
    rank = np.empty(len(rows), np.int64)
    doc = rows["doc"] if rows["doc"].dtype.kind in "iuf" else pd.factorize(rows["doc"], sort=True)[0]
    rank[np.lexsort((rows["line"], rows["row_id"], doc, rows["named"]))] = np.arange(len(rows))
    groups, group = np.unique(key, return_inverse=True)
    its = np.flatnonzero(words >> np.uint64(16) == ((key >> 32) & 0xFFFFFFFF).astype(np.uint64)[own])[::-1]
    at = np.zeros(len(rows), np.int64)
    at[own[its]] = its  # where the group's word is, the first if two are alike
    meet, early = words[at], np.arange(len(words)) < at[own]
    # the words of a group, kept where two rows have them; a frame has fewer than 2 ** 16 groups
    place = group[own].astype(np.uint64) << np.uint64(48) | words
    order = np.argsort(place)
    place, r, early = place[order], own[order], early[order]
    word = np.cumsum(np.r_[False, place[1:] != place[:-1]])
    often = np.bincount(word)[word] > 1
    place, r, early, word = place[often], r[often], early[often], word[often]
    fresh = np.r_[True, word[1:] != word[:-1]][:len(word)]
    number = np.cumsum(fresh) - 1
    o_of = (place[fresh] >> np.uint64(48)).astype(np.int64)
    base = np.searchsorted(o_of, np.arange(len(groups)))
    local = number - base[group[r]]
    width = np.maximum(1, -(-np.bincount(o_of, minlength=len(groups)) // 64))
    for w in np.unique(1 << np.ceil(np.log2(width)).astype(int)):  # groups of like vocabularies together
        mine = np.flatnonzero((width <= w) & (width > w // 2))
        if not len(mine):
            continue
        rows_of = np.flatnonzero(np.isin(group, mine))
        rows_of = rows_of[np.lexsort((n[rows_of], group[rows_of]))]
        slot = np.full(len(rows), -1)
        slot[rows_of] = np.arange(len(rows_of))
        used = np.flatnonzero(slot[r] >= 0)
        spot, bit = slot[r[used]] * w + local[used] // 64, np.uint64(1) << (local[used] % 64).astype(np.uint64)
        bits, head = np.zeros(len(rows_of) * w, np.uint64), np.zeros(len(rows_of) * w, np.uint64)
        np.add.at(bits, spot, bit)  # a row has a word once
        np.add.at(head, spot[early[used]], bit[early[used]])
        bits, head = bits.reshape(-1, w), head.reshape(-1, w)
        for i, j in _pairs(group[rows_of], n[rows_of], _longest(n[rows_of], similarity), most=max(1024, (1 << 19) // int(w))):
            a, b = rows_of[i], rows_of[j]
            near = np.bitwise_count(bits[i] & bits[j]).sum(axis=1, dtype=np.int64) >= _shared(n[a], n[b], similarity)
            near = np.flatnonzero(near & (meet[a] == meet[b]) & _sides_fit(key, side, a, b))
            near = near[~(head[i[near]] & head[j[near]]).any(axis=1)]
            a, b = a[near], b[near]
            np.add.at(links, a, 1)
            np.add.at(links, b, 1)
            later[np.where(rank[a] > rank[b], a, b)] = True
    has = links > 0
    return pd.DataFrame({"k1": rows["k1"].to_numpy()[has], "k2": rows["k2"].to_numpy()[has], "links": links[has], "later": later[has]})


#: Bytes of a word where sets are compared in full: 48 bits of its hash.
SHIPPED = 6


def _sets(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """48 bits of the words of each set, rare ones first, and the set's number."""
    rows = np.frombuffer(b"".join(packed), np.uint8).reshape(-1, SHIPPED)
    words = np.zeros((len(rows), 8), np.uint8)
    words[:, :SHIPPED] = rows
    sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // SHIPPED
    return words.view(np.uint64).ravel(), np.repeat(np.arange(len(packed)), sizes)


def _marks(needed: DataFrame, settings: Settings) -> np.ndarray:
    """Bits set at the hashes of (row_id, line): lets a scan pass over most lines that nobody asks for. 2 ** marks bits in all."""
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for block, at in b.groupby("block")["at"]:
                held.setdefault(block, np.zeros(8 * _BLOCK, bool))[at.to_numpy()] = True
        if held:
            yield pd.DataFrame({"block": list(held), "n": [np.packbits(v, bitorder="little").tobytes() for v in held.values()]})

    place = _place(needed["row_id"], needed["line"], settings)
    spots = needed.select(F.floor(place / (8 * _BLOCK)).cast("int").alias("block"), F.pmod(place, F.lit(8 * _BLOCK)).cast("int").alias("at")).distinct()
    out = np.zeros(((1 << settings.marks) // (8 * _BLOCK), _BLOCK), np.uint8)
    for r in spots.repartition("block").mapInPandas(pack, "block int, n binary").collect():
        out[r["block"]] = np.frombuffer(r["n"], np.uint8)
    return out.ravel()


def _place(row_id, line, settings: Settings):
    """Where (row_id, line) is marked: the same for columns and for arrays of unsigned numbers. Row ids of many partitions are large,
    so they are reduced before they are multiplied."""
    places = (1 << settings.marks) - 39
    if isinstance(row_id, np.ndarray):
        return (row_id % np.uint64(places) * np.uint64(1000003) + line) % np.uint64(places)
    places = F.lit(places).cast("long")
    return F.pmod(F.pmod(row_id, places) * F.lit(1000003).cast("long") + line, places)


def _word_sets(docs: DataFrame, needed: DataFrame, counts: np.ndarray, text_col: str, settings: Settings) -> DataFrame:
    """The words of the lines in `needed` (row_id, line, ...), rare ones first, in `SHIPPED` bytes each."""
    context = docs.sparkSession.sparkContext
    marks, shared = context.broadcast(_marks(needed, settings)), context.broadcast(counts)  # 2 ** marks bits, 2 ** counters bytes
    rows = docs.select(F.col(ROW).alias("row_id"), F.col(text_col).alias("text"))

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t or "" for t in b["text"]]
            many = np.array([t.count("\n") + 1 for t in texts], np.int64)
            ids = np.repeat(b["row_id"].to_numpy().astype(np.uint64), many)
            at = np.arange(len(ids)) - np.repeat(np.cumsum(many) - many, many)
            spot = _place(ids, at.astype(np.uint64), settings)
            asked = np.flatnonzero(marks.value[(spot >> np.uint64(3)).astype(np.int64)] >> (spot & np.uint64(7)).astype(np.uint8) & 1)
            of = np.repeat(np.arange(len(texts)), many)[asked]
            ids, at, body, open_ = ids[asked].view(np.int64), at[asked], [], -1
            for k, line in zip(of.tolist(), at.tolist()):
                if k != open_:
                    open_, lines = k, texts[k].split("\n")
                body.append(lines[line])
            for first, data in _pieces(body, settings.at_once):
                hashes, lines = _ordered(*words_of(b"\n".join(data)), shared.value)
                packed = np.ascontiguousarray((hashes >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :SHIPPED]).tobytes()
                upto = SHIPPED * np.searchsorted(lines, np.arange(len(data) + 1))
                yield pd.DataFrame({"r": ids[first:first + len(data)], "l": at[first:first + len(data)],
                                    "words": [packed[i:k] for i, k in zip(upto[:-1].tolist(), upto[1:].tolist())]})

    found = rows.mapInPandas(pick, "r long, l int, words binary")
    return needed.join(found, (F.col("row_id") == F.col("r")) & (F.col("line") == F.col("l"))).drop("r", "l")


def similar_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings(), stored: bool = False) -> DataFrame:
    """A row for each line of at least `words` different words: `row_id, doc_id, line, class_doc_id, class_line, links, removed`.

    Lines are parted by line feeds and numbered from 0; words are parted by white space, A-Z count as a-z. Lines of the same set of
    words are one class, named by its first line in the order of doc_id (null first), row and line. Two classes are linked when the
    Jaccard similarity of their sets is `similarity` or more; `links` counts a class's links. A line is removed when an earlier line
    has its set or is linked to it. Null and empty texts have no lines; an empty table gives no rows. Words are compared by 64-bit
    hashes, of which pairs compare 48 bits, sets of a class by 128 bits.

    A total order puts rare words first (`word_counts` over all texts). Similar sets share a word among the first few of either, so
    classes meet under these words only, and only where lengths, the words' positions, bit maps and the word before permit a match.
    A word that more than `group` classes start with is dealt out in pairs of parts. Only classes with a possible partner are looked at
    in full: their words are fetched again and the pairs verified within the group; what leaves a group are counts per class, not pairs.
    Ids may be numbers or strings. `stored` as in `rows_once`.
    """
    return _similar_lines(rows_once(docs.select(id_col, text_col), stored), id_col, text_col, settings)


def _similar_lines(docs: DataFrame, id_col: str, text_col: str, settings: Settings) -> DataFrame:
    none = F.lit("" if isinstance(docs.schema[id_col].dataType, T.StringType) else 0)
    counts = word_counts(docs, text_col, settings)
    lines = pin(line_rows(docs, counts, id_col, text_col, settings))
    classes = pin(lines.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "row_id", "line")).alias("first")))
    own = F.col("k1").bitwiseAND(F.lit((1 << ID_BITS) - 1))

    def partners(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, []
        for b in batches:
            for bucket, posts in zip(b["bucket"], b["posts"]):
                if bucket != at and held:
                    yield _with_partner(np.concatenate(held, axis=1), settings.similarity)
                    held = []
                at = bucket
                held.append(_unpacked(posts))
        if held:
            yield _with_partner(np.concatenate(held, axis=1), settings.similarity)

    posts = postings(lines, settings).repartition("bucket").sortWithinPartitions("bucket")
    members = pin(posts.mapInPandas(partners, "key long, id long, side int"))
    asked = members.select(F.col("id").alias("asked")).distinct()
    needed = pin(classes.withColumn("own", own).join(asked, F.col("own") == F.col("asked")).select(
        "k1", "k2", "own", F.col("first.doc_id").isNotNull().alias("named"), F.coalesce("first.doc_id", none).alias("doc"), "first.row_id", "first.line"))
    sets = _word_sets(docs, needed, counts, text_col, settings)
    full = members.join(sets, F.col("id") == F.col("own")).drop("id", "own")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _chunks(batches, "key", 1 << 14, "words", 8 * settings.at_once):
            yield _verified(rows, settings.similarity)

    linked = full.repartition("key").sortWithinPartitions("key").mapInPandas(verify, "k1 long, k2 long, links long, later boolean")
    linked = linked.groupBy(F.col("k1").alias("l1"), F.col("k2").alias("l2")).agg(F.sum("links").alias("links"), F.max("later").alias("later"))
    named = classes.select("k1", "k2", "first").join(linked, (F.col("k1") == F.col("l1")) & (F.col("k2") == F.col("l2")), "left").select(
        F.col("k1").alias("c1"), F.col("k2").alias("c2"), "first", F.coalesce("links", F.lit(0)).cast("long").alias("links"),
        F.coalesce("later", F.lit(False)).alias("later"))
    own = lines.select("row_id", "doc_id", "line", "k1", "k2").join(named, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")))
    leads = (F.col("first.row_id") == F.col("row_id")) & (F.col("first.line") == F.col("line"))
    return own.select("row_id", "doc_id", "line", F.col("first.doc_id").alias("class_doc_id"), F.col("first.line").alias("class_line"), "links",
                      (~leads | F.col("later")).alias("removed"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings(), stored: bool = False) -> DataFrame:
    """All documents, with their columns as they were, without the lines that `similar_lines` removes; null texts stay null.

    Columns named `__row`, `__r` or `__gone` would be lost.
    """
    numbered = rows_once(docs, stored)
    gone = _similar_lines(numbered, id_col, text_col, settings).where("removed").groupBy("row_id").agg(F.collect_set("line").alias("__gone"))
    both = numbered.join(gone.withColumnRenamed("row_id", "__r"), F.col(ROW) == F.col("__r"), "left")
    kept = F.filter(F.split(text_col, "\n"), lambda _, i: ~F.array_contains("__gone", i))
    cleaned = F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    return both.withColumn(text_col, cleaned).select(*docs.columns)
