"""Packing of token pieces into sequences by minimum bin slack over the counts of lengths."""
from __future__ import annotations

import os
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.numbering import number_rows
from tidewatch.sources.tables import pin, small_batches

#: Rows that Spark and a worker hand each other at a time: whole texts, so a few.
ROWS_AT_ONCE = 512
#: Runs of letters or signs whose ids a worker remembers.
REMEMBERED = 250_000
#: Texts looked through for new runs at a time, and new runs encoded in one string.
TOGETHER, JOINED = 64, 500
#: What is known to come apart into runs of letters, single digits and runs of signs, each encoded by itself.
PLAIN = re.compile(r"[0-9A-Za-zÀ-ÖØ-öø-ÿ!-&(-/:-@\[-`{-~ \t\n\r\x0b\x0c]*")
RUNS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[^0-9A-Za-zÀ-ÖØ-öø-ÿ \t\n\r\x0b\x0c]+")

_encoders: dict[str, "_Runs"] = {}


class _Runs:
    """Token ids of runs as little-endian bytes; a worker keeps one for each tokenizer."""

    def __init__(self, path: str):
        # tasks are the parallel work: threads of a worker's own would each keep memory, and compete for the cores
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.bare = Tokenizer(self.whole.model)  # for lower-case runs: the model without the search for runs
        self.bare.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.whole.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, runs: list[str]) -> None:
        """Adds new runs, many in one string: each ends with a token that ends a word."""
        strings = [" ".join(runs[i:i + JOINED]) for i in range(0, len(runs), JOINED)]
        ids = np.concatenate([np.zeros(0, "<u4"), *(np.array(e.ids, "<u4") for e in self.bare.encode_batch_fast(strings, add_special_tokens=False))])
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(runs):
            raise ValueError("this tokenizer does not mark word ends")
        flat, stops = ids.astype("<u4").tobytes(), (4 * stops).tolist()
        self.known.update(zip(runs, [flat[i:k] for i, k in zip([0, *stops[:-1]], stops)]))


def encoded(texts: Iterable[str | None], runs: _Runs) -> Iterator[bytes]:
    """Ids of each whole text, as bytes.

    The tokenizer lower-cases, drops white space and encodes runs of letters, single digits and runs of signs apart, so the ids of
    a text of known letters and signs are those of its runs in turn, each encoded once. Any other text is encoded as it is.
    """
    texts = iter(texts)
    get = runs.known.get
    while some := list(islice(texts, TOGETHER)):
        if len(runs.known) > REMEMBERED:
            runs.known.clear()
        parts = [RUNS.findall(t.lower()) if PLAIN.fullmatch(t) and "<|" not in t else None for t in (t or "" for t in some)]
        found = [None if p is None else list(map(get, p)) for p in parts]
        gaps = [[] if f is None or None not in f else [i for i, v in enumerate(f) if v is None] for f in found]
        new = {p[i] for p, g in zip(parts, gaps) for i in g}
        if new:
            runs.learn(list(new))
        for t, p, f, g in zip(some, parts, found, gaps):
            if f is None:
                yield runs.encode(t)
                continue
            for i in g:
                f[i] = get(p[i])
            yield b"".join(f)


def token_pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text",
                 with_ids: bool = False) -> DataFrame:
    """Pieces of every document: `row_id, doc_id, piece, start, length, ids_crc32`, and `ids` (bytes) on demand.

    A document is its text's ids, then `end_id`; null and empty texts are `end_id` alone. Only documents longer than `capacity` are
    cut, into pieces of that length and a last one of the rest. `row_id` numbers the rows as read, so repeated ids stay apart.
    """
    # ids pass Python as text, whatever their type
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    schema = rows.select("row_id", "doc_id").schema.add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long")
    if with_ids:
        schema = schema.add("ids", "binary")
    last = int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = _Runs(path)
        runs = _encoders[path]
        for b in batches:
            owner, piece, start, length, crc, kept = [], [], [], [], [], []
            # texts become Python strings some at a time
            texts = (t for at in range(0, len(b), TOGETHER) for t in b["text"].slice(at, TOGETHER).to_pylist())
            for i, ids in enumerate(encoded(texts, runs)):
                ids += last
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    owner.append(i), piece.append(k), start.append(at // 4), length.append(len(part) // 4), crc.append(zlib.crc32(part))
                    if with_ids:
                        kept.append(part)
            ids_of = [pa.array(kept, pa.binary())] if with_ids else []
            of = pa.array(owner, pa.int64())
            yield pa.record_batch([b["row_id"].take(of), b["doc_id"].take(of), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                                   pa.array(length, pa.int64()), pa.array(crc, pa.int64()), *ids_of], schema.names)

    return rows.mapInArrow(cut, schema).withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))


@dataclass
class Run:
    """`times` sequences from number `first` on, each with `count` pieces of one length from `offset` on; their ranks from `rank`."""
    length: int
    rank: int
    count: int
    times: int
    first: int
    offset: int


def _fullest(space: int, counts: np.ndarray) -> dict[int, int]:
    """The available lengths whose sum comes closest to `space` from below: subset sums as bits of one integer."""
    whole = (1 << (space + 1)) - 1
    sums, before = 1, []
    for length in np.flatnonzero(counts[:space + 1])[::-1].tolist():  # long ones first: short ones are left for later gaps
        before.append((length, sums))
        copies, step = min(int(counts[length]), space // length), 1
        while copies > 0:  # 1, 2, 4, .. copies and the rest: every number up to `copies`
            take = min(step, copies)
            sums |= (sums << (take * length)) & whole
            copies, step = copies - take, step * 2
        if sums >> space & 1:
            break
    at, chosen = sums.bit_length() - 1, {}
    for length, reached in reversed(before):
        n = 0
        while not reached >> at & 1:
            at, n = at - length, n + 1
        if n:
            chosen[length] = n
    return chosen


def minimum_bin_slack(counts: dict[int, int], capacity: int) -> list[Run]:
    """Sequences for pieces given as counts by length, each filled as far as the pieces still there permit.

    A sequence takes the longest piece left and the combination that fills the rest best; those pieces are removed, as often as the
    same combination can be made again. Each combination uses up a length or leaves less of it than it takes, so their number
    depends on `capacity`, not on the number of pieces.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    used, runs, first = Counter(), [], 0
    longest = capacity
    while True:
        while longest and not left[longest]:
            longest -= 1
        if not longest:
            return runs
        left[longest] -= 1
        combination = Counter(_fullest(capacity - longest, left))
        left[longest] += 1
        combination[longest] += 1
        times = min(int(left[length]) // n for length, n in combination.items())
        offset = 0
        for length, n in sorted(combination.items(), reverse=True):
            runs.append(Run(length, used[length], n, times, first, offset))
            used[length] += n * times
            left[length] -= n * times
            offset += n * length
        first += times


def packed(pieces: DataFrame, capacity: int = 2048, by: list[str] | None = None) -> DataFrame:
    """Adds `sequence_id` and `offset` to every piece; lengths are 1 to `capacity`.

    Only the counts of lengths, at most `capacity` numbers, are packed on the driver (`minimum_bin_slack`). Pieces of a length are
    interchangeable: each gets its rank among them, counted in hash cells so that a frequent length is no task's burden, and the
    rank says which sequence it goes to and where. `by` orders equal lengths; its first column should be an id. `pieces` is read
    three times: pass a stored table.
    """
    by = by or ["row_id", "piece"]
    counts = {int(r["length"]): r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = minimum_bin_slack(counts, capacity)
    by_length: dict[int, dict[str, np.ndarray]] = {}
    for length in counts:
        own = [r for r in runs if r.length == length]
        by_length[length] = {k: np.array([getattr(r, k) for r in own], np.int64) for k in ("rank", "count", "first", "offset")}
    plain = pieces.drop("sequence_id", "offset")
    ranked = number_rows(plain, by, group=["length"], name="__rank_of_length", cells=64)

    @F.pandas_udf("sequence_id long, offset long")
    def place(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for length_of, rank_of in batches:
            lengths, ranks = length_of.to_numpy(), rank_of.to_numpy()
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for length in np.unique(lengths):
                rows, run = np.flatnonzero(lengths == length), by_length[int(length)]
                at = np.searchsorted(run["rank"], ranks[rows], "right") - 1
                since = ranks[rows] - run["rank"][at]
                sequence[rows] = run["first"][at] + since // run["count"][at]
                offset[rows] = run["offset"][at] + since % run["count"][at] * length
            yield pd.DataFrame({"sequence_id": sequence, "offset": offset})

    placed = ranked.withColumn("__at", place("length", "__rank_of_length"))
    return placed.select(*[F.col(c) for c in plain.columns], "__at.sequence_id", "__at.offset")


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents as pieces in sequences of at most `capacity` tokens (see `token_pieces` and `packed`). An empty table gives no rows."""
    with small_batches(docs.sparkSession, ROWS_AT_ONCE):
        pieces = pin(token_pieces(docs, path, capacity, end_id, id_col, text_col))
    return packed(pieces, capacity)
