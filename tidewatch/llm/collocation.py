"""Phrases that hold together, from a weighted de Bruijn graph of word runs."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.llm.divergence import SLICE_BYTES, slices
from tidewatch.sources.tables import pin

#: Words of the longest phrase: an edge of the graph. Its nodes are one word shorter.
ORDER = 5
#: Bits of the filter that tells which neighbouring words are frequent; its size is fixed.
FILTER_BITS = 24
#: Edges in one row of a compacted path; a longer path has several rows.
PATH_EDGES = 1024
#: What bytes are: 0 in words, 1 between words, 2 between pieces.
KINDS = np.zeros(256, np.uint8)
KINDS[[0x20, 0x09]] = 1
KINDS[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2


def split_words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All words of the texts with A-Z lower-cased, as codes of a dictionary, and whether each begins a piece.

    Pieces end at the texts' ends and at KINDS 2; the work is one pass of array operations over the bytes.
    """
    texts = pc.ascii_lower(texts.cast(pa.large_string()))
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]
    ends = ends - ends[0]
    kind = KINDS[data]
    word = kind == 0
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    inner = ends[:-1][ends[:-1] < len(data)]
    begins[inner] = word[inner]
    starts = np.flatnonzero(begins)
    kept = np.cumsum(word, dtype=np.int64)
    offsets = np.append(kept[starts] - 1, int(kept[-1]) if len(kept) else 0)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[word].tobytes()))
    breaks = kind == 2
    piece = np.cumsum(breaks, dtype=np.int64)[starts] + np.searchsorted(ends, starts, side="right")
    return words.dictionary_encode(), np.diff(piece, prepend=-1) != 0


def _marks(words: pa.Array, lang: str) -> np.ndarray:
    """A 64-bit hash of each word and its language."""
    seed = xxhash.xxh64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words.cast(pa.large_binary()).to_pylist()), np.uint64, len(words))


def _pair_mark(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    mixed = (left * np.uint64(0x9E3779B97F4A7C15)) ^ (right + np.uint64(0x632BE59BD9B4E019))
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(32))


def _cut(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """The texts as they are, or, where they are long, one after the other in stretches of about `limit` bytes that end with a piece."""
    if texts.nbytes <= 4 * limit:
        yield texts
        return
    for text in texts.cast(pa.large_binary()):
        data = np.frombuffer(text.as_py(), np.uint8)
        ends = np.append(np.flatnonzero(KINDS[data] == 2) + 1, len(data))
        low = 0
        while low < len(data):
            high = int(ends[max(np.searchsorted(ends, low + limit, side="right") - 1, np.searchsorted(ends, low, side="right"))])
            yield pa.array([data[low:high].tobytes()], pa.large_binary()).cast(pa.large_string())
            low = high


def _by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.DictionaryArray, np.ndarray]]:
    for batch in batches:
        for part in slices(batch, "text"):
            langs = part["lang"].dictionary_encode()
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                for texts in _cut(part["text"].filter(pc.equal(langs.indices, i))):
                    yield lang, *split_words(texts)


WORDS = "lang string, word string, pair long, n long"


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of three kinds: words with their counts, hashed pairs of neighbours with theirs, and each language's total."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("pair", pa.int64()), ("n", pa.int64())])
    for lang, words, first in _by_lang(batches):
        code = words.indices.to_numpy()
        names = words.dictionary.cast(pa.string())
        counts = np.bincount(code, minlength=len(names)).astype(np.int64)
        mark = _marks(names, lang)[code]
        pairs, times = np.unique(_pair_mark(mark[:-1], mark[1:])[~first[1:]], return_counts=True)
        for word, pair, n in ((names, pa.nulls(len(names), pa.int64()), counts), (pa.nulls(len(pairs), pa.string()), pa.array(pairs.view(np.int64)), times),
                              (pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), np.array([len(code)]))):
            # a hashed pair has its language in the hash
            yield pa.record_batch([pa.array([lang if pair.null_count else ""] * len(n), pa.string()), word, pair, pa.array(n.astype(np.int64))], schema=schema)


def _grams(filter_bits: np.ndarray):
    """Of runs of words whose neighbours are all frequent: each 5-gram, and the run's last words (2 to 4)."""
    schema = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())])
    low = np.uint64((1 << FILTER_BITS) - 1)

    def text(names: pa.Array, columns: list[np.ndarray]) -> pa.Array:
        return pc.binary_join_element_wise(*[names.take(pa.array(c)) for c in columns], " ")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, first in _by_lang(batches):
            code, names = words.indices.to_numpy(), words.dictionary.cast(pa.string())
            if len(code) < 2:
                continue
            mark = _marks(names, lang)[code]
            at = (_pair_mark(mark[:-1], mark[1:]) & low).astype(np.int64)
            joined = ((filter_bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool) & ~first[1:]
            # words in the run up to and with each word
            place = np.arange(len(code))
            start = np.where(np.r_[True, ~joined], place, 0)
            depth = place - np.maximum.accumulate(start) + 1
            ending = np.r_[~joined, True]
            found = []
            for size in range(2, ORDER + 1):
                here = np.flatnonzero(depth >= ORDER) if size == ORDER else np.flatnonzero(ending & (np.minimum(depth, ORDER - 1) == size))
                if len(here):
                    found.append(text(names, [code[here - k] for k in range(size - 1, -1, -1)]))
            if found:
                counted = pc.value_counts(pa.concat_arrays(found))
                grams, n = counted.field("values"), counted.field("counts")
                yield pa.record_batch([pa.array([lang] * len(grams), pa.string()), grams, n], schema=schema)

    return work


def _frequent_filter(pairs: DataFrame) -> np.ndarray:
    """A fixed number of bits, those of frequent pairs set; others may be set by chance, which costs work and changes nothing."""
    # these functions number buckets and bits from the value 1 on
    bits = pairs.select((F.col("pair").bitwiseAND((1 << FILTER_BITS) - 1) + 1).alias("at"))
    rows = bits.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    found = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for r in rows:
        low = (r["bucket"] - 1) * 4096
        found[low:low + 4096] |= np.frombuffer(r["bits"], np.uint8)[:len(found) - low]
    return found


def _head(gram: Column) -> Column:
    return F.substr(gram, F.lit(1), F.char_length(gram) - F.char_length(F.substring_index(gram, " ", -1)) - 1)


def _rest(gram: Column) -> Column:
    return F.substr(gram, F.instr(gram, " ") + 1)


def _size(gram: Column) -> Column:
    return F.size(F.split(gram, " "))


def word_graph(grams: DataFrame) -> DataFrame:
    """The nodes of the graph: `lang, node, n, unary, back`.

    Edges are the grams of ORDER words, from their first to their last ORDER - 1; shorter grams are the ends of runs. A node's count is
    the flow out of it plus the runs that end in it. It is unary if all its flow comes in by one edge and leaves by one; `back` is the
    first word of that edge.
    """
    edge = _size(F.col("gram")) == ORDER
    zero = F.lit(0).cast("long")
    edges = grams.where(edge)
    parts = edges.select("lang", _head(F.col("gram")).alias("node"), F.col("n").alias("out"), F.lit(1).alias("outs"), zero.alias("into"), F.lit(0).alias("ins"),
                         zero.alias("ends"), F.lit(None).cast("string").alias("back"))
    parts = parts.unionAll(edges.select("lang", _rest(F.col("gram")), zero, F.lit(0), "n", F.lit(1), zero, F.substring_index("gram", " ", 1)))
    parts = parts.unionAll(grams.where(_size(F.col("gram")) == ORDER - 1).select("lang", "gram", zero, F.lit(0), zero, F.lit(0), "n", F.lit(None)))
    nodes = parts.groupBy("lang", "node").agg(*[F.sum(c).alias(c) for c in ("out", "outs", "into", "ins", "ends")], F.min("back").alias("back"))
    unary = (F.col("outs") == 1) & (F.col("ins") == 1) & (F.col("ends") == 0) & (F.col("out") == F.col("into"))
    return nodes.select("lang", "node", (F.col("out") + F.col("ends")).alias("n"), unary.alias("unary"), F.when(unary, F.col("back")).alias("back"))


def compact_paths(grams: DataFrame, nodes: DataFrame) -> DataFrame:
    """`lang, head, part, n, words`: edges joined through unary nodes, all of one count n; `words` spells PATH_EDGES edges at most.

    Edges on both sides of a unary node have its count, so `grams` and `nodes` may be those of a least count.
    Each edge behind a unary node points to the edge before it; pointers are doubled until all name the first edge of their path. Unary
    nodes form no circles, since pieces have a beginning.
    """
    turns = nodes.where("unary").select(F.col("lang").alias("u_lang"), F.col("node").alias("u_node"), "back")
    edges = grams.where(_size(F.col("gram")) == ORDER).withColumn("node", _head(F.col("gram")))
    edges = edges.join(turns, (F.col("lang") == F.col("u_lang")) & (F.col("node") == F.col("u_node")), "left")
    first = F.col("back").isNull()
    state = pin(edges.select("lang", "gram", "n", F.when(first, F.col("gram")).otherwise(F.concat_ws(" ", "back", "node")).alias("to"),
                             F.when(first, 0).otherwise(1).cast("long").alias("steps"), first.alias("done")))
    while state.where(~F.col("done")).limit(1).count():
        known = state.select(F.col("lang").alias("k_lang"), F.col("gram").alias("k_gram"), F.col("to").alias("k_to"), F.col("steps").alias("k_steps"),
                             F.col("done").alias("k_done"))
        moved = state.where(~F.col("done")).join(known, (F.col("lang") == F.col("k_lang")) & (F.col("to") == F.col("k_gram"))).select(
            "lang", "gram", "n", F.col("k_to").alias("to"), (F.col("steps") + F.col("k_steps")).alias("steps"), F.col("k_done").alias("done"))
        state = pin(state.where("done").unionByName(moved))
    part = F.floor(F.col("steps") / PATH_EDGES)
    found = state.groupBy("lang", F.col("to").alias("head"), part.alias("part")).agg(
        F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("steps", "gram"))).alias("edges"))
    words = F.concat(F.split(F.col("edges")[0]["gram"], " "), F.transform(F.slice("edges", 2, PATH_EDGES), lambda e: F.substring_index(e["gram"], " ", -1)))
    return found.select("lang", "head", "part", "n", F.array_join(words, " ").alias("words"))


def _flow(longer: DataFrame, ends: DataFrame, size: int) -> DataFrame:
    """Counts of all phrases of `size` words: the flow into longer ones that begin with them, plus the runs that end in them."""
    parts = longer.select("lang", _head(F.col("phrase")).alias("phrase"), "n").unionAll(
        ends.where(_size(F.col("gram")) >= size).select("lang", F.substring_index("gram", " ", -size), "n"))
    return parts.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _along(paths: DataFrame, size: int, begin: Column) -> DataFrame:
    """The phrases of `size` words along paths, one for each edge from the given one on, with the path's count."""
    words = F.split("words", " ")
    edges = F.size(words) - (ORDER - 1)
    places = F.filter(F.sequence(F.lit(1), edges), lambda i: i > begin)
    return paths.select("lang", F.explode(F.transform(places, lambda i: F.array_join(F.slice(words, i, size), " "))).alias("phrase"), "n")


def frequent_phrases(docs: DataFrame, least: int = 100) -> tuple[DataFrame, DataFrame]:
    """`lang, phrase, size, n` of all phrases of 1 to ORDER words that occur `least` times in their language, and `lang, total`.

    A phrase can be frequent only where all its neighbouring words are, so pieces are first cut between others: pairs are counted by a
    64-bit hash, and a filter of fixed size passes all frequent ones. Of the runs left, only edges (ORDER words) and run ends are
    counted; the graph's flow gives all shorter counts. Null text is empty, null lang is `und`.
    """
    rows = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text"), F.coalesce(F.col("lang"), F.lit("und")).alias("lang"))
    counted = rows.mapInArrow(_count_words, WORDS).groupBy("lang", "word", "pair").agg(F.sum("n").alias("n"))
    total = F.col("word").isNull() & F.col("pair").isNull()
    counted = pin(counted.where((F.col("n") >= least) | total))
    bits = _frequent_filter(counted.where(F.col("pair").isNotNull()))
    grams = pin(rows.mapInArrow(_grams(bits), "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    nodes = pin(word_graph(grams))
    # what occurs less often only adds to the flow into shorter phrases, from the nodes as they are
    paths = pin(compact_paths(grams.where(F.col("n") >= least), nodes.where(F.col("n") >= least)))
    ends = grams.where(_size(F.col("gram")) < ORDER)
    inner = _along(paths, ORDER - 1, F.when(F.col("part") > 0, 0).otherwise(1))
    shorter = pin(inner.unionAll(nodes.where(~F.col("unary") | (F.col("n") < least)).select("lang", "node", "n")))
    found = [counted.where(F.col("word").isNotNull()).select("lang", F.col("word").alias("phrase"), "n"), _along(paths, ORDER, F.lit(0)), shorter]
    for size in range(ORDER - 2, 1, -1):
        found.append(_flow(found[-1], ends, size))
    often = found[0]
    for f in found[1:]:
        often = often.unionByName(f)
    often = often.where(F.col("n") >= least).select("lang", "phrase", _size(F.col("phrase")).alias("size"), "n")
    return pin(often), counted.where(total).select("lang", F.col("n").alias("total"))


def _score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 * a * n / (left * right)), exactly, for counts below 10^16."""
    a, n, left, right = (c.cast("decimal(16,0)") for c in (a, n, left, right))
    return F.call_function("div", a * n * F.lit(1000).cast("decimal(4,0)"), left * right)


def collocations(docs: DataFrame, least: int = 100, first: int = 2000) -> DataFrame:
    """`lang, rank, phrase, a, l, r, n, score`: each language's `first` phrases of 2 to ORDER words by how far they hold together.

    a is the phrase's count (at least `least`), n that of all words. Cut after its first k words, l and r count both parts; the cut
    with the lowest 1000 * a * n / (l * r), rounded down, is the phrase's score (ties: the least k). A phrase inside a longer one that is
    as frequent is dropped. Ranks go by score and a, descending, then by the phrase's UTF-8 bytes. Null text is empty, null lang is
    `und`; other columns are not read; a table without frequent phrases gives no rows.
    """
    often, totals = frequent_phrases(docs, least)
    whole = often.where(F.col("size") > 1)
    # a longer phrase as frequent as this one: then one of one word more is, too
    around = whole.where(F.col("size") > 2).select(F.col("lang").alias("x_lang"), F.explode(F.array(_head(F.col("phrase")), _rest(F.col("phrase")))).alias("x_phrase"), "n")
    around = around.groupBy("x_lang", "x_phrase").agg(F.max("n").alias("most"))
    whole = whole.join(around, (F.col("lang") == F.col("x_lang")) & (F.col("phrase") == F.col("x_phrase")), "left")
    whole = whole.where(F.col("most").isNull() | (F.col("most") < F.col("n"))).select("lang", "phrase", "size", F.col("n").alias("a"))
    cuts = whole.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumn("left", F.expr("substring_index(phrase, ' ', k)")).withColumn("right", F.expr("substring_index(phrase, ' ', k - size)"))
    for side, name in (("left", "l"), ("right", "r")):
        part = often.select(F.col("lang").alias("p_lang"), F.col("phrase").alias("p_phrase"), F.col("n").alias(name))
        cuts = cuts.join(part, (F.col("lang") == F.col("p_lang")) & (F.col(side) == F.col("p_phrase"))).drop("p_lang", "p_phrase")
    cuts = cuts.join(totals.select(F.col("lang").alias("t_lang"), F.col("total").alias("n")), F.col("lang") == F.col("t_lang"))
    cuts = cuts.withColumn("score", _score(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    best = best.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score", F.pmod(F.xxhash64("phrase"), F.lit(64)).alias("salt"))
    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    for keys in (["lang", "salt"], ["lang"]):
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col("rank") <= first)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
