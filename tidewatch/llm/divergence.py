"""How far the sources of a language differ in their words: counts by Arrow compute functions, divergences from merged columnar shards."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.sources.tables import pin

#: What stands between terms: ASCII other than letters. All beyond ASCII belongs to terms.
BREAKS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of text worked off at a time, and partial counts a task holds before it passes them on.
SLICE_BYTES, HELD_ROWS = 4 << 20, 500_000
#: Probabilities are counted in parts of SCALE; each term counts SMOOTH times more than it occurs.
SCALE, SMOOTH = 1_000_000_000, 5
#: Cells (source, term) in a shard, about.
SHARD_CELLS = 200_000
COUNTS = "lang string, source string, term string, n long, d long"


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts hold about `limit` bytes; a longer text is a run of its own."""
    size = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
    at = np.cumsum(size) // limit
    edges = np.flatnonzero(np.diff(at, prepend=-1))
    for a, b in zip(edges, [*edges[1:], len(size)]):
        yield batch.slice(a, b - a)


def _merge(parts: list[pa.Table]) -> pa.Table:
    """Partial counts of one key added up."""
    found = pa.concat_tables(parts).group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ("d", "sum")])
    return found.rename_columns(["lang", "source", "term", "n", "d"])


def _count(batch: pa.RecordBatch) -> pa.Table:
    """Occurrences n and documents d of each (lang, source, term); a row without a term for each (lang, source)."""
    doc = pa.array(np.arange(batch.num_rows, dtype=np.int32))
    split = pc.split_pattern_regex(pc.ascii_lower(batch["text"]), pattern=BREAKS)
    terms = pc.list_flatten(split)
    of = pc.take(doc, pc.list_parent_indices(split))
    real = pc.greater(pc.binary_length(terms), 0)
    coded = pc.dictionary_encode(terms.filter(real))
    in_doc = pa.table({"doc": of.filter(real), "code": coded.indices}).group_by(["doc", "code"], use_threads=False).aggregate([([], "count_all")])
    lang, source = pc.dictionary_encode(batch["lang"]), pc.dictionary_encode(batch["source"])
    both = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
    kind, kind_of, size = np.unique(both, return_inverse=True, return_counts=True)
    langs = pc.take(lang.dictionary, pa.array(kind // len(source.dictionary)))
    sources = pc.take(source.dictionary, pa.array(kind % len(source.dictionary)))
    found = pa.table({"kind": pc.take(pa.array(kind_of), in_doc["doc"]), "code": in_doc["code"], "n": in_doc["count_all"]})
    found = found.group_by(["kind", "code"], use_threads=False).aggregate([("n", "sum"), ("n", "count")])
    counts = pa.table({"lang": pc.take(langs, found["kind"]), "source": pc.take(sources, found["kind"]),
                       "term": pc.take(coded.dictionary, found["code"]), "n": found["n_sum"], "d": found["n_count"]})
    none = pa.table({"lang": langs, "source": sources, "term": pa.nulls(len(kind), pa.string()), "n": pa.array(np.zeros(len(kind), np.int64)),
                     "d": pa.array(size.astype(np.int64))})
    return pa.concat_tables([counts.combine_chunks(), none])


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    rows = 0
    for batch in batches:
        for part in slices(batch, "text"):
            held.append(_count(part))
            rows += held[-1].num_rows
            if rows > HELD_ROWS:
                held = [_merge(held)]
                rows = held[0].num_rows
                if rows > HELD_ROWS // 2:
                    yield from held[0].combine_chunks().to_batches()
                    held, rows = [], 0
    if held:
        yield from _merge(held).combine_chunks().to_batches()


def term_counts(docs: DataFrame) -> DataFrame:
    """`lang, source, term, n, d`: occurrences of each term and the documents that hold it, per (lang, source).

    Each (lang, source) also has one row with a null term, d being all its documents. Columns text, lang and source are read; nulls
    count as empty. Tasks add up what they can before anything is shuffled, and hold a bounded number of counts at a time.
    """
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    return rows.mapInArrow(_partial_counts, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * terms)), exactly, as a long."""
    over = (count + F.lit(SMOOTH)).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", over, (total + F.lit(SMOOTH) * terms).cast("decimal(20,0)")) + F.lit(1)


def _shard(top: int):
    """Of one shard: the summed differences of each two sources, and each source's first `top` terms."""
    out = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])

    def rows(lang, source, part, item, value):
        return pa.table([pa.array([lang] * len(source), pa.string()), source, pa.array([part] * len(source), pa.string()), item, value], schema=out)

    def work(sources: pa.Table, cells: pa.Table) -> pa.Table:
        lang = sources["lang"][0].as_py()
        names = sources["source"].combine_chunks()
        absent = sources["absent"].to_numpy()
        parts = []
        at = pc.index_in(cells["source"], names).to_numpy()
        coded = cells["term"].combine_chunks().dictionary_encode()
        code, p = coded.indices.to_numpy(), cells["p"].to_numpy()
        apart = np.zeros((len(absent), len(absent)), np.int64)
        width = max(1, SHARD_CELLS // max(1, len(absent)))
        order = np.argsort(code, kind="stable")
        for low in range(0, len(coded.dictionary), width):
            take = order[np.searchsorted(code[order], low):np.searchsorted(code[order], low + width)]
            block = np.repeat(absent[:, None], min(width, len(coded.dictionary) - low), axis=1)
            block[at[take], code[take] - low] = p[take]
            for i in range(len(absent)):
                apart[i] += np.abs(block - block[i]).sum(axis=1)
        mine, other = np.nonzero(~np.eye(len(absent), dtype=bool))
        parts.append(rows(lang, names.take(pa.array(mine)), "pair", names.take(pa.array(other)), pa.array(apart[mine, other])))
        over = pc.greater(cells["p"], cells["q"])
        more = pa.table({"source": cells["source"], "item": cells["term"], "value": pc.subtract(cells["p"], cells["q"])}).filter(over)
        more = more.sort_by([("source", "ascending"), ("value", "descending"), ("item", "ascending")]).combine_chunks()
        if more.num_rows:
            named = more["source"].combine_chunks().dictionary_encode().indices.to_numpy()
            first = np.r_[0, np.flatnonzero(np.diff(named)) + 1]
            rank = np.arange(len(named)) - np.repeat(first, np.diff(np.r_[first, len(named)]))
            more = more.filter(pa.array(rank < top))
            parts.append(rows(lang, more["source"], "term", more["item"], more["value"]))
        return pa.concat_tables(parts)

    return work


def source_divergence(docs: DataFrame, least_docs: int = 30, top: int = 50) -> DataFrame:
    """`lang, source, part, item, value, rank`: how far each source's words are from those of the other sources and of its language.

    Terms are runs of letters (A-Z lower-cased, everything beyond ASCII being a letter); a language keeps the terms in at least
    `least_docs` of its documents. p is a term's smoothed share in a group, in parts of 1e9, rounded down, plus 1. Part `pair`: for
    each other source of the language, the sum of |p - q| over all kept terms. Part `term`: the `top` kept terms that occur in the
    group and are more frequent there than in the language. Ranks go by value, then by the item's UTF-8 bytes.

    Null lang, source and text count as empty; a group without terms takes part; a single source has no pairs; a language that keeps
    nothing has pairs of value 0; an empty table gives no rows. Other columns are not read. Kept counts are dealt into shards of
    terms of about `SHARD_CELLS` cells, so that no source, language or term meets one task; a shard gives one row per pair.
    """
    of_term = Window.partitionBy("lang", "term")
    counts = term_counts(docs).select("lang", "source", "term", "n", F.sum("n").over(of_term).alias("in_lang"), F.sum("d").over(of_term).alias("in_docs"),
                                      (F.row_number().over(of_term.orderBy("source")) == 1).cast("long").alias("first"))
    counts = pin(counts.where(F.col("term").isNull() | (F.col("in_docs") >= least_docs)).drop("in_docs"))
    cells = counts.where(F.col("term").isNotNull())
    shards = 1 + cells.count() // SHARD_CELLS
    one = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    whole = cells.groupBy(F.col("lang").alias("v_lang")).agg(F.sum("n").alias("lang_total"), F.sum("first").alias("terms"))
    groups = counts.where(F.col("term").isNull()).select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"))
    groups = groups.join(one, (F.col("lang") == F.col("g_lang")) & (F.col("source") == F.col("g_source")), "left").join(
        whole, F.col("g_lang") == F.col("v_lang"), "left")
    none = F.lit(0).cast("long")
    groups = pin(groups.select("g_lang", "g_source", *[F.coalesce(c, none).alias(c) for c in ("total", "lang_total", "terms")]))
    told = groups.select(F.col("g_lang").alias("lang"), F.col("g_source").alias("source"),
                         F.when(F.col("terms") > 0, _share(none, F.col("total"), F.greatest("terms", F.lit(1)))).otherwise(0).alias("absent"),
                         F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    scored = cells.join(groups, (F.col("lang") == F.col("g_lang")) & (F.col("source") == F.col("g_source"))).select(
        "lang", "source", "term", _share(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
        _share(F.col("in_lang"), F.col("lang_total"), F.col("terms")).alias("q"),
        F.pmod(F.xxhash64("term"), F.lit(shards)).cast("int").alias("shard"))
    parts = told.groupBy("lang", "shard").cogroup(scored.groupBy("lang", "shard")).applyInArrow(
        _shard(top), "lang string, source string, part string, item string, value long")
    found = parts.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    ranked = found.withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top))
