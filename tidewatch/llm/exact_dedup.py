"""Exact duplicates by salted combining: local, per salt, then global, with the whole text compared at each stage."""
from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.numbering import ROW, rows_once

#: Parts that a group of equal texts is first merged in.
SALTS = 32


def folded(text: Column) -> Column:
    """The text with A-Z in lower case and nothing else changed; null becomes empty."""
    t = F.coalesce(text, F.lit(""))
    # both branches say the same; the first is quick and may be taken where no other letter exists
    return F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(
        F.translate(t, string.ascii_uppercase, string.ascii_lowercase))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, stored: bool = False) -> DataFrame:
    """One narrow row per document: `row_id, doc_id, keep_id, group_size, kept, text_sha256`.

    Texts are equal when they are identical after lower-casing A-Z; null counts as empty. Of equal texts the row with the largest
    id stays, null ids coming last; of rows that repeat both, exactly one stays. Grouping keys hold the digest and the whole text,
    so texts of one digest are still told apart. Each task first combines its own rows (map-side aggregation), what tasks found is
    merged per (digest, salt), and the salts' winners are merged at last: a group meets one task only as `salts` rows. Members look
    their winner up by digest, length and a second hash, in narrow rows. `row_id` numbers the rows; `stored` as in `rows_once`.
    Ids may be numbers or strings. An empty table gives no rows.
    """
    return _groups(rows_once(docs.select(id_col, text_col), stored), id_col, text_col, salts)


def _groups(numbered: DataFrame, id_col: str, text_col: str, salts: int) -> DataFrame:
    rows = numbered.select(F.col(ROW).alias("row_id"), F.col(id_col).alias("doc_id"), folded(F.col(text_col)).alias("body"))
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.col("body").cast("binary"), 256)))
    if isinstance(numbered.schema[id_col].dataType, T.IntegralType):
        order = F.coalesce(F.col("doc_id"), F.lit(-(2**63)).cast("long"))  # a plain number is combined by hash, a struct by sorting
    else:
        order = F.struct(F.col("doc_id").isNotNull(), F.col("doc_id"))
    local = rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts))).withColumn("ord", order)
    salted = local.groupBy("digest", "salt", "body").agg(
        F.max("ord").alias("ord"), F.max_by("row_id", "ord").alias("row"), F.max("doc_id").alias("id"), F.count(F.lit(1)).alias("n"))
    winners = salted.groupBy("digest", "body").agg(
        F.max_by("row", "ord").alias("keep_row"), F.max("id").alias("keep_id"), F.sum("n").alias("group_size"))
    winners = winners.select(F.col("digest").alias("w_digest"), F.octet_length("body").alias("w_bytes"), F.xxhash64("body").alias("w_hash"),
                             "keep_row", "keep_id", "group_size")
    members = rows.select("row_id", "doc_id", "digest", F.octet_length("body").alias("bytes"), F.xxhash64("body").alias("hash"))
    found = members.join(winners, (F.col("digest") == F.col("w_digest")) & (F.col("bytes") == F.col("w_bytes")) & (F.col("hash") == F.col("w_hash")))
    return found.select("row_id", "doc_id", "keep_id", "group_size", (F.col("row_id") == F.col("keep_row")).alias("kept"),
                        F.lower(F.hex("digest")).alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, stored: bool = False) -> DataFrame:
    """The rows that stay, with their columns as they were: one of each group of equal texts (see `exact_groups`).

    A column named `__row` would be lost.
    """
    numbered = rows_once(docs, stored)
    gone = _groups(numbered, id_col, text_col, salts).where(~F.col("kept")).select(F.col("row_id").alias(ROW))
    return numbered.join(gone, ROW, "left_anti").drop(ROW)
