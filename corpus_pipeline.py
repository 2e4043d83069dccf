"""From raw documents to training sequences: the stages, each written as Parquet and read again.

The stages rely on that: given computed rows that are not stored, the two that drop duplicates may drop others than meant.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import exact_dedup as exact
from tidewatch.llm import language, packing, queries, simhash
from tidewatch.sources.tables import pin

#: Pooled probability below which no language is taken as known.
LEAST_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the byte network can tell stay: those without a letter go, and those with a score below LEAST_SCORE.

    The network learns from the stage's own input, from rows that the operator does not hold out. Where nothing is labelled, nothing
    can be learned, and only documents without a letter go.
    """
    learned = language.fit(docs.where(~language.held_out(F.col("doc_id"))))
    if learned is None:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    found = language.identify(docs.withColumn("__doc", F.struct(*docs.columns)).select("__doc", "text"), learned)
    return found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("__doc.*")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays, the one with the largest doc_id."""
    return exact.exact_dedup(docs, stored=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints stays, the one with the smallest doc_id."""
    return simhash.near_dedup(docs, words=3, errors=3, stored=True)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that tokens come in the target shares by source, language and form.

    Documents of a source or language without a target, or null, take part: together they keep their share of the tokens.
    """
    return queries.mixed(docs, keep_unlisted=True).where("kept").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, placed in sequences of 2048."""
    found = packing.pack_documents(docs.select("doc_id", "text"), queries.tokenizer_path(), capacity=2048, end_id=0)
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("pack", pack)]
#: Language scores and fingerprints are beyond SQL: the tests hold the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`; each stage's rows are written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = pin(docs)
    return docs
