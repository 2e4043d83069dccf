"""Deduplication of rows that are computed and not stored, and of rows with string ids, against the stored table's results."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import exact_dedup, line_dedup, simhash

SF = "/root/testdata/sf0.01"
SIZE = "spark.sql.adaptive.advisoryPartitionSizeInBytes"


@pytest.fixture
def small_partitions(spark):
    """Adaptive execution then joins partitions otherwise for narrow rows than for wide ones, as it does with large tables."""
    before = spark.conf.get(SIZE)
    spark.conf.set(SIZE, "100k")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "1k")
    yield
    spark.conf.set(SIZE, before)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.minPartitionSize")


def computed(spark, how):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    if how == "group":
        return docs.groupBy("doc_id").agg(F.first("text").alias("text"), F.first("source").alias("source"), F.first("lang").alias("lang"))
    other = docs.select("doc_id", F.reverse("text").alias("back"))
    return docs.drop("n_chars").hint("merge").join(other.hint("merge"), "doc_id")


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


@pytest.mark.parametrize("how", ["group", "join"])
def test_computed_rows(spark, small_partitions, how):
    docs, whole = spark.read.parquet(f"{SF}/documents.parquet"), computed(spark, how)
    folded = exact_dedup.folded(F.col("text"))
    want = ids(docs.groupBy(folded).agg(F.max("doc_id").alias("doc_id")))
    assert ids(exact_dedup.exact_dedup(whole)) == want == ids(exact_dedup.exact_groups(whole).where("kept"))
    assert ids(simhash.near_dedup(whole)) == ids(simhash.near_dedup(docs, stored=True))


def test_lines_of_computed_rows(spark, small_partitions):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 300")
    whole = computed(spark, "group").where("doc_id < 300")
    cleaned = lambda d, **kw: {(r.doc_id, r.text) for r in line_dedup.line_dedup(d, **kw).collect()}
    assert cleaned(whole) == cleaned(docs, stored=True)


def test_string_ids(spark):
    words = "alpha beta gamma delta epsilon"
    rows = [("b", words), ("a", words.upper()), (None, words), ("10", "one two three four five six"), ("9", "one two three four five"), ("x", None), ("x", "")]
    docs = spark.createDataFrame(rows, "doc_id string, text string").coalesce(1)
    groups = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs).collect()}
    assert groups == {("b", "b", 3, True), ("a", "b", 3, False), (None, "b", 3, False), ("10", "10", 1, True), ("9", "9", 1, True), ("x", "x", 2, True), ("x", "x", 2, False)}
    assert sorted(r.doc_id for r in exact_dedup.exact_dedup(docs).collect()) == ["10", "9", "b", "x"]
    lines = {(r.doc_id, r.class_doc_id, r.links, r.removed) for r in line_dedup.similar_lines(docs).collect()}
    assert lines == {(None, None, 0, False), ("a", None, 0, True), ("b", None, 0, True), ("10", "10", 1, False), ("9", "9", 1, True)}
    assert sorted(str(r.doc_id) for r in simhash.near_dedup(docs).collect() if r.text) == ["10", "9", "a"]


def test_lines_of_rows_with_large_numbers(spark):
    """Rows of the last of many partitions are found again: their numbers are near 2 ** 62."""
    settings = line_dedup.Settings()
    at = [(k << 33) + 7 for k in (0, 1, 2000, 1 << 28)]
    cols = spark.createDataFrame([(x,) for x in at], "row_id long").select(line_dedup._place(F.col("row_id"), F.lit(3), settings).alias("p")).collect()
    assert [r.p for r in cols] == line_dedup._place(np.array(at, np.uint64), np.uint64(3), settings).tolist()
