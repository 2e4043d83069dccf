import pytest
from pyspark.sql import functions as F

from tidewatch.sources import messages as ms, sinks, tables as t


class Conf:
    def __init__(self, **kv):
        self.kv = {k.replace("_", "."): v for k, v in kv.items()}

    def get(self, key, default=None):
        return self.kv.get(key, default)


class Session:
    def __init__(self, **kv):
        self.conf = Conf(**kv)


def test_shared_folder_comes_from_the_session():
    assert t.shared_dir(Session(spark_checkpoint_dir="hdfs://x/ck/")).startswith("hdfs://x/ck/tidewatch-")
    with pytest.raises(ValueError):
        t.shared_dir(Session(spark_master="yarn"))


def test_pinned_table_is_read_back(spark):
    df = spark.range(5).withColumn("s", F.array(F.lit("a")))
    p = t.pin(df)
    assert p.dtypes == df.dtypes and sorted(r.id for r in p.collect()) == list(range(5))
    assert "Range" not in p._jdf.queryExecution().executedPlan().toString()


def test_ids_do_not_change_on_a_second_run(spark):
    df = spark.range(20).withColumn("v", F.col("id") * 2)
    ids = lambda d: sorted(r.k for r in d.select(sinks.content_id("id", "v").alias("k")).collect())
    assert ids(df) == ids(df.repartition(3)) and len(set(ids(df))) == 20


def test_missing_values_leave_the_message(spark):
    df = spark.createDataFrame([(1, 2.5, None)], "step LONG, a DOUBLE, b DOUBLE").withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    m = ms.encode(df, "ts", F.lit("s"), "step", {"a": F.col("a").cast("string"), "b": F.col("b").cast("string")})
    r = ms.feature_columns(ms.decode(m), ["a", "b"]).first()
    assert (r.a, r.b, r.step, r.corrupt) == (2.5, None, 1, False) and set(r.features) == {"a"}


def test_inventory_flags_bad_cells(spark):
    df = spark.createDataFrame([(1.0, "x"), (1.0, "x"), (float("nan"), None), (float("inf"), "y")], "v DOUBLE, s STRING")
    r = t.inventory(df, "d").first()
    assert (r.rows, r["columns"], r.missing, r.nan_values, r.infinite, r.duplicates, r.status) == (4, 2, 1, 1, 1, 1, "REVIEW")


def test_partitioned_write_spreads_a_hot_partition(spark, tmp_path):
    df = spark.range(2000).select(F.when(F.col("id") % 10 < 9, "hot").otherwise("cold").alias("p"), "id")
    # the size a writer shall have, made small: a hot value is then many writers' work
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "2k")
    sinks.write_partitioned(df, str(tmp_path / "out"), ["p"])
    spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(list((tmp_path / "out" / "p=hot").glob("*.parquet"))) > 1
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2000


def test_latest_rows_go_on_after_a_restart(spark, tmp_path):
    from tidewatch.streaming.scoring import LatestRows

    make = lambda rows: spark.createDataFrame(rows, "user LONG, ts LONG, v STRING")
    keep = lambda: LatestRows(str(tmp_path / "latest"), ["user"], ["ts"])
    keep().handle(make([(1, 1, "a"), (2, 1, "b")]), 0)
    keep().handle(make([(1, 2, "c")]), 1)
    keep().handle(make([(1, 2, "c")]), 1)  # the batch is repeated
    want = [(1, 2, "c"), (2, 1, "b")]
    assert sorted(tuple(r) for r in keep().read(spark, make([]).schema).collect()) == want
    (tmp_path / "latest" / "snapshot_2").mkdir()  # a batch that ended before its snapshot was whole
    assert sorted(tuple(r) for r in keep().read(spark, make([]).schema).collect()) == want
    keep().handle(make([(3, 1, "d")]), 2)
    assert sorted(tuple(r) for r in keep().read(spark, make([]).schema).collect()) == [*want, (3, 1, "d")]


def test_latest_rows_rewrite_touched_buckets_only(spark, tmp_path):
    from tidewatch.operators.topk import latest_per_key
    from tidewatch.streaming.scoring import BUCKET, LatestRows

    path = tmp_path / "latest"
    keep = lambda: LatestRows(str(path), ["user"], ["ts"], buckets=8)
    rows = spark.range(200).selectExpr("id % 40 AS user", "id AS ts", "CAST(NULL AS STRING) AS v")
    parts = [rows, rows.filter("user = 3").withColumn("ts", F.col("ts") + 1000), rows.filter("user IN (3, 4)").withColumn("ts", F.col("ts") + 2000), rows.limit(0)]
    seen = rows.limit(0)
    written = []
    for i, part in enumerate(parts):
        keep().handle(part, i)
        seen = seen.unionByName(part)
        written.append(len(list((path / "rows" / str(i)).glob(f"{BUCKET}=*"))))
        want = sorted(tuple(r) for r in latest_per_key(seen, ["user"], ["ts"]).collect())
        assert sorted(tuple(r) for r in keep().read(spark, rows.schema).collect()) == want
    assert written[0] == 8 and written[1] == 1 and written[2] <= 2 and written[3] == 0
    # a batch that ended before its commit was whole: its rows count for nothing, and it runs again
    (path / "commits" / "4").mkdir()
    parts[0].withColumn(BUCKET, F.lit(0)).write.partitionBy(BUCKET).parquet(str(path / "rows" / "4"))
    assert sorted(tuple(r) for r in keep().read(spark, rows.schema).collect()) == want
    for _ in range(2):
        keep().handle(rows.withColumn("ts", F.col("ts") + 5000), 4)
        assert {r.ts for r in keep().read(spark, rows.schema).collect()} == set(range(5160, 5200))
    # the last two commits and what they name are left
    keep().handle(rows.withColumn("ts", F.col("ts") + 6000), 5)
    assert sorted(p.name for p in (path / "commits").iterdir() if p.is_dir()) == ["4", "5"]
    assert sorted(p.name for p in (path / "rows").iterdir() if p.is_dir()) == ["4", "5"]


def test_a_batch_appended_twice_is_there_once(spark, tmp_path):
    for batch in (0, 1, 1):
        sinks.append(spark.range(3), str(tmp_path / "rows"), batch)
    assert spark.read.parquet(str(tmp_path / "rows")).count() == 6


def test_shared_folders_are_removed(spark):
    import os

    path = t.shared_dir(spark)
    spark.range(2).write.parquet(f"{path}/x")
    local = path.removeprefix("file://")
    held, t._MADE[:] = t._MADE[:-1], t._MADE[-1:]
    assert os.path.exists(local)
    t.remove_shared_dirs()
    t._MADE[:] = held
    assert not os.path.exists(local)
