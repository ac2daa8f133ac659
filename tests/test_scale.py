"""Steps that many queries share keep their tasks small and run once."""

from pyspark.sql import functions as F

from fieldaudit.plans import reruns, streams
from fieldaudit.sources import tables


def test_one_row_group_is_dealt_out(spark, tmp_path):
    """A file whose rows are all in one row group has many splits, one of which reads everything."""
    spark.range(40_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("t")).coalesce(1).write.parquet(str(tmp_path / "t.parquet"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(100_000))
    try:
        df = spark.read.parquet(str(tmp_path / "t.parquet"))
        assert df.rdd.getNumPartitions() > 8 and max(df.rdd.glom().map(len).collect()) == 40_000
        parts = tables.spread(df, "id").groupBy(F.spark_partition_id()).count().collect()
        assert max(r["count"] for r in parts) < 5_000 and sum(r["count"] for r in parts) == 40_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_metrics_are_stored_for_all_that_compare_them(spark):
    scores = spark.range(200).select((F.col("id") % 2).cast("int").alias("seed"), (F.col("id") % 3 == 0).cast("int").alias("label"), F.sqrt("id").alias("logit"))
    m = reruns.metrics(scores)
    plan = m._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert plan[0].startswith(("InMemoryRelation", "LogicalRDD")) and m.count() == 4


def test_files_of_a_delivery_grow_with_the_rows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(streams, "file_stream", lambda s, path, schema, files_a_batch: seen.append(files_a_batch) or s.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path))
    rows = spark.range(0, 120, 1, 6).select(F.col("id").cast("string").alias("image_id"))
    assert streams.in_two_runs(spark, "t", rows, lambda s: s).count() == 120 and seen == [5, 5]


def test_splits_meet_the_orders_before_cases_are_derived(spark, tmp_path):
    """A join of finished cases exchanges all their columns once the splits are too many to broadcast."""
    spark.sql("select id as o_orderkey, id % 3 as o_custkey, 'F' as o_orderstatus from range(20)").write.parquet(f"{tmp_path}/orders.parquet")
    splits = spark.createDataFrame([(0, "train"), (1, "val")], "person_id long, split string")
    df = tables.derive_cases(spark, str(tmp_path), splits=splits)
    assert {(r.person_id, r.split) for r in df.select("person_id", "split").collect()} == {(0, "train"), (1, "val"), (2, None)}
    lines = df.select("image_id", "print_id", "ocr_name", "split")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    join = next(i for i, x in enumerate(lines) if "Join LeftOuter" in x)
    assert not any("md5" in x for x in lines[join:])
