import pyarrow as pa
from pyspark.sql import functions as F

from tessera.llm import common


def test_stored_and_release(spark):
    common.release(spark)
    kept = common.stored(spark.range(10), "some")
    assert kept.count() == 10
    assert common.release(spark) == 1 and common.release(spark) == 0


def test_without(spark):
    rows = [(i, "x", i) for i in range(500)] + [(None, "y", 1), (7, "again", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, row string, id int")
    kept = common.without(docs, "doc_id", common.stored(spark.range(0, 500, 7).select("id"), "ids"))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [i for i in range(500) if i % 7]
    assert kept.filter("doc_id IS NULL").count() == 1
    assert common.without(docs, "doc_id", common.stored(spark.range(0), "ids")).count() == len(rows)


def test_join_groups_spares_hot_keys(spark):
    rows = common.stored(spark.range(5000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("k"), "id"), "rows")
    groups = common.stored(rows.groupBy("k").agg(F.count("*").alias("n")), "groups")
    joined = common.join_groups(rows, groups, "k", "n", 5000)
    assert joined.count() == 5000 and joined.filter("k = 0 AND n = 2500").count() == 2500


def test_small_batches_keep_all_rows():
    batch = pa.RecordBatch.from_pydict({"t": ["x" * 1000] * 100 + ["y"]})
    parts = list(common.small_batches([batch], max_bytes=5000))
    assert sum(p.num_rows for p in parts) == 101 and len(parts) > 10
    assert list(common.small_batches([batch.slice(0, 0)])) == []


def test_small_files_are_dealt_out(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "t"))
    some = spark.read.parquet(str(tmp_path / "t"))
    assert common.spread(some).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and common.spread(some).count() == 1000
    assert common.spread(some.limit(0)).count() == 0
