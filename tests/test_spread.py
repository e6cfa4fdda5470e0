"""Tables are dealt over tasks by their rows, however their files are cut."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import base, rule_queries
from catalog.base import spread


def sizes(df):
    return df.groupBy(F.spark_partition_id().alias("p")).count().orderBy("p").collect()


def test_rows_of_one_row_group_are_dealt(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "events.parquet")
    spark.range(2000).coalesce(1).write.parquet(path)
    cut = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        # many splits, of which one has all rows
        assert spark.read.parquet(path).rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
        assert len(sizes(spark.read.parquet(path))) == 1
        dealt = spread(spark.read.parquet(path))
        assert len(sizes(dealt)) == spark.sparkContext.defaultParallelism and dealt.distinct().count() == 2000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", cut)
    monkeypatch.setattr(base, "ROWS_PER_TASK", 100)
    assert spread(spark.read.parquet(path)).rdd.getNumPartitions() == 20


def test_equal_keys_stay_together(spark):
    rows = spark.range(1000).select("id", F.floor(F.col("id") / 4).alias("blk"))
    dealt = spread(rows.repartition(3), "blk").withColumn("p", F.spark_partition_id())
    parts = dealt.groupBy("blk").agg(F.countDistinct("p").alias("n"), F.count("id").alias("rows"))
    assert [tuple(r) for r in parts.select("n", "rows").distinct().collect()] == [(1, 4)]


def test_rules_of_a_small_file_are_dealt(spark, tmp_path):
    rows = spark.range(500).selectExpr("id AS s_suppkey", "CAST(id % 25 AS INT) AS s_nationkey")
    rows.coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    rules, terms = rule_queries.rule_tables(spark, str(tmp_path))
    assert len(sizes(rules)) == len(sizes(terms)) == spark.sparkContext.defaultParallelism
