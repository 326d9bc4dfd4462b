"""A key that half of the rows have is no task's alone."""

from __future__ import annotations

from pyspark.sql import functions as F

from longleaf.llm import common

SETTINGS = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.shuffle.partitions": "16", "spark.sql.files.maxPartitionBytes": "64k", "spark.sql.files.openCostInBytes": "64k"}


def test_the_rows_of_a_hot_key_are_split(spark):
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        tables = common.Tables(spark)
        key = F.when(F.col("id") % 2 == 0, F.lit(0)).otherwise(F.pmod(F.xxhash64("id"), F.lit(5000)))
        rows = tables.write(spark.range(0, 400_000, 1, 32).select(key.alias("key"), "id", F.sha2(F.col("id").cast("string"), 256).alias("said")), "rows")
        found = rows.groupBy("key").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
        most = lambda joined: tables.write(joined.withColumn("task", F.spark_partition_id()), "joined").groupBy("task").count().agg(F.max("count"), F.sum("count")).head()
        split, whole = most(common.met(rows, found, "key", tables, "found"))
        assert whole == 400_000 and split <= 80_000
        assert most(rows.join(found.hint("merge"), "key"))[0] >= 200_000  # where the aggregate is part of the join's stage
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
