"""Queries on rows that the given tables are too small for."""

from pyspark.sql import functions as F

from skyfold.plans.queries import group_count


def test_group_count_beyond_smallint(spark, rows):
    parts = spark.range(32_769).select(F.when(F.col("id") > 0, "big").alias("p_brand"))
    assert rows(group_count(lambda name: {"part": parts}[name])) == [("big", 32_768), (None, 1)]
