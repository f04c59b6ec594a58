"""Choosing, flagging and numbering rows within groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unique_flag(keys: list[str]) -> Column:
    """Whether a row's key occurs once; every copy of a repeated key is flagged false."""
    return F.count("*").over(Window.partitionBy(*keys)) == 1


def with_unique_flag(df: DataFrame, key: str, flag: str) -> DataFrame:
    """``df`` with whether a row's key occurs once; false for null keys, however many. Only keys are counted and moved."""
    repeated = df.select(key).dropna().groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key, F.lit(True).alias("_repeated"))
    return df.join(repeated, key, "left").withColumn(flag, F.col(key).isNotNull() & F.col("_repeated").isNull()).drop("_repeated")


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def value_of_first(column: str, keys: list[str], order: list[Column]) -> Column:
    """The column's value in its group's first row, on every row of the group."""
    return F.first(column).over(Window.partitionBy(*keys).orderBy(*order))


def distinct_counts(df: DataFrame, keys: list[str], columns: list[str], flag: str = "values_conflict") -> DataFrame:
    """Per key the number of different non-null values of each column, and whether any has more than one."""
    counts = df.groupBy(*keys).agg(*[F.count_distinct(c).alias(f"{c}_value_count") for c in columns])
    return counts.withColumn(flag, reduce(Column.__or__, [F.col(f"{c}_value_count") > 1 for c in columns]))


def non_null_count(columns: list[str]) -> Column:
    """How many of the columns have a value."""
    return reduce(Column.__add__, [F.col(c).isNotNull().cast("int") for c in columns]).cast("byte")


def numbered_batches(df: DataFrame, key: str, size: int) -> DataFrame:
    """(key, batch_number) of the distinct non-null keys in order, ``size`` to a batch, counted from 1.

    Ranks come from a range sort: a count per range, and row numbers within it, so no task numbers all keys.
    """
    if size <= 0:
        raise ValueError("batch size must be positive")
    keys = df.select(key).dropna().distinct().repartitionByRange(key)
    placed = keys.sortWithinPartitions(key).withColumn("_part", F.spark_partition_id())
    from skyfold.session import materialize

    placed = materialize(placed)  # the ranges must not be drawn anew
    starts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = starts.select("_part", before.alias("_before"))
    here = F.row_number().over(Window.partitionBy("_part").orderBy(key))
    return placed.withColumn("_here", here).join(F.broadcast(starts), "_part").select(key, (F.floor((F.col("_before") + F.col("_here") - 1) / size) + 1).cast("int").alias("batch_number"))
