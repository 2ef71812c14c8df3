"""Ordered numbering that holds when one key owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.session import settled


def _ranged(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows in ranges of (keys, order), with the number of their range: one plan for all sizes.

    A key with many rows lies in several consecutive ranges, so no task gets more than its share. The ranges come from a
    sample, so the rows are written with them and read again.
    """
    return settled(df.repartitionByRange(*keys, *order).withColumn("__range", F.spark_partition_id()))


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """``row_number()`` per key: numbered within each range, which starts where the ranges before it ended."""
    ranged = _ranged(df, keys, order)
    by_range = [*keys, "__range"]
    local = ranged.withColumn("__rn", F.row_number().over(Window.partitionBy(*by_range).orderBy(*order)))
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = _keyed(
        ranged.groupBy(*by_range)
        .agg(F.count(F.lit(1)).alias("__size"))
        .withColumn("__start", F.coalesce(F.sum("__size").over(before), F.lit(0)))
        .drop("__size"),
        keys,
    )
    joined = local.join(starts, _same(local, starts, keys))
    return joined.select(*[local[f"`{c}`"] for c in df.columns], (F.col("__rn") + F.col("__start")).cast("int").alias(name))


def number_runs(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, name: str, blank_breaks: bool = False
) -> DataFrame:
    """1-based run number per key: a new run starts where ``value`` differs from the row before.

    With ``blank_breaks`` an empty or null value never joins the run before it. A range takes over the last value and the
    number of runs of the ranges before it.
    """
    current = F.col(value)

    def joins(first: Column, previous: Column) -> Column:
        same = first.eqNullSafe(previous)
        return same & (F.coalesce(first, F.lit("")) != "") if blank_breaks else same

    ranged = _ranged(df, keys, order)
    by_range = [*keys, "__range"]
    ordered = Window.partitionBy(*by_range).orderBy(*order)
    running = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = F.when(joins(current, F.lag(value).over(ordered)), 0).otherwise(1)
    local = (
        ranged.withColumn("__rn", F.row_number().over(ordered))
        .withColumn("__new", F.when(F.col("__rn") == 1, 0).otherwise(starts))
        .withColumn("__local", F.sum("__new").over(running))
    )
    ends = local.groupBy(*by_range).agg(
        F.min_by(value, "__rn").alias("__first"),
        F.max_by(value, "__rn").alias("__last"),
        F.sum("__new").alias("__inside"),
    )
    ranges = Window.partitionBy(*keys).orderBy("__range")
    border = F.when(F.row_number().over(ranges) == 1, 0).when(joins(F.col("__first"), F.lag("__last").over(ranges)), 0).otherwise(1)
    so_far = ranges.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = ranges.rowsBetween(Window.unboundedPreceding, -1)
    offsets = _keyed(
        ends.withColumn("__border", border)
        .withColumn("__offset", F.sum("__border").over(so_far) + F.coalesce(F.sum("__inside").over(earlier), F.lit(0)))
        .select(*by_range, "__offset"),
        keys,
    )
    joined = local.join(offsets, _same(local, offsets, keys))
    return joined.select(*[local[f"`{c}`"] for c in df.columns], (1 + F.col("__local") + F.col("__offset")).cast("int").alias(name))


def _keyed(small: DataFrame, keys: Sequence[str]) -> DataFrame:
    return small.withColumnsRenamed({k: f"__key_{k}" for k in keys}).withColumnRenamed("__range", "__in_range")


def _same(rows: DataFrame, small: DataFrame, keys: Sequence[str]) -> Column:
    """Equal range and keys; a null key is a key."""
    on = rows["__range"] == small["__in_range"]
    for k in keys:
        on &= rows[f"`{k}`"].eqNullSafe(small[f"`__key_{k}`"])
    return on
