"""Building blocks used by several operators: durable materialisation and distributed running totals."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Size bound: rows that one task groups, whatever the size of the whole.
ROWS_PER_TASK = 500_000
# Rows of a file of a table that is dealt. A reading task takes few small files, as Spark counts 4 MB for opening each.
ROWS_PER_FILE = 100_000


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new place in the folder all executors see: ``spark.checkpoint.dir``, or the warehouse where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/redpencil/{uuid.uuid4().hex}/{name}"


def materialize(df: DataFrame, rows_per_file: int = 0) -> DataFrame:
    """Compute once into a parquet table, which survives lost executors, is read by column, and has a known size."""
    path = scratch_path(df.sparkSession, "table")
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(stored: DataFrame, by: Sequence[str]) -> DataFrame:
    """A stored table, of files of ``ROWS_PER_FILE`` rows, dealt by key over as many tasks as its rows need.

    What a task holds while it groups by these keys does not grow with the table, nor with the size of Spark's partitions.
    Counting a stored table reads the footers of its files.
    """
    return stored.repartition(max(1, -(-stored.count() // ROWS_PER_TASK)), *by)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys match each other; the columns of ``left``, then the others of ``right``."""
    named = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = [left[k].eqNullSafe(named[f"_right_{k}"]) for k in keys]
    return left.join(named, same, how).drop(*[f"_right_{k}" for k in keys])


def running_totals(
    df: DataFrame, order: Sequence[str], value: Column, groups: Sequence[str] = (), name: str = "running"
) -> DataFrame:
    """Inclusive running total of ``value`` within each group, without gathering a group in one task.

    Rows are range-partitioned by (groups, order) and totalled inside each range; the totals of the earlier
    ranges are then added. A group may span any number of ranges. The ranges are materialised first, as
    both passes must see the same ones. (groups, order) must identify a row.
    """
    groups = list(groups)
    keys = [*groups, *order]
    ranged = materialize(
        df.withColumn("_value", value).repartitionByRange(*keys).withColumn("_range", F.spark_partition_id())
    )
    inside = W.partitionBy("_range", *groups).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    # One row per range a group touches, so these windows are bounded by the partition count.
    before = W.partitionBy(*(groups or [F.lit(0)])).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("_range", *groups)
        .agg(F.sum("_value").alias("_total"))
        .select("_range", *groups, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        ranged.withColumn("_inside", F.sum("_value").over(inside))
        .transform(lambda totals: null_safe_join(totals, offsets, ["_range", *groups]))
        .withColumn(name, F.col("_inside") + F.col("_offset"))
        .drop("_range", "_value", "_inside", "_offset")
    )


def ordinals(df: DataFrame, key: str, name: str) -> DataFrame:
    """Number the rows 1, 2, … by a distinct key, without a one-task window."""
    return running_totals(df, [key], F.lit(1).cast("bigint"), name=name)


def medians(counts: DataFrame, groups: Sequence[str], value: str, weight: str, name: str) -> DataFrame:
    """Exact median per group from (groups, value, weight) rows, one per distinct value."""
    groups = list(groups)
    known = counts.filter(F.col(value).isNotNull())
    ranked = running_totals(known, [value], F.col(weight), groups, "_upto")
    totals = known.groupBy(*groups).agg(F.sum(weight).alias("_n"))
    low = F.expr("(_n + 1) div 2")
    high = F.expr("_n div 2 + 1")
    return (
        null_safe_join(ranked, totals, groups)
        .groupBy(*groups)
        .agg(
            (
                (
                    F.min(F.when(F.col("_upto") >= low, F.col(value)))
                    + F.min(F.when(F.col("_upto") >= high, F.col(value)))
                )
                / 2
            ).alias(name)
        )
    )
