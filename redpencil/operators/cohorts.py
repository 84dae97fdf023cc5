"""Exam-over-exam queries: order, changes and the persistence of issues from the first exam on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from redpencil.functions.exams import Cohort, cohort, position, sort_keys
from redpencil.functions.text import clean
from redpencil.operators.metrics import by_exam


def exam_order(df: DataFrame, chosen: Sequence[str] | None = None) -> DataFrame:
    """Rows (exam_id, exam_rank), ranks from 0: the sorted exams, or the chosen ones in the chosen order."""
    exams = df.select("exam_id").distinct().filter(F.col("exam_id").isNotNull())
    if chosen:
        exams = exams.filter(position(F.col("exam_id"), chosen).isNotNull())
    # The window runs over one row per exam.
    rank = F.row_number().over(W.orderBy(*sort_keys(chosen))) - 1
    return exams.select("exam_id", rank.cast("int").alias("exam_rank")).orderBy("exam_rank")


def exam_changes(df: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """Exam breakdown with the change of total points against the previous exam.

    The relative change is infinite after a zero total and null from zero to zero.
    """
    # The window runs over one row per exam.
    previous = F.lag("total_points_lost").over(W.orderBy(*sort_keys(order)))
    total, before = F.col("total_points_lost"), F.col("_previous")
    growth = (
        F.when(before != 0, total / before - 1).when((before == 0) & (total > 0), F.lit(float("inf")))
    )
    return (
        by_exam(df)
        .withColumn("_previous", previous)
        .withColumns({"delta_vs_prev": total - before, "pct_change_vs_prev": growth})
        .drop("_previous")
        .orderBy(*sort_keys(order))
    )


def exam_change_table(df: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """Exam changes for display: missing changes as 0, rounded."""
    return (
        exam_changes(df, order)
        .withColumns(
            {
                "delta_vs_prev": F.bround(F.coalesce("delta_vs_prev", F.lit(0.0)), 2),
                "pct_change_vs_prev": _round_finite("pct_change_vs_prev", 3),
            }
        )
        .orderBy(*sort_keys(order))
    )


def persistence(df: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """Per rubric item: students with it in the first exam, how many of them had it again, and the rate."""
    return persistence_by(df, "rubric_item", cohort(df, order)).orderBy("rubric_item")


def persistence_by(df: DataFrame, key: str, exams: Cohort) -> DataFrame:
    """Two combinable aggregates: flags per (key, student), then counts per key. Keys without a cohort drop out."""
    flags = (
        df.filter(exams.is_first | exams.is_later)
        .select(key, "student_id", exams.is_first.alias("_first"), exams.is_later.alias("_later"))
        .groupBy(key, "student_id")
        .agg(F.max("_first").alias("_first"), F.max("_later").alias("_later"))
        .filter("_first")
    )
    return flags.groupBy(key).agg(
        F.count("*").alias("cohort_size"),
        F.count_if("_later").alias("repeated"),
        (F.count_if("_later") / F.count("*")).alias("persistence_rate"),
    )


def persistence_by_rate(df: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    return persistence_by(df, "rubric_item", cohort(df, order)).orderBy(F.desc("persistence_rate"), "rubric_item")


def concept_persistence(df: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """Persistence per concept; no rows unless at least two exams of the order occur."""
    return concept_persistence_rows(df, order).orderBy(F.desc("persistence_rate"), "concept")


def concept_persistence_rows(df: DataFrame, order: Sequence[str] | None, only: DataFrame | None = None) -> DataFrame:
    """``only`` restricts the concepts computed; the exam order still comes from all rows."""
    data = df.withColumn("concept", clean(F.col("concept")))
    named = data.filter(F.col("concept") != "")
    exams = cohort(data, order, scope=named)
    rows = named if only is None else named.join(only, "concept", "left_semi")
    return persistence_by(rows if exams.has_two else rows.filter(F.lit(False)), "concept", exams)


def _round_finite(column: str, digits: int) -> Column:
    c = F.col(column)
    return F.when(c.isNull(), 0.0).when(F.abs(c) == float("inf"), c).otherwise(F.bround(c, digits))
