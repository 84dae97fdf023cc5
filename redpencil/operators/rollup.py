"""One base of counts and student sets that several summaries roll up from, without another pass over the facts.

A student set is exact and can be united: students are numbered densely, and a cell, one combination of the keys, holds
its students by bucket of 32,768 numbers. A bucket with at least ``DENSE`` students is a bitmap of 4 KB; the others stay
rows (bucket, position). Cells are numbered too, so that these rows are three numbers whatever the keys are. So a base is
never much larger than the distinct (keys, student) pairs, however many cells hold a single student. A coarser key unites bitmaps by ``bitmap_or_agg``; rows count where the united bitmap has no such bit.
Null students are in no set, but their rows and points count. A null key is a group of its own.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redpencil.functions.text import clean, is_blank, strip
from redpencil.operators.shared import ROWS_PER_FILE, dealt, materialize, null_safe_join, ordinals, running_totals
from redpencil.schemas import empty

# From 512 students on, a bitmap of 4,096 bytes is smaller than as many numbers of 8 bytes.
DENSE = 512
_POSITION = ["_bucket", "_position"]


class Rollup(NamedTuple):
    """Stored tables: (keys, question_id, rows, known, points), (student_id, points), (keys, cell), and the two forms of student sets by cell."""

    keys: list[str]
    totals: DataFrame
    per_student: DataFrame
    cells: DataFrame
    dense: DataFrame
    sparse: DataFrame


def roll_up(df: DataFrame, keys: Sequence[str] = ("exam_id", "rubric_item"), dense_from: int = DENSE) -> Rollup:
    """The base of ``df`` for any subset of ``keys``. The facts are read once; everything else follows from their counts."""
    keys = list(keys)
    by = [*keys, "question_id", "student_id"]
    # Nearly all of these are distinct, so that combining them before a shuffle saves little and takes much memory.
    lines = materialize(df.select(*by, "points_lost"), ROWS_PER_FILE)
    counts = materialize(
        dealt(lines, by).groupBy(*by).agg(
            F.count("*").alias("rows"), F.count("points_lost").alias("known"), F.sum("points_lost").alias("points")
        ),
        ROWS_PER_FILE,
    )
    totals = materialize(counts.groupBy(*keys, "question_id").agg(*(F.sum(c).alias(c) for c in ("rows", "known", "points"))))
    per_student = materialize(counts.groupBy("student_id").agg(F.sum("points").alias("points")))

    cells = materialize(_cells(totals, keys))
    numbers = ordinals(per_student.select("student_id").filter("student_id IS NOT NULL"), "student_id", "_number")
    known = dealt(counts, ["student_id"]).filter("student_id IS NOT NULL")
    seen = (null_safe_join(known, cells, keys) if keys else known.withColumn("_cell", F.lit(1).cast("bigint"))).select("student_id", "_cell").distinct()
    members = materialize(
        seen.join(numbers, "student_id").select(
            "_cell",
            F.bitmap_bucket_number("_number").alias("_bucket"),
            F.bitmap_bit_position("_number").alias("_position"),
        )
    )
    cell = ["_cell", "_bucket"]
    large = materialize(members.groupBy(*cell).agg(F.count("*").alias("_n")).filter(F.col("_n") >= dense_from).select(*cell))
    dense = members.join(large, cell, "left_semi").groupBy(*cell).agg(F.bitmap_construct_agg("_position").alias("_bits"))
    sparse = members.join(large, cell, "left_anti")
    return Rollup(keys, totals, per_student, cells, materialize(dense), materialize(sparse))


def students(base: Rollup, by: Sequence[str] = ()) -> DataFrame:
    """Distinct students per ``by``; without keys one row."""
    by = list(by)
    dense, sparse = (t.join(base.cells.select("_cell", *by), "_cell") if by else t for t in (base.dense, base.sparse))
    united = dense.groupBy(*by, "_bucket").agg(F.bitmap_or_agg("_bits").alias("_bits"))
    alone = null_safe_join(sparse.select(*by, *_POSITION).distinct(), united, [*by, "_bucket"], "left")
    parts = united.select(*by, F.bitmap_count("_bits").alias("_n")).unionByName(
        alone.filter(F.col("_bits").isNull() | ~_is_set(F.col("_bits"), F.col("_position"))).select(
            *by, F.lit(1).cast("bigint").alias("_n")
        )
    )
    return parts.groupBy(*by).agg(F.coalesce(F.sum("_n"), F.lit(0).cast("bigint")).alias("students"))


def figures(base: Rollup, by: Sequence[str]) -> DataFrame:
    """Rows, students, total and mean per ``by``, a subset of the base's keys."""
    by = list(by)
    totals = base.totals.groupBy(*by).agg(F.sum("rows").alias("rows"), F.sum("points").alias("total"), _mean().alias("mean"))
    counted = null_safe_join(totals, students(base, by), by, "left")
    return counted.select(*by, "rows", F.coalesce("students", F.lit(0)).alias("students"), "total", "mean")


def summaries(base: Rollup, parts: Sequence[str]) -> DataFrame:
    """Rows (part, item, rows, students, total, mean): the figures of every key in ``parts``, and of the whole as part ``all``."""
    whole = base.totals.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.sum("points").alias("total"), _mean().alias("mean"))
    lines = whole.select(
        F.lit("all").alias("part"), F.lit("").alias("item"), "rows", students(base).scalar().alias("students"), "total", "mean"
    )
    for part in parts:
        rows = figures(base, [part])
        lines = lines.unionByName(
            rows.select(F.lit(part).alias("part"), F.col(part).cast("string").alias("item"), "rows", "students", "total", "mean")
        )
    return lines


def overall_summary(base: Rollup) -> DataFrame:
    """As ``metrics.overall_summary``."""
    counted = base.totals.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        F.count_distinct("exam_id").alias("exams"),
        F.count_distinct("question_id").alias("questions"),
        _mean().alias("avg_points_lost"),
    )
    return counted.select("rows", students(base).scalar().alias("students"), "exams", "questions", "avg_points_lost")


def exam_breakdown(base: Rollup) -> DataFrame:
    """As ``metrics.exam_breakdown``."""
    questions = base.totals.groupBy("exam_id").agg(F.count_distinct("question_id").alias("questions"))
    return (
        null_safe_join(figures(base, ["exam_id"]), questions, ["exam_id"])
        .select("exam_id", "students", "questions", F.col("total").alias("total_points_lost"), F.col("mean").alias("avg_points_lost"))
        .orderBy("exam_id")
    )


def summarize_errors(base: Rollup) -> DataFrame:
    """As ``metrics.summarize_errors``."""
    return _errors(base, "rubric_item").orderBy("rubric_item")


def concept_stats(base: Rollup) -> DataFrame:
    """As ``recommend.concept_stats``, for a base with ``concept`` among its keys."""
    named = _renamed(base, "concept", clean(F.col("concept")))
    rows = _errors(named, "concept").withColumnRenamed("count_rows", "rows").filter(F.col("concept") != "")
    return rows.orderBy(F.desc("points_lost_total"), "concept")


def group_comparison(base: Rollup, group_col: str, missing_label: str = "Unassigned") -> DataFrame:
    """As ``metrics.group_comparison``, for a base with ``group_col`` among its keys."""
    ddl = (
        f"`{group_col}` string, rows bigint, students bigint, total_points_lost double, "
        "avg_points_per_student double, avg_points_per_row double"
    )
    named = ~is_blank(F.col(group_col))
    if group_col not in base.keys or base.totals.filter(named).isEmpty():
        return empty(base.totals.sparkSession, ddl)
    label = F.when(named, strip(F.col(group_col).cast("string"))).otherwise(missing_label)
    return (
        figures(_renamed(base, group_col, label), [group_col])
        .select(
            group_col,
            "rows",
            "students",
            F.col("total").alias("total_points_lost"),
            (F.col("total") / F.nullif("students", F.lit(0))).alias("avg_points_per_student"),
            F.col("mean").alias("avg_points_per_row"),
        )
        .orderBy(F.desc("avg_points_per_student"), group_col)
    )


def kpis(base: Rollup) -> DataFrame:
    """As ``metrics.kpis`` without a drill-down."""
    zero = F.lit(0.0)
    spread = base.per_student.agg(
        F.struct(
            F.count("student_id").alias("students"),
            F.coalesce(F.avg("points"), zero).alias("avg"),
            F.coalesce(F.stddev_pop("points"), zero).alias("std"),
            F.coalesce(F.sum("points"), zero).alias("total"),
        ).alias("s")
    )
    counted = base.totals.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        F.count_distinct("exam_id").alias("exams"),
        F.count_distinct("rubric_item").alias("rubric_items"),
        _mean().alias("avg_points_lost"),
    )
    return counted.withColumn("_s", spread.scalar()).select(
        "rows",
        F.col("_s.students").alias("students"),
        F.col("_s.avg").alias("avg_points_per_student"),
        F.col("_s.std").alias("std_points_per_student"),
        "exams",
        "rubric_items",
        "avg_points_lost",
        F.col("_s.total").alias("total_points_lost"),
    )


def packet_tables(base: Rollup, group_cols: Sequence[str] = ()) -> dict[str, DataFrame]:
    """The tables of a packet by name, all of them from one base."""
    tables = {"exam_breakdown": exam_breakdown(base), "summarize_errors": summarize_errors(base)}
    if "concept" in base.keys:
        tables["concept_stats"] = concept_stats(base)
    return tables | {f"{c}_comparison": group_comparison(base, c) for c in group_cols}


def _cells(totals: DataFrame, keys: list[str]) -> DataFrame:
    """Every combination of the keys with a number of its own; without keys one."""
    if not keys:
        return totals.sparkSession.range(1, 2).withColumnRenamed("id", "_cell")
    return running_totals(totals.select(*keys).distinct(), keys, F.lit(1).cast("bigint"), name="_cell")


def _errors(base: Rollup, key: str) -> DataFrame:
    return figures(base, [key]).select(
        key,
        F.col("rows").alias("count_rows"),
        F.col("students").alias("students_affected"),
        F.col("total").alias("points_lost_total"),
        F.col("mean").alias("points_lost_mean"),
    )


def _renamed(base: Rollup, key: str, value: Column) -> Rollup:
    """The base with the values of one key replaced; values that fall together are united when rolled up."""
    return base._replace(**{t: getattr(base, t).withColumn(key, value) for t in ("totals", "cells")})


def _mean() -> Column:
    return F.sum("points") / F.nullif(F.sum("known"), F.lit(0))


def _is_set(bits: Column, position: Column) -> Column:
    """Whether a bitmap has the bit at a position: bit ``position % 8`` of byte ``position / 8``."""
    byte = F.conv(F.hex(F.substring(bits, F.floor(position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.floor(byte / F.pow(F.lit(2), position % 8)) % 2 == 1
