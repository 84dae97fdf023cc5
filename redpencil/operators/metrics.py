"""Group-by summaries of canonical deductions. All of them combine on the map side before any shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redpencil.functions.exams import sort_keys
from redpencil.functions.text import is_blank, strip
from redpencil.operators.shared import ROWS_PER_FILE, dealt, materialize, medians, null_safe_join
from redpencil.schemas import empty


def overall_summary(df: DataFrame) -> DataFrame:
    """One row: rows, students, exams, questions, avg_points_lost."""
    return df.agg(*_overall())


def rubric_item_stats(df: DataFrame) -> DataFrame:
    """Count, mean, exact median, population deviation and total per (rubric_item, topic).

    The facts are read once, into counts per distinct deduction size. Everything else, the median included,
    is derived from those counts, so an item with a third of all rows costs no more than the others.
    """
    keys = ["rubric_item", "topic"]
    blank = F.lit("")  # null and blank are one key
    df = df.withColumns({k: F.coalesce(k, blank) for k in keys})
    counts = materialize(df.groupBy(*keys, "points_lost").agg(F.count("*").alias("n")))
    stats = value_stats(counts, keys, "points_lost")
    return stats.select(
        *keys,
        F.col("rows").alias("count"),
        F.col("mean").alias("avg_points_lost"),
        F.col("median").alias("median_points_lost"),
        F.col("std").alias("std_points_lost"),
        F.col("total").alias("total_points_lost"),
    ).orderBy("topic", "rubric_item")


def value_stats(counts: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """rows, known, total, mean, std, median per key from (keys, value, n) rows; null values only count as rows."""
    known = F.when(F.col(value).isNotNull(), F.col("n"))
    base = counts.groupBy(*keys).agg(
        F.sum("n").alias("rows"),
        F.coalesce(F.sum(known), F.lit(0)).alias("known"),
        F.coalesce(F.sum(F.col(value) * F.col("n")), F.lit(0.0)).alias("total"),
    )
    base = base.withColumn("mean", F.when(F.col("known") > 0, F.col("total") / F.col("known")))
    spread = _spread(counts, base, keys, value)
    with_spread = null_safe_join(base, spread, keys)
    return null_safe_join(with_spread, medians(counts, keys, value, "n", "median"), keys, "left")


def exam_breakdown(df: DataFrame) -> DataFrame:
    return by_exam(df).orderBy("exam_id")


def student_summary(df: DataFrame, exam_order: Sequence[str] | None = None) -> DataFrame:
    """Total points and distinct questions per (student, exam), largest total first, by exam when ordered."""
    out = df.groupBy("student_id", "exam_id").agg(
        F.sum("points_lost").alias("total_points_lost"), F.count_distinct("question_id").alias("questions")
    )
    lead = sort_keys(exam_order) if exam_order else []
    return out.orderBy(*lead, F.col("total_points_lost").desc(), "student_id", "exam_id")


def score_distribution(df: DataFrame, bins: int = 10, value: str = "points_lost") -> DataFrame:
    """Equal-width histogram; bins are closed on the left, empty bins are kept."""
    lo, hi = F.col("bin_lo"), F.col("bin_hi")
    label = F.concat(F.format_string("%.1f", F.bround(lo, 1)), F.lit("-"), F.format_string("%.1f", F.bround(hi, 1)))
    return histogram(df, F.col(value), bins, label)


def histogram(df: DataFrame, value: Column, bins: int, label: Column) -> DataFrame:
    """Rows (bin_index, bin, bin_lo, bin_hi, count).

    Edges are ``lo + i * step``; the last one is raised by 0.1 % of the range so that it takes in the
    maximum. A range of zero width is first widened by 0.1 % of its value on both sides.
    """
    values = df.select(value.alias("_v")).filter(F.col("_v").isNotNull())
    low, high = values.agg(F.min("_v"), F.max("_v")).first()
    bin_ddl = "bin_index int, bin_lo double, bin_hi double"
    if low is None:
        edges = []
    else:
        pad = 0.0 if low != high else abs(low) * 0.001 or 0.001
        lo, hi = low - pad, high + pad
        step = (hi - lo) / bins
        edges = [lo + i * step for i in range(bins)] + [hi if low == high else hi + (hi - lo) * 0.001]
    grid = df.sparkSession.createDataFrame([(i, *e) for i, e in enumerate(zip(edges, edges[1:]))], bin_ddl)
    if not edges:
        return grid.select("bin_index", label.alias("bin"), "bin_lo", "bin_hi", F.lit(0).cast("bigint").alias("count"))

    # A first guess by division, then put right against the edges themselves.
    v, g = F.col("_v"), F.col("_g")
    guess = F.least(F.greatest(F.floor((v - lo) / step), F.lit(0)), F.lit(bins - 1))
    index = F.when(v < lo + g * step, g - 1).when((g < bins - 1) & (v >= lo + (g + 1) * step), g + 1).otherwise(g)
    counts = (
        values.withColumn("_g", guess)
        .groupBy(index.cast("int").alias("bin_index"))
        .agg(F.count("*").alias("_n"))
    )
    return (
        grid.join(counts, "bin_index", "left")
        .select("bin_index", label.alias("bin"), "bin_lo", "bin_hi", F.coalesce("_n", F.lit(0)).alias("count"))
        .orderBy("bin_index")
    )


def summarize_errors(df: DataFrame) -> DataFrame:
    """Rows, students, total and mean per rubric item, by item name."""
    return errors_by_item(df).orderBy("rubric_item")


def errors_by_item(df: DataFrame) -> DataFrame:
    """Rows, students, total and mean per rubric item.

    Nearly every (item, student) is distinct, so that combining them before a shuffle saves little and holds a large table
    next to the joins of ``df``. The three columns used are stored and dealt over tasks of few rows instead.
    """
    lines = dealt(materialize(df.select("rubric_item", "student_id", "points_lost"), ROWS_PER_FILE), ["rubric_item", "student_id"])
    return lines.groupBy("rubric_item").agg(
        F.count("*").alias("count_rows"),
        F.count_distinct("student_id").alias("students_affected"),
        F.sum("points_lost").alias("points_lost_total"),
        F.avg("points_lost").alias("points_lost_mean"),
    )


def errors_by_count(df: DataFrame) -> DataFrame:
    return errors_by_item(df).orderBy(F.desc("count_rows"), "rubric_item")


def errors_by_points(df: DataFrame) -> DataFrame:
    return errors_by_item(df).orderBy(F.desc("points_lost_total"), "rubric_item")


def error_by_exam(df: DataFrame) -> DataFrame:
    return (
        df.groupBy("exam_id", "rubric_item")
        .agg(F.count("*").alias("count_rows"), F.sum("points_lost").alias("points_lost_total"))
        .orderBy("exam_id", "rubric_item")
    )


def rubric_exam_pivot(df: DataFrame, exams: Sequence[str] | None = None) -> DataFrame:
    """Row counts, one line per rubric item and one column per exam, 0 where an item did not occur.

    Exams become columns, so Spark's own limit on pivot columns applies when they are not given.
    """
    grouped = df.groupBy("rubric_item").pivot("exam_id", list(exams) if exams else None)
    return grouped.agg(F.count(F.lit(1))).na.fill(0).orderBy("rubric_item")


def rubric_exam_map(df: DataFrame) -> DataFrame:
    """Row counts per rubric item as a map from exam to count, exams in order, for any number of exams.

    Unlike the pivot, nothing about the exams is collected and an exam costs nothing for items that do not occur in it.
    A null exam is the blank one, as a map has no null keys.
    """
    exam = F.coalesce("exam_id", F.lit("")).alias("exam_id")
    counts = df.groupBy("rubric_item", exam).agg(F.count("*").alias("rows"))
    entries = F.sort_array(F.collect_list(F.struct("exam_id", "rows")))
    return counts.groupBy("rubric_item").agg(F.map_from_entries(entries).alias("rows_by_exam")).orderBy("rubric_item")


def group_comparison(df: DataFrame, group_col: str, missing_label: str = "Unassigned") -> DataFrame:
    """Compare the groups of any column. No rows when the column is absent or blank throughout."""
    ddl = (
        f"`{group_col}` string, rows bigint, students bigint, total_points_lost double, "
        "avg_points_per_student double, avg_points_per_row double"
    )
    if group_col not in df.columns:
        return empty(df.sparkSession, ddl)
    named = ~is_blank(F.col(group_col))
    if df.filter(named).isEmpty():
        return empty(df.sparkSession, ddl)
    return (
        df.withColumn(group_col, F.when(named, strip(F.col(group_col).cast("string"))).otherwise(missing_label))
        .groupBy(group_col)
        .agg(
            F.count("*").alias("rows"),
            F.count_distinct("student_id").alias("students"),
            F.sum("points_lost").alias("total_points_lost"),
            (F.sum("points_lost") / F.count_distinct("student_id")).alias("avg_points_per_student"),
            F.avg("points_lost").alias("avg_points_per_row"),
        )
        .orderBy(F.desc("avg_points_per_student"), group_col)
    )


def course_group_stats(df: DataFrame, group_col: str, label: str) -> DataFrame:
    """Group comparison with money-style rounding, for display."""
    stats = group_comparison(df, group_col, f"Unassigned {label}")
    return stats.withColumns(
        {c: F.bround(c, 2) for c in ("total_points_lost", "avg_points_per_student", "avg_points_per_row")}
    ).orderBy(F.desc("avg_points_per_student"), group_col)


def disparity_gap(df: DataFrame, group_col: str, label: str) -> DataFrame:
    stats = course_group_stats(df, group_col, label)
    return stats.agg((F.max("avg_points_per_student") - F.min("avg_points_per_student")).alias("gap"))


def kpis(df: DataFrame, rubric_item: str | None = None) -> DataFrame:
    """Headline figures. Per-student figures, items and total follow the drill-down; the others do not.

    Without a drill-down the sums per student also tell how many students there are, so that the facts are
    only expanded for the columns of few values.
    """
    whole = rubric_item is None
    chosen = F.lit(True) if whole else F.col("rubric_item") == rubric_item
    per_student = df.filter(chosen).groupBy("student_id").agg(F.sum("points_lost").alias("t"))
    spread = per_student.agg(
        F.struct(
            F.count("student_id").alias("students"),
            F.coalesce(F.avg("t"), F.lit(0.0)).alias("avg"),
            F.coalesce(F.stddev_pop("t"), F.lit(0.0)).alias("std"),
            F.coalesce(F.sum("t"), F.lit(0.0)).alias("total"),
        ).alias("s")
    )
    # A drill-down leaves one item, if it occurs at all.
    items = F.count_distinct("rubric_item") if whole else F.coalesce(F.max(chosen.cast("bigint")), F.lit(0).cast("bigint"))
    figures = [
        F.count("*").alias("rows"),
        F.count_distinct("exam_id").alias("exams"),
        F.avg("points_lost").alias("avg_points_lost"),
        items.alias("rubric_items"),
    ]
    if not whole:
        figures.append(F.count_distinct("student_id").alias("students"))
    return (
        df.agg(*figures)
        .withColumn("_s", spread.scalar())
        .select(
            "rows",
            F.col("_s.students").alias("students") if whole else "students",
            F.col("_s.avg").alias("avg_points_per_student"),
            F.col("_s.std").alias("std_points_per_student"),
            "exams",
            "rubric_items",
            "avg_points_lost",
            F.col("_s.total").alias("total_points_lost"),
        )
    )


def _overall() -> list[Column]:
    return [
        F.count("*").alias("rows"),
        F.count_distinct("student_id").alias("students"),
        F.count_distinct("exam_id").alias("exams"),
        F.count_distinct("question_id").alias("questions"),
        F.avg("points_lost").alias("avg_points_lost"),
    ]


def by_exam(df: DataFrame) -> DataFrame:
    return df.groupBy("exam_id").agg(
        F.count_distinct("student_id").alias("students"),
        F.count_distinct("question_id").alias("questions"),
        F.sum("points_lost").alias("total_points_lost"),
        F.avg("points_lost").alias("avg_points_lost"),
    )


def _spread(counts: DataFrame, base: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Population deviation around the group mean."""
    apart = F.col("n") * F.pow(F.col(value) - F.col("mean"), F.lit(2))
    return (
        null_safe_join(counts, base.select(*keys, "mean", "known"), keys)
        .groupBy(*keys)
        .agg(F.sqrt(F.sum(apart) / F.nullif(F.max("known"), F.lit(0))).alias("std"))
    )
