"""Concept statistics, recommendations, ranked excerpts and report lines.

Every ranking breaks ties by its key, ascending, and ends in ``orderBy(...).limit(n)``.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from redpencil.functions.exams import cohort
from redpencil.functions.text import clean, one_decimal, percent
from redpencil.operators.cohorts import concept_persistence_rows, persistence_by
from redpencil.operators.metrics import errors_by_item
from redpencil.operators.shared import materialize
from redpencil.schemas import UNMAPPED, empty

# The persistence rate from which a concept is taught again, and the two actions.
RETEACH_RATE = 0.2
RETEACH = "Re-teach"
PRACTICE = "Add practice for"

# The lesson-plan sentences, in output order.
PLAN_CONCEPT = "Prioritize reteaching **%s**; it has the highest impact score (%s)."
PLAN_PERSISTENT = "Address recurring concept **%s**; repeat rate %s across %d students."
PLAN_PRACTICE = "Add 10-minute targeted practice on top two concepts, then quick formative check."
PLAN_EXEMPLARS = "Share anonymized exemplars for the highest-impact misconception to speed feedback loops."

# The report line formats.
ISSUE_LINE = "- %s | rows %d | students %d | pts %s"
PERSISTENCE_LINE = "- %s: cohort %d, repeated %d, rate %s"
RECOMMENDATION_LINE = "- %s %s (impact %s, students %d, pts %s)"
NO_ISSUES = "No rubric issues available."
NO_PERSISTENCE = "Not enough exams to compute persistence."
NO_RECOMMENDATIONS = "No recommendations available."


def concept_stats(df: DataFrame) -> DataFrame:
    """Rows, students, total and mean per concept, largest total first."""
    return _concept_rows(df).orderBy(F.desc("points_lost_total"), "concept")


def impact_score() -> Column:
    return F.col("points_lost_total") * F.greatest(F.col("students_affected"), F.lit(1))


def recommendations(
    df: DataFrame,
    order: Sequence[str] | None = None,
    allowed: Iterable[str] | None = None,
    top_n: int = 5,
    include_unmapped: bool = False,
    unmapped: str = UNMAPPED,
) -> DataFrame:
    """The concepts with the highest impact, each with an action chosen by its persistence rate.

    The ranking is cut to ``top_n`` first, and persistence is computed for those concepts alone. A concept
    without a first-exam cohort has rate 0.
    """
    data = df if include_unmapped else df.filter(clean(F.col("concept")) != unmapped)
    ranked = _concept_rows(data)
    if allowed is not None:
        ranked = ranked.filter(F.col("concept").isin([a.strip() for a in allowed if str(a).strip()]))
    # Used twice below, and no larger than top_n.
    top = materialize(
        ranked.withColumn("impact_score", impact_score()).orderBy(F.desc("impact_score"), "concept").limit(top_n)
    )
    names = top.select("concept")
    rates = concept_persistence_rows(data, order, names)
    rate = F.coalesce("persistence_rate", F.lit(0.0))
    return (
        top.join(rates.select("concept", "persistence_rate"), "concept", "left")
        .select(
            "concept",
            F.when(rate >= RETEACH_RATE, RETEACH).otherwise(PRACTICE).alias("action"),
            "impact_score",
            F.col("students_affected").alias("students"),
            "points_lost_total",
            rate.alias("persistence_rate"),
        )
        .orderBy(F.desc("impact_score"), "concept")
    )


def top_issues(df: DataFrame, n: int = 20) -> DataFrame:
    return errors_by_item(df).orderBy(F.desc("points_lost_total"), "rubric_item").limit(n)


def top_rubric_items(df: DataFrame, n: int = 10) -> DataFrame:
    return top_issues(df, n)


def high_points(df: DataFrame, n: int = 3) -> DataFrame:
    return top_issues(df, n)


def high_persistence(df: DataFrame, order: Sequence[str] | None = None, n: int = 3, min_cohort: int = 3) -> DataFrame:
    rates = persistence_by(df, "rubric_item", cohort(df, order))
    return rates.filter(F.col("cohort_size") >= min_cohort).orderBy(F.desc("persistence_rate"), "rubric_item").limit(n)


def suggested_topics(df: DataFrame, n: int = 3) -> DataFrame:
    """Concepts, or topics where there is no concept column, by points lost."""
    source = next((c for c in ("concept", "topic") if c in df.columns), None)
    if source is None:
        return empty(df.sparkSession, "concept string, points_lost double")
    named = df.select(clean(F.col(source)).alias("concept"), "points_lost").filter(F.col("concept") != "")
    totals = named.groupBy("concept").agg(F.sum("points_lost").alias("points_lost"))
    return totals.orderBy(F.desc("points_lost"), "concept").limit(n)


def top_concepts(df: DataFrame, n: int = 5) -> DataFrame:
    scored = _concept_rows(df).withColumn("impact_score", impact_score())
    return scored.orderBy(F.desc("impact_score"), "concept").limit(n)


def top_persistent(df: DataFrame, order: Sequence[str] | None = None, n: int = 5) -> DataFrame:
    rates = persistence_by(df, "rubric_item", cohort(df, order))
    return rates.orderBy(F.desc("persistence_rate"), F.desc("cohort_size"), "rubric_item").limit(n)


def drilldown_candidates(df: DataFrame, n: int = 9) -> DataFrame:
    first = errors_by_item(df).orderBy("rubric_item").limit(n)
    label = F.format_string("%s (%d rows)", "rubric_item", "count_rows")
    return first.select("rubric_item", "count_rows", label.alias("label"))


def lesson_plan(df: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """Up to four lines (line_no, line) built from the first concept and the most persistent item."""
    concept = top_concepts(df, 1).select(
        F.lit(1).alias("line_no"),
        F.format_string(PLAN_CONCEPT, "concept", one_decimal(F.col("impact_score"))).alias("line"),
    )
    rate = percent(F.col("persistence_rate"), 0)
    persistent = top_persistent(df, order, 1).select(
        F.lit(2).alias("line_no"), F.format_string(PLAN_PERSISTENT, "rubric_item", rate, "cohort_size").alias("line")
    )
    fixed = df.sparkSession.createDataFrame([(3, PLAN_PRACTICE), (4, PLAN_EXEMPLARS)], "line_no int, line string")
    return concept.unionByName(persistent).unionByName(fixed).orderBy("line_no")


def report_lines(df: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """The report excerpts (section, line_no, line): eight issues, six persistence rows, six recommendations.

    The excerpts need several passes, so the columns they use are stored first and ``df`` is computed once.
    """
    df = materialize(df.select("student_id", "exam_id", "rubric_item", "points_lost", "concept"))
    pts = one_decimal(F.col("points_lost_total"))
    issues = _lines(
        top_issues(df, 8),
        "Top issues",
        [F.desc("points_lost_total"), F.asc("rubric_item")],
        F.format_string(ISSUE_LINE, "rubric_item", "count_rows", "students_affected", pts),
        NO_ISSUES,
    )
    rate = percent(F.col("persistence_rate"), 1)
    repeats = _lines(
        persistence_by(df, "rubric_item", cohort(df, order)).orderBy("rubric_item").limit(6),
        "Persistence",
        [F.asc("rubric_item")],
        F.format_string(PERSISTENCE_LINE, "rubric_item", "cohort_size", "repeated", rate),
        NO_PERSISTENCE,
    )
    advice = _lines(
        recommendations(df, order),
        "Recommendations",
        [F.desc("impact_score"), F.asc("concept")],
        F.format_string(RECOMMENDATION_LINE, "action", "concept", one_decimal(F.col("impact_score")), "students", pts),
        NO_RECOMMENDATIONS,
    )
    return reduce(DataFrame.unionByName, [issues, repeats, advice]).orderBy("section", "line_no")


def _concept_rows(df: DataFrame) -> DataFrame:
    return (
        df.withColumn("concept", clean(F.col("concept")))
        .filter(F.col("concept") != "")
        .groupBy("concept")
        .agg(
            F.count("*").alias("rows"),
            F.count_distinct("student_id").alias("students_affected"),
            F.sum("points_lost").alias("points_lost_total"),
            F.avg("points_lost").alias("points_lost_mean"),
        )
    )


def _lines(rows: DataFrame, section: str, order: list[Column], line: Column, fallback: str) -> DataFrame:
    """Numbered lines of one section, or its fallback line. The rows are already limited to a handful."""
    numbered = rows.select(F.row_number().over(W.orderBy(*order)).alias("line_no"), line.alias("line"))
    nothing = F.array(F.struct(F.lit(1).alias("line_no"), F.lit(fallback).alias("line")))
    lines = numbered.agg(F.collect_list(F.struct("line_no", "line")).alias("a"))
    return lines.select(
        F.lit(section).alias("section"), F.inline(F.when(F.size("a") > 0, F.col("a")).otherwise(nothing))
    )
