"""Row filters, the small-cohort gate and the anonymiser."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redpencil.operators.shared import ordinals

# Fixed value: instructor-level output is withheld below this number of students.
SMALL_COHORT = 5
# Size bound: keys over which the rows without an id are spread.
BLANK_SHARES = 256


def student_scope(df: DataFrame, students: Iterable[str] | DataFrame | None = None) -> DataFrame:
    """All rows, or those of the given students. An empty list means everybody, an empty frame nobody.

    A frame of ids (column ``student_id``) may be of any size.
    """
    if isinstance(students, DataFrame):
        return df.join(students.select("student_id").distinct(), "student_id", "left_semi").select(*df.columns)
    wanted = [] if students is None else list(students)
    return df.filter(F.col("student_id").isin(wanted)) if wanted else df


def rubric_drilldown(df: DataFrame, rubric_item: str | None) -> DataFrame:
    return df if rubric_item is None else df.filter(F.col("rubric_item") == rubric_item)


def rubric_search(df: DataFrame, text: str) -> DataFrame:
    """Distinct rubric items that contain the text, in any case."""
    items = df.select("rubric_item").distinct()
    return items.filter(F.contains(F.lower("rubric_item"), F.lower(F.lit(text)))).orderBy("rubric_item")


def preview(df: DataFrame, rows: int = 20) -> DataFrame:
    """First rows under a total order of all columns, as a distributed table has no file order."""
    return df.orderBy(*df.columns).limit(rows)


def small_cohort_gate(output: DataFrame, scope: DataFrame, minimum: int = SMALL_COHORT) -> DataFrame:
    """``output`` as it is, or without rows when ``scope`` holds fewer than ``minimum`` students."""
    students = scope.select("student_id").distinct().limit(minimum).agg(F.count("*")).scalar()
    return output.filter(students >= minimum)


def _id():
    return F.coalesce(F.col("student_id").cast("string"), F.lit(""))


def student_aliases(df: DataFrame) -> DataFrame:
    """Rows (student_id, alias): ids in sorted order become ``Student 001``, ``Student 002``, …; a null id is blank."""
    ids = df.select(_id().alias("student_id")).distinct()
    numbered = ordinals(ids, "student_id", "_n")
    return numbered.select("student_id", F.format_string("Student %03d", "_n").alias("alias"))


def anonymize(df: DataFrame, enabled: bool = True) -> DataFrame:
    """Replace ids, and names where there are any, by aliases; every row stays. Few students: the facts are not shuffled.

    The rows of the blank id, which may be many, meet their alias in ``BLANK_SHARES`` keys, dealt by the rest of the row.
    """
    if not enabled:
        return df
    others = [F.col(c) for c in df.columns if c != "student_id"]
    share = F.pmod(F.xxhash64(*others), F.lit(BLANK_SHARES)) if others else F.lit(0).cast("bigint")
    blank = F.col("student_id") == ""
    zero = F.lit(0).cast("bigint")
    shares = F.when(blank, F.sequence(zero, zero + BLANK_SHARES - 1)).otherwise(F.array(zero))
    aliases = student_aliases(df).withColumn("_share", F.explode(shares))
    out = df.withColumn("student_id", _id()).withColumn("_share", F.when(blank, share).otherwise(zero))
    out = out.join(aliases, ["student_id", "_share"]).withColumn("student_id", F.col("alias"))
    if "student_name" in df.columns:
        out = out.withColumn("student_name", F.col("alias"))
    return out.select(*df.columns)
