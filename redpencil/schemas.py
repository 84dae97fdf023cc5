"""Column lists and Spark schemas of the deduction and score tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# The canonical column names, in table order.
DEDUCTION_COLUMNS = [
    "student_id",
    "exam_id",
    "question_id",
    "rubric_item",
    "points_lost",
    "topic",
    "section_id",
    "ta_id",
]
DEDUCTION_IDS = ["student_id", "exam_id", "question_id", "rubric_item"]
DEDUCTION_REQUIRED = DEDUCTION_IDS + ["points_lost"]
DEDUCTION_OPTIONAL = ["topic", "section_id", "ta_id"]
INVARIANT_COLUMNS = DEDUCTION_REQUIRED + ["topic"]

SCORE_COLUMNS = [
    "student_id",
    "student_name",
    "assignment",
    "rubric_item",
    "category",
    "score",
    "max_score",
    "comment",
]
SCORE_REQUIRED = ["student_id", "student_name", "rubric_item", "score"]

UNMAPPED = "Unmapped"

DEDUCTION_SCHEMA = T.StructType(
    [T.StructField(c, T.DoubleType() if c == "points_lost" else T.StringType()) for c in DEDUCTION_COLUMNS]
)
SCORE_SCHEMA = T.StructType(
    [T.StructField(c, T.DoubleType() if c in ("score", "max_score") else T.StringType()) for c in SCORE_COLUMNS]
)


def empty(spark: SparkSession, ddl: str) -> DataFrame:
    """A frame without rows that still carries its full schema."""
    return spark.createDataFrame([], ddl)
