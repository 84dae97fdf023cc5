"""The score family: rows with a score out of a maximum instead of points lost."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redpencil.functions.text import clean, is_blank, to_number
from redpencil.operators.metrics import histogram, value_stats
from redpencil.operators.normalize import match_headers
from redpencil.operators.shared import materialize, null_safe_join
from redpencil.schemas import SCORE_COLUMNS, SCORE_REQUIRED

# The header keywords tried for each field, in this order.
SCORE_HEADER_KEYWORDS = {
    "student_id": ["student id", "id", "sid"],
    "student_name": ["name", "student"],
    "assignment": ["assignment", "homework", "exam", "assessment"],
    "rubric_item": ["rubric", "question", "item", "criterion", "prompt"],
    "category": ["category", "section", "group"],
    "score": ["score", "points awarded", "points"],
    "max_score": ["max", "total", "possible", "out of"],
    "comment": ["comment", "feedback", "remark", "note"],
}
# What stands in for a missing column or entry.
DEFAULT_ASSIGNMENT = "Assignment"
DEFAULT_CATEGORY = "Uncategorized"
# The validation messages.
MISSING_COLUMN = "Missing required column: "
NO_ROWS = "Dataset is empty"
NO_SCORES = "No numeric scores detected after mapping"


@dataclass(frozen=True)
class ScoreMapping:
    """Which source column feeds each column of the score table."""

    student_id: str
    student_name: str
    assignment: str | None
    rubric_item: str
    category: str | None
    score: str
    max_score: str | None
    comment: str | None

    @classmethod
    def from_dict(cls, fields: Mapping[str, str | None]) -> ScoreMapping:
        for name in SCORE_REQUIRED:
            if not fields.get(name):
                raise ValueError(f"No source column given for required field '{name}'")
        return cls(**{name: fields.get(name) for name in SCORE_COLUMNS})

    def to_dict(self) -> dict[str, str | None]:
        return asdict(self)


def suggest_score_mapping(df: DataFrame) -> dict[str, str | None]:
    return match_headers(df.columns, SCORE_HEADER_KEYWORDS)


def apply_score_mapping(df: DataFrame, mapping: ScoreMapping) -> DataFrame:
    """Project a source frame onto the score table. Scores that are no numbers become null, not errors."""
    source = mapping.to_dict()
    absent = [source[c] for c in SCORE_REQUIRED if source[c] not in df.columns]
    if absent:
        raise ValueError(f"The source has no columns {absent}")

    def given(field: str):
        name = source[field]
        return F.col(f"`{name}`") if name and name in df.columns else None

    def number(field: str):
        column = given(field)
        return F.lit(None).cast("double") if column is None else to_number(column, df.schema[source[field]].dataType)

    def text(field: str, default: str):
        column = given(field)
        return F.lit(default) if column is None else F.coalesce(column.cast("string"), F.lit(default))

    assignment = given("assignment")
    columns = {
        "student_id": clean(given("student_id")),
        "student_name": clean(given("student_name")),
        "assignment": F.lit(DEFAULT_ASSIGNMENT) if assignment is None else clean(assignment),
        "rubric_item": clean(given("rubric_item")),
        "category": text("category", DEFAULT_CATEGORY),
        "score": number("score"),
        "max_score": number("max_score"),
        "comment": text("comment", ""),
    }
    return df.select(*[columns[c].alias(c) for c in SCORE_COLUMNS])


def sanitize_scores(df: DataFrame) -> DataFrame:
    """Drop rows without a student or a rubric item."""
    return df.filter(~is_blank(F.col("student_id")) & ~is_blank(F.col("rubric_item")))


def validate_scores(df: DataFrame) -> DataFrame:
    """Rows (check_no, message), one per problem; one aggregate over the data."""
    absent = [c for c in SCORE_REQUIRED if c not in df.columns]
    numbers = F.count("score") if "score" in df.columns else F.lit(1)
    counts = df.agg(F.count("*").alias("rows"), numbers.alias("scores"))
    messages = [
        *[F.lit(MISSING_COLUMN + c) for c in absent],
        F.when(F.col("rows") == 0, NO_ROWS),
        F.when(F.col("scores") == 0, NO_SCORES),
    ]
    found = counts.select(F.posexplode(F.array_compact(F.array(*messages))).alias("check_no", "message"))
    return found.select((F.col("check_no") + 1).alias("check_no"), "message")


def score_rubric_stats(df: DataFrame) -> DataFrame:
    """Count, mean, exact median, population deviation, highest maximum and share at full marks per item.

    The share is over the rows whose maximum is known.
    """
    keys = ["rubric_item", "category"]
    data = _labelled(df)
    full = F.when(F.col("max_score").isNotNull(), F.coalesce(F.col("score") >= F.col("max_score"), F.lit(False)))
    counts = materialize(
        data.groupBy(*keys, "score").agg(
            F.count("*").alias("n"),
            F.max("max_score").alias("_max"),
            F.count("max_score").alias("_rated"),
            F.count_if(full).alias("_full"),
        )
    )
    marks = counts.groupBy(*keys).agg(
        F.max("_max").alias("max_score_value"),
        (F.sum("_full") / F.nullif(F.sum("_rated"), F.lit(0)) * 100).alias("full_points_pct"),
    )
    return (
        null_safe_join(value_stats(counts, keys, "score"), marks, keys)
        .select(
            *keys,
            F.col("rows").alias("count"),
            F.col("mean").alias("avg_score"),
            F.col("median").alias("median_score"),
            F.col("std").alias("std_score"),
            "max_score_value",
            "full_points_pct",
        )
        .orderBy("category", "rubric_item")
    )


def category_breakdown(df: DataFrame) -> DataFrame:
    out = _labelled(df).groupBy("category").agg(
        F.count_distinct("rubric_item").alias("items"),
        F.count_distinct("student_id").alias("submissions"),
        *_sums(),
    )
    return out.withColumn("pct_of_total", _share()).orderBy("category")


def score_student_summary(df: DataFrame) -> DataFrame:
    """Sums and percent per (student, name, assignment), best first."""
    keys = ["student_id", "student_name", "assignment"]
    out = _labelled(df).groupBy(*keys).agg(*_sums()).withColumn("percent", _share())
    return out.orderBy(F.desc_nulls_last("percent"), *keys)


def score_distribution_pct(df: DataFrame, bins: int = 10) -> DataFrame:
    """Histogram of percent of full marks, or of the raw scores when no row knows its maximum."""
    data = _labelled(df)
    any_max = not data.filter(F.col("max_score").isNotNull()).isEmpty()
    ratio = F.col("score") / F.nullif("max_score", F.lit(0.0))
    percent = F.when(ratio.isNotNull(), F.greatest(F.least(ratio, F.lit(1.0)), F.lit(0.0)) * 100)
    label = F.concat(F.col("bin_lo").cast("bigint"), F.lit("-"), F.col("bin_hi").cast("bigint"))
    return histogram(data, percent if any_max else F.col("score"), bins, label)


def _labelled(df: DataFrame) -> DataFrame:
    """Numeric scores, a null maximum column where there is none, and a label for a missing category."""
    top = (
        to_number(F.col("max_score"), df.schema["max_score"].dataType)
        if "max_score" in df.columns
        else F.lit(None).cast("double")
    )
    return df.withColumns(
        {
            "score": to_number(F.col("score"), df.schema["score"].dataType),
            "max_score": top,
            "category": F.coalesce("category", F.lit(DEFAULT_CATEGORY)),
        }
    )


def _sums():
    return [
        F.coalesce(F.sum("score"), F.lit(0.0)).alias("score_sum"),
        F.coalesce(F.sum("max_score"), F.lit(0.0)).alias("max_sum"),
    ]


def _share():
    return F.when(F.col("max_sum") > 0, F.col("score_sum") / F.col("max_sum") * 100)
