"""Data-quality reports: four invariants in one pass, and the schema listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redpencil.functions.text import is_blank, to_number
from redpencil.schemas import DEDUCTION_IDS, INVARIANT_COLUMNS


def required_columns(df: DataFrame) -> dict[str, bool]:
    return {c: c in df.columns for c in INVARIANT_COLUMNS}


def missing_identifiers(df: DataFrame) -> Column:
    """Count of rows with a blank id. A column that is absent is blank in every row."""
    blank = F.lit(False)
    for c in DEDUCTION_IDS:
        blank = blank | (is_blank(F.col(c)) if c in df.columns else F.lit(True))
    return F.count_if(blank)


def non_numeric_points(df: DataFrame) -> Column:
    return F.count_if(_points(df).isNull())


def negative_points(df: DataFrame) -> Column:
    return F.count_if(_points(df) < 0)


def run_invariants(df: DataFrame) -> DataFrame:
    """Rows (name, ok, detail) for the four checks; one aggregate over the data."""
    absent = [c for c, present in required_columns(df).items() if not present]
    counts = df.agg(
        missing_identifiers(df).alias("missing_identifiers"),
        non_numeric_points(df).alias("non_numeric_points_lost"),
        negative_points(df).alias("negative_points_lost"),
    )
    header = F.struct(
        F.lit("required_columns").alias("name"),
        F.lit(not absent).alias("ok"),
        F.lit(", ".join(absent) or "all present").alias("detail"),
    )
    checks = [
        F.struct(F.lit(c).alias("name"), (F.col(c) == 0).alias("ok"), F.col(c).cast("string").alias("detail"))
        for c in counts.columns
    ]
    return counts.select(F.inline(F.array(header, *checks)))


def schema_listing(df: DataFrame) -> DataFrame:
    """Rows (column, dtype) in column order."""
    return df.sparkSession.createDataFrame(df.dtypes, "column string, dtype string")


def _points(df: DataFrame) -> Column:
    if "points_lost" not in df.columns:
        return F.lit(None).cast("double")
    return to_number(F.col("points_lost"), df.schema["points_lost"].dataType)
