"""Exam order: a user-given list of exam ids, or the lexicographic order.

An exam missing from the list keeps its label and sorts after the listed ones.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def position(exam: Column, order: Sequence[str] | None) -> Column:
    """0-based place of an exam in the given list; null when it is not listed."""
    if not order:
        return F.lit(None).cast("int")
    places = F.array_position(F.array(*[F.lit(e) for e in order]), exam)
    return F.when(places > 0, places.cast("int") - 1)


def sort_keys(order: Sequence[str] | None, exam: str = "exam_id") -> list[Column]:
    """Columns to sort by, listed exams first."""
    if not order:
        return [F.col(exam).asc()]
    return [position(F.col(exam), order).asc_nulls_last(), F.col(exam).asc()]


@dataclass(frozen=True)
class Cohort:
    """Predicates for the first exam and the exams after it; constants, so scans can filter by them."""

    is_first: Column
    is_later: Column
    has_two: bool


def cohort(df: DataFrame, order: Sequence[str] | None, scope: DataFrame | None = None) -> Cohort:
    """First / later predicates over the exams that occur in ``df``.

    A list of which no exam occurs falls back to the lexicographic order. ``scope`` is the part of ``df``
    whose exams form the order, when that is not all of it. One aggregate row is read back; exams are
    neither ranked nor joined.
    """
    scope = df if scope is None else scope
    exam = F.col("exam_id")
    place = position(exam, order)
    seen = scope.agg(
        F.min(place).alias("first"), F.max(place).alias("last"), F.min(exam).alias("low"), F.max(exam).alias("high")
    ).first()
    listed = seen["first"] is not None
    if order and not listed and scope is not df:
        listed = not df.filter(place.isNotNull()).isEmpty()
    if listed:
        if seen["first"] is None:
            return Cohort(F.lit(False), F.lit(False), False)
        first, later = order[seen["first"]], list(order[seen["first"] + 1 :])
        return Cohort(exam == first, exam.isin(later), seen["first"] < seen["last"])
    if seen["low"] is None:
        return Cohort(F.lit(False), F.lit(False), False)
    return Cohort(exam == seen["low"], exam > seen["low"], seen["low"] < seen["high"])
