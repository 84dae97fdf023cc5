"""From arbitrary headers to the canonical deduction table: header tests, mapping, projection, row checks."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import asdict, dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redpencil.functions.text import clean, collapse, to_number
from redpencil.schemas import DEDUCTION_COLUMNS, DEDUCTION_IDS, DEDUCTION_OPTIONAL, DEDUCTION_REQUIRED

# The header keywords tried for each field, in this order.
HEADER_KEYWORDS = {
    "student_id": ["student id", "id", "sid", "uid"],
    "exam_id": ["exam", "assessment", "assignment", "test"],
    "question_id": ["question", "item", "q", "problem"],
    "rubric_item": ["rubric", "criterion", "prompt", "issue", "deduction"],
    "points_lost": ["points_lost", "points lost", "deduction", "penalty", "loss", "points"],
    "topic": ["topic", "tag", "category"],
    "section_id": ["section", "discussion", "lecture"],
    "ta_id": ["ta", "grader", "assistant", "gsi"],
}


@dataclass(frozen=True)
class ColumnMapping:
    """Which source column feeds each canonical column."""

    student_id: str
    exam_id: str
    question_id: str
    rubric_item: str
    points_lost: str
    topic: str | None = None
    section_id: str | None = None
    ta_id: str | None = None

    @classmethod
    def from_dict(cls, fields: Mapping[str, str | None]) -> ColumnMapping:
        for name in DEDUCTION_REQUIRED:
            if not fields.get(name):
                raise ValueError(f"No source column given for required field '{name}'")
        return cls(**{name: fields.get(name) for name in DEDUCTION_COLUMNS})

    def to_dict(self) -> dict[str, str | None]:
        return asdict(self)


class Normalized(NamedTuple):
    data: DataFrame
    mapping: ColumnMapping | None
    suggestion: dict[str, str | None] | None


def is_canonical(df: DataFrame) -> bool:
    return set(DEDUCTION_REQUIRED) <= set(df.columns)


def needs_mapping(df: DataFrame) -> bool:
    return not is_canonical(df)


def match_headers(columns: list[str], keywords: Mapping[str, list[str]]) -> dict[str, str | None]:
    """For each field the first header, in file order, that contains one of its keywords."""
    return {
        field: next((c for c in columns if any(word in c.lower() for word in words)), None)
        for field, words in keywords.items()
    }


def suggest_mapping(df: DataFrame) -> dict[str, str | None]:
    return match_headers(df.columns, HEADER_KEYWORDS)


def resolve_mapping(
    suggestion: Mapping[str, str | None], saved: Mapping[str, str | None] | None
) -> dict[str, str | None]:
    """A saved choice wins over the suggestion, field by field."""
    return {**suggestion, **{k: v for k, v in (saved or {}).items() if v}}


def apply_mapping(df: DataFrame, mapping: ColumnMapping, check: str = "inline") -> DataFrame:
    """Project a source frame onto the canonical columns and reject it when a row is not acceptable.

    ``check="inline"`` puts the test into the projection, so that the first action fails and no extra pass over the
    source is needed; ``check="scan"`` tests all rows in one aggregate before returning.
    """
    unknown = [c for c in mapping.to_dict().values() if c and c not in df.columns]
    if unknown:
        raise ValueError(f"The source has no columns {unknown}")
    columns = {}
    for field, source in mapping.to_dict().items():
        if field == "points_lost":
            columns[field] = to_number(F.col(_quoted(source)), df.schema[source].dataType)
        elif field == "rubric_item":
            columns[field] = collapse(clean(F.col(_quoted(source))))
        else:
            columns[field] = clean(F.col(_quoted(source))) if source else F.lit("")
    return _checked(df, columns, ["points_lost", *DEDUCTION_IDS], check)


def canonicalize(df: DataFrame, check: str = "inline") -> DataFrame:
    """Strip ids, fill the optional columns and put an already canonical frame into table order."""
    missing = [c for c in DEDUCTION_REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"The frame lacks required columns: {missing}")
    columns: dict[str, Column] = {c: clean(F.col(c)) for c in DEDUCTION_IDS}
    columns["points_lost"] = to_number(F.col("points_lost"), df.schema["points_lost"].dataType)
    columns.update({c: clean(F.col(c)) if c in df.columns else F.lit("") for c in DEDUCTION_OPTIONAL})
    return _checked(df, columns, [*DEDUCTION_IDS, "points_lost"], check)


def normalize(
    df: DataFrame, mapping: ColumnMapping | None = None, infer_mapping: bool = True, check: str = "inline"
) -> Normalized:
    """Canonical input is cleaned; anything else goes through the given or the suggested mapping."""
    if is_canonical(df):
        return Normalized(canonicalize(df, check), None, None)
    suggestion = None
    if mapping is None:
        if not infer_mapping:
            raise ValueError("This dataset needs a column mapping")
        suggestion = suggest_mapping(df)
        mapping = ColumnMapping.from_dict(suggestion)
    return Normalized(apply_mapping(df, mapping, check), mapping, suggestion)


def _quoted(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def _problems(checked: list[str]) -> list[tuple[Column, str]]:
    """Tests on the cleaned columns and their messages, in the order in which they are reported."""
    tests = []
    for c in checked:
        if c == "points_lost":
            tests.append((F.col(c).isNull(), "points_lost has non-numeric values"))
            tests.append((F.col(c) < 0, "points_lost must be non-negative"))
        else:
            tests.append((F.col(c) == "", f"Required values are missing in '{c}'"))
    return tests


def _checked(df: DataFrame, columns: dict[str, Column], order: list[str], check: str) -> DataFrame:
    projected = df.select(*[columns[c].alias(c) for c in DEDUCTION_COLUMNS])
    tests = _problems(order)
    if check == "inline":
        # The test sits in a filter, so no pruning of unused columns can skip it.
        passed = F.lit(True)
        for bad, message in reversed(tests):
            passed = F.when(bad, F.raise_error(F.lit(message)).cast("boolean")).otherwise(passed)
        return projected.filter(passed)
    if check != "scan":
        raise ValueError("check must be 'scan' or 'inline'")
    counts = projected.agg(*[F.count_if(bad).alias(f"p{i}") for i, (bad, _) in enumerate(tests)]).first()
    for count, (_, message) in zip(counts, tests):
        if count:
            raise ValueError(f"{message} ({count} rows)")
    return projected
