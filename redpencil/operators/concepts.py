"""Concepts: cleaning a rubric-item → concept map, attaching concepts to rows, coverage and edits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redpencil.functions.text import clean, is_blank
from redpencil.schemas import UNMAPPED

# Texts that stand for "no concept".
PLACEHOLDERS = ["", "none", "null", "nil", "n/a", "na", "yes", "true", "false"]


def clean_concept_map(entries: DataFrame) -> DataFrame:
    """Rows (rubric_item, concept, valid) from raw (pos, rubric_item, concept) entries.

    Keys and values are stripped. Of several entries with the same key the last one counts, separately
    among the valid and the invalid ones. A blank key stays as it was written.
    """
    key, concept = clean(F.col("rubric_item")), clean(F.col("concept"))
    blank_key = key == ""
    valid = ~blank_key & ~F.lower(concept).isin(PLACEHOLDERS)
    return (
        entries.select(
            "pos",
            F.when(blank_key, F.coalesce("rubric_item", F.lit(""))).otherwise(key).alias("rubric_item"),
            concept.alias("concept"),
            valid.alias("valid"),
        )
        .groupBy("rubric_item", "valid")
        .agg(F.max_by("concept", F.coalesce("pos", F.lit(-1))).alias("concept"))
        .select("rubric_item", "concept", "valid")
    )


def valid_entries(cleaned: DataFrame) -> DataFrame:
    return cleaned.filter("valid").select("rubric_item", "concept")


def invalid_entries(cleaned: DataFrame) -> DataFrame:
    return cleaned.filter(~F.col("valid")).select("rubric_item", "concept")


def apply_concepts(df: DataFrame, concept_map: DataFrame | None = None, unmapped: str = UNMAPPED) -> DataFrame:
    """Add ``concept``: the topic, else the mapped concept of the rubric item, else the unmapped label."""
    topic = clean(F.col("topic")) if "topic" in df.columns else F.lit("")
    own = F.nullif(topic, F.lit(""))
    data = df.withColumn("rubric_item", clean(F.col("rubric_item")))
    if concept_map is None:
        return data.withColumn("concept", F.coalesce(own, F.lit(unmapped)))
    lookup = concept_map.select("rubric_item", clean(F.col("concept")).alias("_mapped"))
    return (
        data.join(lookup, "rubric_item", "left")
        .withColumn("concept", F.coalesce(own, F.nullif("_mapped", F.lit("")), F.lit(unmapped)))
        .select(*df.columns, "concept")
    )


def concept_coverage(df: DataFrame, unmapped: str = UNMAPPED) -> DataFrame:
    """One row: mapped and unmapped row counts."""
    missing = F.coalesce("concept", F.lit("")) == unmapped if "concept" in df.columns else F.lit(False)
    return df.agg(F.count_if(~missing).alias("mapped"), F.count_if(missing).alias("unmapped"))


def allowed_concepts(df: DataFrame, include_unmapped: bool = False, unmapped: str = UNMAPPED) -> DataFrame:
    """Sorted distinct concepts that a recommendation may name."""
    concepts = df.select(clean(F.col("concept")).alias("concept")).distinct().filter(F.col("concept") != "")
    return (concepts if include_unmapped else concepts.filter(F.col("concept") != unmapped)).orderBy("concept")


def concept_map_frame(df: DataFrame, concept_map: DataFrame) -> DataFrame:
    """The edit table: every rubric item of the data with its current concept, blank when it has none."""
    items = df.select(clean(F.col("rubric_item")).alias("rubric_item")).distinct()
    return (
        items.join(concept_map.select("rubric_item", "concept"), "rubric_item", "left")
        .select("rubric_item", F.coalesce("concept", F.lit("")).alias("concept"))
        .orderBy("rubric_item")
    )


def upsert_concept_map(concept_map: DataFrame, edits: DataFrame) -> DataFrame:
    """Non-blank edits replace or extend the map; entries without a concept are dropped."""
    new = edits.select("rubric_item", clean(F.col("concept")).alias("_new")).filter(F.col("_new") != "")
    return (
        concept_map.select("rubric_item", "concept")
        .join(new, "rubric_item", "full_outer")
        .select("rubric_item", F.coalesce("_new", "concept").alias("concept"))
        .filter(F.coalesce("concept", F.lit("")) != "")
    )


def topic_present(df: DataFrame) -> DataFrame:
    """One row, one flag: does any row carry a topic?"""
    has = F.max(~is_blank(F.col("topic"))) if "topic" in df.columns else F.lit(False)
    return df.agg(F.coalesce(has, F.lit(False)).alias("topic_present"))
