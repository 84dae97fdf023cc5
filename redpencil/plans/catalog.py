"""Every operator as a named query over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redpencil.functions.text import name_is_traversal, safe_name
from redpencil.operators import cohorts, concepts, metrics, quality, recommend, risk, rollup, scope, scores, similarity, trajectory
from redpencil.operators.normalize import ColumnMapping, apply_mapping, canonicalize
from redpencil.operators.shared import materialize, scratch_path
from redpencil.sources import files, tables
from redpencil.sources.tables import brand_deductions, deductions, event_deductions, event_records

Query = Callable[[SparkSession, str], DataFrame]

# A manual exam order: neither sorted nor complete, so that listed, unlisted and first exams all matter.
MANUAL_ORDER = ["Y1997", "Y1996", "Y1999", "Y1998", "Y1995"]
EVENT_MAPPING = ColumnMapping("sid", "exam", "question", "rubric", "loss")
SCORE_MAPPING = scores.ScoreMapping(
    "Student ID", "Student Name", "Assignment", "Rubric Item", "Category", "Score", "Max Score", "Comment"
)
# Concepts a recommendation may name.
ALLOWED = ["Brand#11 SMALL", "Brand#22 ECONOMY", "Brand#3 PROMO", "Brand#4 STANDARD", "Brand#25 MEDIUM", "Unmapped"]
# Jaccard alone decides here: the measure called corr never exceeds 1.
CLUSTER_JACCARD, CLUSTER_CORR = 0.25, 2.0


def with_concepts(spark: SparkSession, folder: str) -> DataFrame:
    return concepts.apply_concepts(deductions(spark, folder))


def rubric_as_concept(spark: SparkSession, folder: str) -> DataFrame:
    """V1 with the rubric item as concept: there persistence rates fall on both sides of the threshold."""
    return deductions(spark, folder).withColumn("concept", F.col("rubric_item"))


def event_concept_entries(spark: SparkSession, folder: str) -> DataFrame:
    """A raw concept map drawn from the event rubric items: padded, with placeholders and duplicate keys."""
    items = event_deductions(spark, folder).select("rubric_item").distinct()
    k = F.split("rubric_item", ":")[1].cast("int")
    kind = F.split("rubric_item", ":")[0]
    first = items.select(
        k.alias("pos"),
        F.concat(F.lit(" "), "rubric_item").alias("rubric_item"),
        F.when(k % 4 == 0, "N/A").when(k % 4 == 1, F.concat(F.lit("Old "), kind)).otherwise(
            F.concat(F.lit(" About "), kind, F.lit("\t"))
        ).alias("concept"),
    )
    second = items.filter(k % 4 == 1).select(
        (k + 100).alias("pos"), "rubric_item", F.concat(F.lit("New "), kind).alias("concept")
    )
    return first.unionByName(second)


def event_concept_map(spark: SparkSession, folder: str) -> DataFrame:
    return concepts.valid_entries(concepts.clean_concept_map(event_concept_entries(spark, folder)))


def mapped_events(spark: SparkSession, folder: str) -> DataFrame:
    return concepts.apply_concepts(event_deductions(spark, folder), event_concept_map(spark, folder))


def _csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    path = files.persist_dataset(deductions(spark, folder), scratch_path(spark, "deductions.csv"))
    return files.load_persisted_dataset(spark, path, check="inline")


def _csv_line_breaks(spark: SparkSession, folder: str) -> DataFrame:
    """A dataset whose topics and sections go over lines and hold quotes and separators, written and read back."""
    data = deductions(spark, folder)
    topic = F.replace(F.concat(F.lit('"'), "topic", F.lit('",')), F.lit(" "), F.lit("\n"))
    odd = data.withColumns({"topic": topic, "section_id": F.concat(F.lit("a,"), "section_id", F.lit('\r\n""b'))})
    path = files.persist_dataset(odd, scratch_path(spark, "breaks.csv"))
    return files.load_persisted_dataset(spark, path, check="inline")


def _normalize_csv(spark: SparkSession, folder: str) -> DataFrame:
    path = files.write_csv(event_records(spark, folder), scratch_path(spark, "events.csv"))
    return files.load_and_normalize(spark, path).data


def _concept_map_files(spark: SparkSession, folder: str, format: str = "lines") -> DataFrame:
    path = scratch_path(spark, "concepts.json")
    current = event_concept_map(spark, folder).withColumn("pos", F.lit(0))
    files.save_concept_map(current, path, format)
    return files.load_concept_map(spark, path, format)


def _concept_map_load(spark: SparkSession, folder: str) -> DataFrame:
    """Load a JSON object that still has placeholders and padded keys, in the order of its entries."""
    path = scratch_path(spark, "raw.json")
    entries = F.array_sort(F.collect_list(F.struct("pos", "rubric_item", "concept")))
    pairs = F.transform(entries, lambda e: F.struct(e["rubric_item"], e["concept"]))
    raw = event_concept_entries(spark, folder).agg(F.to_json(F.map_from_entries(pairs)).alias("value"))
    raw.coalesce(1).write.text(path)
    return files.load_concept_map(spark, path, "object")


def _packet(spark: SparkSession, folder: str) -> DataFrame:
    """Five tables; the joined lines, which four of them are made from, are computed once."""
    used = ["student_id", "exam_id", "question_id", "rubric_item", "points_lost", "concept"]
    data = materialize(with_concepts(spark, folder).select(*used))
    return files.write_packet(
        {
            "top_concepts": recommend.top_concepts(data),
            "persistent_concepts": recommend.top_persistent(data),
            "exam_changes": cohorts.exam_changes(data),
            "blank sections": metrics.group_comparison(event_deductions(spark, folder), "section_id"),
            "rubric/errors": metrics.summarize_errors(data),
        },
        scratch_path(spark, "packet"),
    )


def _rollup(spark: SparkSession, folder: str) -> rollup.Rollup:
    return rollup.roll_up(with_concepts(spark, folder), ["exam_id", "rubric_item", "section_id", "concept"])


def _rollup_packet(spark: SparkSession, folder: str) -> DataFrame:
    """Four tables from one pass over the facts."""
    return files.write_packet(rollup.packet_tables(_rollup(spark, folder), ["section_id"]), scratch_path(spark, "packet"))


def _exam_map(spark: SparkSession, folder: str) -> DataFrame:
    maps = metrics.rubric_exam_map(deductions(spark, folder))
    return maps.select("rubric_item", F.to_json("rows_by_exam").alias("rows_by_exam"))


def _safe_names(spark: SparkSession, folder: str) -> DataFrame:
    pages = tables.page_urls(spark, folder)
    # Every tenth address climbs a folder, every tenth is written with backslashes and dots.
    url = (
        F.when(F.col("page_id") % 10 == 0, F.concat("url", F.lit("/../up")))
        .when(F.col("page_id") % 10 == 1, F.concat(F.lit(" ..."), F.replace("url", F.lit("/"), F.lit("\\")), F.lit("..zip")))
        .otherwise(F.col("url"))
    )
    return pages.select("page_id", safe_name(url).alias("name"), name_is_traversal(url).alias("rejected"))


def _score_validate(spark: SparkSession, folder: str) -> DataFrame:
    broken = tables.scores(spark, folder).drop("student_name").withColumn("score", F.lit(None).cast("double"))
    return scores.validate_scores(broken)


def _invariants(spark: SparkSession, folder: str) -> DataFrame:
    """V1 with a share of blank graders' students, unreadable and negative points."""
    data = deductions(spark, folder)
    return quality.run_invariants(
        data.withColumns(
            {
                "student_id": F.when(F.col("ta_id").endswith("7"), " \t").otherwise(F.col("student_id")),
                "points_lost": F.when(F.col("question_id") == "L3", "3d")
                .when(F.col("question_id") == "L4", F.concat(F.lit("-"), F.col("points_lost").cast("string")))
                .otherwise(F.col("points_lost").cast("string")),
            }
        )
    )


def _student_scope(spark: SparkSession, folder: str) -> DataFrame:
    data = deductions(spark, folder)
    section = data.filter(F.col("section_id") == "BUILDING").select("student_id")
    return scope.student_scope(data, section)


def _upsert(spark: SparkSession, folder: str) -> DataFrame:
    frame = concepts.concept_map_frame(event_deductions(spark, folder), event_concept_map(spark, folder))
    edit = F.when(F.col("rubric_item").endswith("7"), " Edited ").when(F.col("concept") == "", "Added").otherwise("  ")
    return concepts.upsert_concept_map(event_concept_map(spark, folder), frame.withColumn("concept", edit))


def _v1(operator: Callable[..., DataFrame], *args, **kwargs) -> Query:
    return lambda spark, folder: operator(deductions(spark, folder), *args, **kwargs)


def _v1c(operator: Callable[..., DataFrame], *args, **kwargs) -> Query:
    return lambda spark, folder: operator(with_concepts(spark, folder), *args, **kwargs)


def _risk(operator: Callable[..., DataFrame], *args, **kwargs) -> Query:
    return lambda spark, folder: operator(brand_deductions(spark, folder), *args, **kwargs)


def _score(operator: Callable[..., DataFrame], *args, **kwargs) -> Query:
    return lambda spark, folder: operator(tables.scores(spark, folder), *args, **kwargs)


def _with_nulls(data: DataFrame, column: str, where) -> DataFrame:
    """A view with a share of its keys missing."""
    return data.withColumn(column, F.when(~where, F.col(column)))


def _rounded(query: Query, column: str) -> Query:
    """Deviations depend on the order of addition in their last digits; compare them rounded."""
    return lambda spark, folder: query(spark, folder).withColumn(column, F.round(column, 6))


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return recommend.recommendations(with_concepts(spark, folder))


def queries() -> dict[str, Query]:
    return {
        # Sources and sinks
        "csv_round_trip": _csv_round_trip,
        "csv_line_breaks": _csv_line_breaks,
        "normalize_csv": _normalize_csv,
        "concept_map_load": _concept_map_load,
        "concept_map_save": _concept_map_files,
        "concept_map_save_object": lambda s, d: _concept_map_files(s, d, "object"),
        "packet_manifest": _packet,
        "safe_name": _safe_names,
        # Normalisation
        "apply_mapping": lambda s, d: apply_mapping(event_records(s, d), EVENT_MAPPING),
        "canonicalize": lambda s, d: canonicalize(deductions(s, d).drop("ta_id")),
        "score_apply_mapping": lambda s, d: scores.apply_score_mapping(tables.score_records(s, d), SCORE_MAPPING),
        "score_sanitize": lambda s, d: scores.sanitize_scores(
            tables.scores(s, d).withColumn(
                "rubric_item", F.when(F.col("comment") == "A", "  ").otherwise(F.col("rubric_item"))
            )
        ),
        # Filters
        "student_scope": _student_scope,
        "rubric_drilldown": _v1(scope.rubric_drilldown, "Brand#16 LARGE"),
        "small_cohort_gate": lambda s, d: scope.small_cohort_gate(
            metrics.summarize_errors(deductions(s, d)), deductions(s, d)
        ),
        "rubric_search": _v1(scope.rubric_search, "#1 lAr"),
        "preview": _v1(scope.preview, 200),
        "anonymize": _v1(scope.anonymize),
        "anonymize_nulls": lambda s, d: scope.anonymize(_with_nulls(deductions(s, d), "student_id", F.col("question_id") == "L3")),
        # Quality
        "invariants": _invariants,
        "score_validate": _score_validate,
        # Aggregates
        "overall_summary": _v1(metrics.overall_summary),
        "rubric_item_stats": _rounded(_v1(metrics.rubric_item_stats), "std_points_lost"),
        "rubric_item_stats_nulls": _rounded(
            lambda s, d: metrics.rubric_item_stats(_with_nulls(deductions(s, d), "topic", F.col("question_id") == "L3")),
            "std_points_lost",
        ),
        "exam_breakdown": _v1(metrics.exam_breakdown),
        "student_summary": _v1(metrics.student_summary, MANUAL_ORDER),
        "score_distribution": _v1(metrics.score_distribution),
        "event_score_distribution": lambda s, d: metrics.score_distribution(event_deductions(s, d), 25),
        "summarize_errors": _v1(metrics.summarize_errors),
        "error_by_exam": _v1(metrics.error_by_exam),
        "rubric_exam_pivot": _v1(metrics.rubric_exam_pivot),
        "rubric_exam_map": _exam_map,
        "rollup_summaries": lambda s, d: rollup.summaries(_rollup(s, d), ["exam_id", "rubric_item", "section_id", "concept"]),
        "rollup_exam_breakdown": lambda s, d: rollup.exam_breakdown(_rollup(s, d)),
        "rollup_kpis": _rounded(lambda s, d: rollup.kpis(_rollup(s, d)), "std_points_per_student"),
        "rollup_packet": _rollup_packet,
        "section_comparison": _v1(metrics.group_comparison, "section_id"),
        "ta_comparison": _v1(metrics.group_comparison, "ta_id"),
        "persistence": _v1(cohorts.persistence),
        "persistence_manual_order": _v1(cohorts.persistence, MANUAL_ORDER),
        "course_group_stats": _v1(metrics.course_group_stats, "section_id", "section"),
        "disparity_gap": _v1(metrics.disparity_gap, "ta_id", "TA"),
        "kpis": _rounded(_v1(metrics.kpis), "std_points_per_student"),
        "kpis_drilldown": _rounded(_v1(metrics.kpis, "Brand#16 LARGE"), "std_points_per_student"),
        "score_rubric_stats": _rounded(_score(scores.score_rubric_stats), "std_score"),
        "score_rubric_stats_nulls": _rounded(
            lambda s, d: scores.score_rubric_stats(_with_nulls(tables.scores(s, d), "rubric_item", F.col("comment") == "A")),
            "std_score",
        ),
        "score_category_breakdown": _score(scores.category_breakdown),
        "score_student_summary": _score(scores.score_student_summary),
        "score_distribution_pct": _score(scores.score_distribution_pct),
        "item_concept_mode": _risk(risk.item_concept_mode),
        # Exam order and changes
        "exam_changes": _v1(cohorts.exam_changes, MANUAL_ORDER),
        "exam_change_table": _v1(cohorts.exam_change_table),
        "exam_order": _v1(cohorts.exam_order),
        # Rankings
        "top_issues": _v1(recommend.top_issues),
        "top_rubric_items": _v1(recommend.top_rubric_items),
        "high_persistence": _v1(recommend.high_persistence),
        "high_points": _v1(recommend.high_points),
        "suggested_topics": _v1c(recommend.suggested_topics),
        "top_concepts": _v1c(recommend.top_concepts),
        "top_persistent": _v1(recommend.top_persistent),
        "top_pairs": _v1(similarity.top_pairs),
        "top_risks": _risk(risk.top_risks),
        "report_lines": _v1c(recommend.report_lines),
        "drilldown_candidates": _v1(recommend.drilldown_candidates),
        # Concepts and recommendations
        "concept_map_clean": lambda s, d: concepts.clean_concept_map(event_concept_entries(s, d)),
        "apply_concept": mapped_events,
        "concept_coverage": lambda s, d: concepts.concept_coverage(mapped_events(s, d)),
        "allowed_concepts": lambda s, d: concepts.allowed_concepts(mapped_events(s, d)),
        "concept_map_upsert": _upsert,
        "topic_present": _v1(concepts.topic_present),
        "concept_stats": _v1c(recommend.concept_stats),
        "concept_persistence": lambda s, d: cohorts.concept_persistence(rubric_as_concept(s, d)),
        "recommendations": lambda s, d: recommend.recommendations(rubric_as_concept(s, d), top_n=500),
        "recommendations_default": flagship,
        "recommendations_allowed": lambda s, d: recommend.recommendations(
            rubric_as_concept(s, d), allowed=[" Brand#16 LARGE", *ALLOWED, ""], top_n=500
        ),
        "recommendations_unmapped_manual": _v1c(recommend.recommendations, MANUAL_ORDER, top_n=500, include_unmapped=True),
        "lesson_plan": _v1c(recommend.lesson_plan),
        # Similarity
        "item_support": _v1(similarity.item_support),
        "pair_similarity": _v1(similarity.overlapping_pairs),
        "similarity_edges": _v1(similarity.similarity_edges),
        "misconception_clusters": _v1(similarity.misconception_clusters, CLUSTER_JACCARD, CLUSTER_CORR),
        # Risk
        "risk_train": _risk(risk.risk_train),
        "risk_score_frame": _risk(risk.risk_score_frame),
        "risk_train_weights": _risk(risk.risk_train_weights),
        "risk_coefficients": _rounded(_risk(risk.risk_coefficients), "coefficient"),
        "risk_scores": _rounded(_risk(risk.risk_scores), "probability"),
        # Trajectories
        "transitions": _v1(trajectory.transitions),
        "top_transitions": _v1(trajectory.top_transitions),
        "trajectory": _v1(trajectory.trajectory),
    }
