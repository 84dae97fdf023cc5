import pytest
from pyspark.sql import functions as F

from conftest import CANONICAL_DDL, tuples
from redpencil.operators import concepts, recommend, scope
from redpencil.sources import files

RECOMMEND_DDL = "student_id string, exam_id string, question_id string, rubric_item string, points_lost double, concept string"


@pytest.fixture
def concept_rows(spark):
    rows = [
        ("m", "T1", "Q1", "Axis", 1.5, "Plots"),
        ("m", "T2", "Q1", "Axis", 0.5, "Plots"),
        ("n", "T1", "Q3", "Axis", 2.0, "Plots"),
        ("n", "T1", "Q2", "Joule", 3.0, "Energy"),
        ("o", "T2", "Q2", "Other", 20.0, "Unmapped"),
    ]
    return spark.createDataFrame(rows, RECOMMEND_DDL)


def test_clean_map_last_entry_wins(spark):
    entries = spark.createDataFrame(
        [(0, " A ", "First"), (1, "A", " Second "), (2, "A", "n/a"), (3, "B", "TRUE"), (4, " ", "x"), (5, "C", None)],
        "pos int, rubric_item string, concept string",
    )
    cleaned = concepts.clean_concept_map(entries)
    assert tuples(concepts.valid_entries(cleaned)) == [("A", "Second")]
    assert sorted(tuples(concepts.invalid_entries(cleaned))) == [(" ", "x"), ("A", "n/a"), ("B", "TRUE"), ("C", "")]


def test_topic_beats_map_beats_unmapped(spark):
    rows = [("s1", "E", "Q", " Item A", 1.0, "Topic A"), ("s2", "E", "Q", "Item B", 2.0, " "), ("s3", "E", "Q", "Item C", 3.0, None)]
    df = spark.createDataFrame(rows, CANONICAL_DDL)
    lookup = spark.createDataFrame([("Item B", "Concept B"), ("Item A", "Other")], files.MAP_DDL)
    out = concepts.apply_concepts(df, lookup)
    assert [(r["rubric_item"], r["concept"]) for r in out.orderBy("student_id").collect()] == [
        ("Item A", "Topic A"), ("Item B", "Concept B"), ("Item C", "Unmapped"),
    ]
    assert tuples(concepts.concept_coverage(out)) == [(2, 1)]
    assert tuples(concepts.allowed_concepts(out)) == [("Concept B",), ("Topic A",)]
    assert concepts.allowed_concepts(out, include_unmapped=True).count() == 3
    assert tuples(concepts.topic_present(df)) == [(True,)]
    assert tuples(concepts.topic_present(df.filter("student_id <> 's1'"))) == [(False,)]
    assert [r["concept"] for r in concepts.apply_concepts(df).orderBy("student_id").collect()][1:] == ["Unmapped"] * 2


def test_upsert(spark):
    old = spark.createDataFrame([("A", "One"), ("B", "Two")], files.MAP_DDL)
    edits = spark.createDataFrame([("A", "  "), ("B", " New "), ("C", "Three")], files.MAP_DDL)
    assert sorted(tuples(concepts.upsert_concept_map(old, edits))) == [("A", "One"), ("B", "New"), ("C", "Three")]
    frame = concepts.concept_map_frame(edits, old)
    assert tuples(frame) == [("A", "One"), ("B", "Two"), ("C", "")]


def test_recommendations_on_the_sample(sample):
    recs = tuples(recommend.recommendations(concepts.apply_concepts(sample)))
    assert recs[0] == ("Units", "Re-teach", 25.5, 3, 8.5, 1.0)
    # A concept without a first-exam cohort.
    assert recs[3] == ("Steps", "Add practice for", 5.0, 1, 5.0, 0.0)
    assert [r[0] for r in recs] == ["Units", "Graphs", "Signs", "Steps", "Numbers"]


def test_recommendation_filters(concept_rows):
    got = recommend.recommendations(concept_rows, ["T1", "T2"], allowed=[" Plots ", ""])
    assert tuples(got) == [("Plots", "Re-teach", 8.0, 2, 4.0, 0.5)]
    assert recommend.recommendations(concept_rows, allowed=[]).count() == 0
    everything = recommend.recommendations(concept_rows, include_unmapped=True)
    assert [r["concept"] for r in everything.collect()] == ["Unmapped", "Plots", "Energy"]
    assert recommend.recommendations(concept_rows, top_n=1).count() == 1
    # One exam only: no persistence, so practice.
    assert {r["persistence_rate"] for r in recommend.recommendations(concept_rows, ["T1"]).collect()} == {0.0}


def test_rankings_and_lines(sample):
    data = concepts.apply_concepts(sample)
    assert [r[0] for r in tuples(recommend.top_issues(data, 3))] == ["Unit missing", "Graph unlabelled", "Step skipped"]
    assert recommend.high_persistence(data).count() == 0
    assert tuples(recommend.high_persistence(data, min_cohort=2)) == [("Unit missing", 2, 2, 1.0)]
    assert tuples(recommend.suggested_topics(data)) == [("Units", 8.5), ("Graphs", 5.0), ("Steps", 5.0)]
    assert recommend.top_concepts(data).first()["impact_score"] == 25.5
    assert [r[0] for r in tuples(recommend.top_persistent(data, n=2))] == ["Unit missing", "Sign flipped"]
    assert recommend.drilldown_candidates(data).first()["label"] == "Graph unlabelled (2 rows)"
    plan = [r["line"] for r in recommend.lesson_plan(data).collect()]
    assert plan[0] == "Prioritize reteaching **Units**; it has the highest impact score (25.5)."
    assert plan[1] == "Address recurring concept **Unit missing**; repeat rate 100% across 2 students."
    assert len(plan) == 4
    lines = recommend.report_lines(data).filter("section = 'Persistence'").collect()
    assert lines[0]["line"] == "- Graph unlabelled: cohort 1, repeated 0, rate 0.0%"
    nothing = recommend.report_lines(data.limit(0)).collect()
    assert [r["line_no"] for r in nothing] == [1, 1, 1]
    assert len(recommend.lesson_plan(data.limit(0)).collect()) == 2


def test_scope(spark, sample):
    assert scope.student_scope(sample, ["u1", "u5"]).count() == 5
    assert scope.student_scope(sample).count() == scope.student_scope(sample, []).count() == 13
    ids = spark.createDataFrame([("u4",), ("u4",)], "student_id string")
    assert scope.student_scope(sample, ids).count() == 2
    assert scope.rubric_drilldown(sample, "Graph unlabelled").count() == 2
    assert tuples(scope.rubric_search(sample, "UNIT")) == [("Unit missing",)]
    assert scope.rubric_search(sample, ".*").count() == 0
    assert scope.preview(sample, 3).count() == 3
    assert scope.small_cohort_gate(sample, sample).count() == 13
    assert scope.small_cohort_gate(sample, sample.filter("student_id < 'u5'")).count() == 0


def test_aliases_follow_the_sorted_ids(spark, sample):
    out = scope.anonymize(sample.withColumn("student_name", F.lit("Name")))
    assert out.select("student_id").distinct().count() == 5
    assert out.filter("rubric_item = 'Rounding'").first()["student_name"] == "Student 005"
    assert scope.anonymize(sample, enabled=False) is sample
    # A third of all rows belongs to one student.
    many = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "zzz").otherwise(F.format_string("u%05d", "id")).alias("student_id"))
    aliases = dict(tuples(scope.student_aliases(many)))
    assert aliases == {s: f"Student {i + 1:03d}" for i, s in enumerate(sorted({r[0] for r in tuples(many)}))}
    assert scope.anonymize(many).count() == 3000
    some = spark.createDataFrame([("b",), (None,), ("a",), (None,)], "student_id string")
    assert sorted(tuples(scope.anonymize(some))) == [("Student 001",), ("Student 001",), ("Student 002",), ("Student 003",)]
