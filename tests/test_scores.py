import pytest

from conftest import tuples
from redpencil.operators import scores
from redpencil.schemas import SCORE_SCHEMA

RAW = [
    ("Ada", "s101", "HW1", "Correctness", "Technical", "8", "10", "ok"),
    ("Ada", "s101", "HW1", "Style", "Technical", "3", "5", "ok"),
    ("Bo", "s102", "HW1", "Correctness", "Technical", "10", "10", "ok"),
    ("Bo", "s102", "HW1", "Style", "Technical", "5", "5", "ok"),
    ("Cy", "s103", "HW1", "Correctness", "Technical", "6", "10", "ok"),
    ("Cy", "s103", "HW1", "Style", "Technical", "4", "5", "ok"),
]
HEADER = "`Student Name` string, `Student ID` string, Assignment string, `Rubric Item` string, Category string, Score string, `Max Score` string, Comment string"


@pytest.fixture
def table(spark):
    raw = spark.createDataFrame(RAW, HEADER)
    return scores.apply_score_mapping(raw, scores.ScoreMapping.from_dict(scores.suggest_score_mapping(raw)))


def test_suggestion(spark):
    assert scores.suggest_score_mapping(spark.createDataFrame([], HEADER)) == {
        "student_id": "Student ID", "student_name": "Student Name", "assignment": "Assignment",
        "rubric_item": "Rubric Item", "category": "Category", "score": "Score", "max_score": "Max Score",
        "comment": "Comment",
    }
    with pytest.raises(ValueError, match="score"):
        scores.ScoreMapping.from_dict({"student_id": "a", "student_name": "b", "rubric_item": "c"})


def test_mapping_defaults(spark):
    raw = spark.createDataFrame([(" s1 ", "N", " item ", "bad", None)], "sid string, n string, r string, p string, cat string")
    row = scores.apply_score_mapping(raw, scores.ScoreMapping("sid", "n", None, "r", "cat", "p", "gone", None)).first()
    assert tuple(row) == ("s1", "N", "Assignment", "item", "Uncategorized", None, None, "")
    with pytest.raises(ValueError, match="gone"):
        scores.apply_score_mapping(raw, scores.ScoreMapping("gone", "n", None, "r", None, "p", None, None))


def test_summaries(table):
    assert tuples(scores.score_student_summary(table)) == [
        ("s102", "Bo", "HW1", 15.0, 15.0, 100.0),
        ("s101", "Ada", "HW1", 11.0, 15.0, pytest.approx(73.3333, abs=1e-3)),
        ("s103", "Cy", "HW1", 10.0, 15.0, pytest.approx(66.6667, abs=1e-3)),
    ]
    assert tuples(scores.category_breakdown(table)) == [("Technical", 2, 3, 36.0, 45.0, 80.0)]
    stats = {r[0]: r[2:] for r in tuples(scores.score_rubric_stats(table))}
    assert stats["Correctness"] == (3, 8.0, 8.0, pytest.approx((8 / 3) ** 0.5), 10.0, pytest.approx(100 / 3))
    assert stats["Style"][5] == pytest.approx(100 / 3)


def test_missing_values(spark, table):
    rows = [("s1", "N", "A", "i", None, None, 10.0, ""), ("s1", "N", "A", "i", None, 4.0, None, ""), ("s2", "N", "A", "i", None, 4.0, 4.0, "")]
    df = spark.createDataFrame(rows, SCORE_SCHEMA)
    assert tuples(scores.score_rubric_stats(df)) == [("i", "Uncategorized", 3, 4.0, 4.0, 0.0, 10.0, 50.0)]
    none = df.filter("score is null").drop("max_score")
    assert tuples(scores.score_rubric_stats(none)) == [("i", "Uncategorized", 1, None, None, None, None, None)]
    assert tuples(scores.category_breakdown(none)) == [("Uncategorized", 1, 1, 0.0, 0.0, None)]


def test_distribution(spark, table):
    rows = tuples(scores.score_distribution_pct(table, 4))
    assert [(r[1], r[4]) for r in rows] == [("60-70", 2), ("70-80", 0), ("80-90", 2), ("90-100", 2)]
    raw = tuples(scores.score_distribution_pct(table.drop("max_score"), 2))
    assert [(r[1], r[4]) for r in raw] == [("3-6", 4), ("6-10", 2)]
    zero = spark.createDataFrame([("s", "n", "a", "i", "c", 5.0, 0.0, "")], SCORE_SCHEMA)
    assert scores.score_distribution_pct(zero).count() == 0


def test_validation_and_sanitising(table):
    assert scores.validate_scores(table).count() == 0
    assert [r["message"] for r in scores.validate_scores(table.limit(0).drop("student_id")).collect()] == [
        "Missing required column: student_id", "Dataset is empty", "No numeric scores detected after mapping",
    ]
    blank = table.na.replace({"Style": " "}, subset=["rubric_item"])
    assert scores.sanitize_scores(blank).count() == 3
