import pytest

from conftest import CANONICAL_DDL, tuples
from redpencil.operators import cohorts, metrics


def test_overall_summary(sample):
    assert tuples(metrics.overall_summary(sample)) == [(13, 5, 3, 6, pytest.approx(23.5 / 13))]


def test_rubric_item_stats(sample):
    rows = {r[0]: r[2:] for r in tuples(metrics.rubric_item_stats(sample))}
    assert rows["Unit missing"] == (5, pytest.approx(1.7), 1.5, pytest.approx(0.56**0.5), 8.5)
    assert rows["Rounding"] == (1, 0.5, 0.5, 0.0, 0.5)
    assert rows["Graph unlabelled"] == (2, 2.5, 2.5, 1.5, 5.0)
    assert rows["Step skipped"] == (2, 2.5, 2.5, 0.5, 5.0)


def test_rows_without_keys_stay_in_the_item_stats(spark):
    rows = [("s", "E", "Q", "A", 1.0, None), ("s", "E", "Q", "A", 2.0, ""), ("s", "E", "Q", None, 4.0, "T"), ("s", "E", "Q", "A", 8.0, "T")]
    got = {(r[0], r[1]): (r[2], r[6]) for r in tuples(metrics.rubric_item_stats(spark.createDataFrame(rows, CANONICAL_DDL)))}
    assert got == {("A", ""): (2, 3.0), ("", "T"): (1, 4.0), ("A", "T"): (1, 8.0)}


def test_totals_are_conserved(sample):
    for table, column in [
        (metrics.summarize_errors(sample), "points_lost_total"),
        (metrics.error_by_exam(sample), "points_lost_total"),
        (metrics.exam_breakdown(sample), "total_points_lost"),
        (metrics.student_summary(sample), "total_points_lost"),
    ]:
        assert table.agg({column: "sum"}).first()[0] == pytest.approx(23.5)


def test_exam_breakdown_and_changes(sample):
    assert tuples(metrics.exam_breakdown(sample)) == [
        ("Fall", 4, 2, 10.5, 2.625),
        ("Spring", 4, 2, 7.0, 1.75),
        ("Summer", 3, 2, 6.0, 1.2),
    ]
    assert [r[5:] for r in tuples(cohorts.exam_changes(sample))] == [
        (None, None),
        (-3.5, pytest.approx(-1 / 3)),
        (-1.0, pytest.approx(-1 / 7)),
    ]
    assert [r[5:] for r in tuples(cohorts.exam_change_table(sample))] == [(0.0, 0.0), (-3.5, -0.333), (-1.0, -0.143)]


def test_manual_order_is_honoured_and_unlisted_exams_stay(sample):
    order = ["Summer", "Fall"]
    assert [r["exam_id"] for r in cohorts.exam_changes(sample, order).collect()] == ["Summer", "Fall", "Spring"]
    first = [r["exam_id"] for r in metrics.student_summary(sample, order).collect()]
    assert first == ["Summer"] * 3 + ["Fall"] * 4 + ["Spring"] * 4
    assert tuples(cohorts.exam_order(sample, order)) == [("Summer", 0), ("Fall", 1)]
    assert tuples(cohorts.exam_order(sample)) == [("Fall", 0), ("Spring", 1), ("Summer", 2)]


def test_growth_from_zero(spark):
    rows = [("s", e, "Q", "A", p, "") for e, p in [("E1", 0.0), ("E2", 0.0), ("E3", 2.0)]]
    out = cohorts.exam_changes(spark.createDataFrame(rows, CANONICAL_DDL))
    assert [r["pct_change_vs_prev"] for r in out.collect()] == [None, None, float("inf")]


def test_score_distribution(spark, sample):
    rows = tuples(metrics.score_distribution(sample, 3))
    assert [r[1] for r in rows] == ["0.5-1.7", "1.7-2.8", "2.8-4.0"]
    assert [r[4] for r in rows] == [7, 3, 3]
    assert rows[-1][3] == pytest.approx(4.0035)
    same = spark.createDataFrame([(4.0,)] * 3, "points_lost double")
    assert [(pytest.approx(r[2]), r[4]) for r in tuples(metrics.score_distribution(same, 2))] == [(3.996, 0), (4.0, 3)]
    zero = spark.createDataFrame([(0.0,)], "points_lost double")
    assert [r[4] for r in tuples(metrics.score_distribution(zero, 2))] == [0, 1]
    assert metrics.score_distribution(zero.limit(0)).count() == 0


def test_group_comparison(spark, sample):
    ddl = CANONICAL_DDL + ", section_id string, ta_id string"
    df = spark.createDataFrame(
        [
            ("m", "Fall", "Q1", "Axis", 6.0, "", "North", "Kim"),
            ("m", "Fall", "Q3", "Scale", 1.0, "", "North", "Lee"),
            ("n", "Fall", "Q1", "Axis", 3.0, "", "North", "Lee"),
            ("o", "Spring", "Q2", "Axis", 2.0, "", "South", "Kim"),
            ("p", "Spring", "Q2", "Scale", 0.5, "", None, " "),
        ],
        ddl,
    )
    assert tuples(metrics.group_comparison(df, "section_id")) == [
        ("North", 3, 2, 10.0, 5.0, pytest.approx(10 / 3)),
        ("South", 1, 1, 2.0, 2.0, 2.0),
        ("Unassigned", 1, 1, 0.5, 0.5, 0.5),
    ]
    tas = tuples(metrics.course_group_stats(df, "ta_id", "TA"))
    assert [r[0] for r in tas] == ["Kim", "Lee", "Unassigned TA"]
    assert tuples(metrics.disparity_gap(df, "ta_id", "TA")) == [(3.5,)]
    assert metrics.group_comparison(sample, "section_id").count() == 0
    assert metrics.group_comparison(sample, "room").columns[0] == "room"


def test_kpis(sample):
    row = metrics.kpis(sample).first()
    assert row["avg_points_per_student"] == pytest.approx(4.7)
    assert row["std_points_per_student"] == pytest.approx(1.06**0.5)
    scoped = metrics.kpis(sample, "Graph unlabelled").first()
    assert (scoped["rows"], scoped["rubric_items"], scoped["total_points_lost"]) == (13, 1, 5.0)


def test_pivot_and_orderings(sample):
    rows = tuples(metrics.rubric_exam_pivot(sample))
    assert rows[0] == ("Graph unlabelled", 1, 0, 1)
    assert metrics.errors_by_count(sample).first()["rubric_item"] == "Unit missing"
    assert [r[0] for r in tuples(metrics.errors_by_points(sample))][:2] == ["Unit missing", "Graph unlabelled"]


def test_empty_input_keeps_the_schema(sample):
    none = sample.limit(0)
    for table in [
        metrics.rubric_item_stats(none), metrics.exam_breakdown(none), cohorts.exam_changes(none),
        metrics.student_summary(none), metrics.summarize_errors(none), cohorts.persistence(none),
        metrics.group_comparison(none, "section_id"),
    ]:
        assert table.count() == 0 and len(table.columns) > 3


def test_persistence(sample, persistence_rows):
    assert tuples(cohorts.persistence(sample)) == [
        ("Graph unlabelled", 1, 0, 0.0),
        ("Sign flipped", 1, 1, 1.0),
        ("Unit missing", 2, 2, 1.0),
    ]
    assert tuples(cohorts.persistence(persistence_rows, ["T1", "T2"])) == [("Axis", 3, 2, 2 / 3), ("Scale", 1, 1, 1.0)]
    assert tuples(cohorts.persistence(persistence_rows, ["T2", "T1"])) == [("Axis", 2, 2, 1.0), ("Scale", 3, 1, 1 / 3)]
    assert tuples(cohorts.persistence(persistence_rows, ["Nope"])) == [("Axis", 3, 2, 2 / 3), ("Scale", 1, 1, 1.0)]
    assert tuples(cohorts.persistence(persistence_rows, ["T2"])) == [("Axis", 2, 0, 0.0), ("Scale", 3, 0, 0.0)]
    by_concept = persistence_rows.withColumnRenamed("rubric_item", "concept")
    assert tuples(cohorts.concept_persistence(by_concept)) == [("Scale", 1, 1, 1.0), ("Axis", 3, 2, 2 / 3)]
    assert cohorts.concept_persistence(by_concept, ["T2"]).count() == 0


def test_median_of_a_group_that_spans_ranges(spark):
    import statistics

    from pyspark.sql import functions as F

    from redpencil.operators.shared import medians

    # One group holds nearly all values.
    df = spark.range(20_000).select(
        F.when(F.col("id") % 50 == 0, "small").otherwise("hot").alias("g"),
        (F.pmod(F.xxhash64("id"), F.lit(100_003)) / 8).alias("v"),
    )
    counts = df.groupBy("g", "v").agg(F.count("*").alias("n"))
    got = dict(tuples(medians(counts, ["g"], "v", "n", "m")))
    rows = tuples(df)
    assert got == {g: statistics.median(v for k, v in rows if k == g) for g in ("hot", "small")}
