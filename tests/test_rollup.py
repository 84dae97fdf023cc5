"""Summaries rolled up from one base against the direct ones, for sparse, mixed and dense student sets."""

import pytest
from pyspark.sql import functions as F

from conftest import CANONICAL_DDL, tuples
from redpencil.operators import metrics, recommend, rollup, shared

GROUPED_DDL = CANONICAL_DDL + ", section_id string, concept string"


@pytest.fixture(scope="module")
def facts(spark):
    """A student with a third of the rows, one exam and one item with most of the others, null and blank keys, null points."""
    n = F.col("id")
    return spark.range(60_000).select(
        F.when(n % 3 == 0, "hot").when(n % 997 == 0, None).otherwise(F.concat(F.lit("s"), F.pmod(F.xxhash64("id"), F.lit(40_000)))).alias("student_id"),
        F.when(n % 11 == 0, None).when(n % 5 == 0, "E2").otherwise("E1").alias("exam_id"),
        F.concat(F.lit("Q"), n % 7).alias("question_id"),
        F.when(n % 4 > 0, "often").otherwise(F.concat(F.lit("i"), n % 300)).alias("rubric_item"),
        F.when(n % 13 > 0, (n % 16) / 4.0).alias("points_lost"),
        F.lit("").alias("topic"),
        F.when(n % 6 == 0, " ").when(n % 6 == 1, None).when(n % 6 == 2, " A ").otherwise("A").alias("section_id"),
        F.when(n % 9 == 0, "").when(n % 2 == 0, " c").otherwise("d").alias("concept"),
    )


@pytest.mark.parametrize("dense_from", [1, 40, 512, 10**9])
def test_equals_the_direct_summaries(facts, dense_from):
    base = rollup.roll_up(facts, ["exam_id", "rubric_item", "section_id", "concept"], dense_from)
    assert base.sparse.isEmpty() == (dense_from == 1) and base.dense.isEmpty() == (dense_from == 10**9)
    pairs = [
        (rollup.overall_summary(base), metrics.overall_summary(facts)),
        (rollup.exam_breakdown(base), metrics.exam_breakdown(facts)),
        (rollup.summarize_errors(base), metrics.summarize_errors(facts)),
        (rollup.group_comparison(base, "section_id"), metrics.group_comparison(facts, "section_id")),
        (rollup.concept_stats(base), recommend.concept_stats(facts)),
    ]
    for got, want in pairs:
        assert got.dtypes == want.dtypes
        assert tuples(got) == tuples(want)
    got, want = tuples(rollup.kpis(base))[0], tuples(metrics.kpis(facts))[0]
    assert got == pytest.approx(want)


def test_bitmaps_over_several_buckets(spark):
    """70,000 students lie in three buckets; every exam has its own half, every item has all."""
    df = spark.range(70_000).selectExpr(
        "CAST(id AS string) AS student_id", "IF(id % 2 = 0, 'a', 'b') AS exam_id", "'q' AS question_id", "'x' AS rubric_item", "1.0D AS points_lost"
    )
    base = rollup.roll_up(df)
    assert base.sparse.isEmpty() and base.dense.count() == 6
    assert tuples(rollup.students(base)) == [(70_000,)]
    assert sorted(tuples(rollup.students(base, ["exam_id"]))) == [("a", 35_000), ("b", 35_000)]


def test_facts_are_read_once(spark, facts, tmp_path):
    path = f"file://{tmp_path}/facts"
    facts.write.parquet(path)
    base = rollup.roll_up(spark.read.parquet(path), ["exam_id", "rubric_item", "section_id", "concept"])
    for table in [*rollup.packet_tables(base, ["section_id"]).values(), rollup.overall_summary(base), rollup.kpis(base)]:
        assert str(tmp_path) not in "".join(table.inputFiles())


def test_no_rows_and_only_null_students(spark):
    none = spark.createDataFrame([], GROUPED_DDL)
    base = rollup.roll_up(none, ["exam_id", "rubric_item", "section_id", "concept"])
    assert tuples(rollup.overall_summary(base)) == tuples(metrics.overall_summary(none))
    assert tuples(rollup.kpis(base)) == tuples(metrics.kpis(none))
    assert all(t.isEmpty() for t in rollup.packet_tables(base, ["section_id"]).values())
    nobody = spark.createDataFrame([(None, "e", "q", "i", 1.0, "", "A", "c")], GROUPED_DDL)
    base = rollup.roll_up(nobody, ["exam_id", "rubric_item"])
    assert tuples(rollup.summarize_errors(base)) == tuples(metrics.summarize_errors(nobody)) == [("i", 1, 0, 1.0, 1.0)]
    assert rollup.group_comparison(base, "section_id").isEmpty()


def test_pivot_as_a_map(facts):
    wide = {r["rubric_item"]: r.asDict() for r in metrics.rubric_exam_pivot(facts).collect()}
    maps = tuples(metrics.rubric_exam_map(facts))
    assert len(maps) == len(wide)
    for item, counts in maps:
        assert {e: n for e, n in wide[item].items() if e != "rubric_item" and n} == {"null" if e == "" else e: n for e, n in counts.items()}


def test_student_sets_hold_numbers_only(spark, facts):
    """However long the keys, a member of a cell is three numbers."""
    keys = ["exam_id", "rubric_item", "section_id", "concept"]
    base = rollup.roll_up(facts, keys, 40)
    assert base.sparse.columns == ["_cell", "_bucket", "_position"] and base.dense.columns == ["_cell", "_bucket", "_bits"]
    assert {t for _, t in base.sparse.dtypes} == {"bigint"}
    assert base.cells.count() == facts.select(*keys).distinct().count() == base.cells.select("_cell").distinct().count()
    pairs = facts.filter("student_id IS NOT NULL").select(*keys, "student_id").distinct().count()
    assert base.sparse.count() + base.dense.selectExpr("sum(bitmap_count(_bits))").first()[0] == pairs


def test_no_keys(facts):
    base = rollup.roll_up(facts, [], 40)
    assert tuples(rollup.students(base)) == [(facts.select("student_id").distinct().count() - 1,)]


@pytest.fixture
def dealt(monkeypatch):
    """The tables that are dealt over tasks, with a bound of 4,000 rows."""
    tables, spread = [], shared.dealt
    monkeypatch.setattr(shared, "ROWS_PER_TASK", 4_000)
    for module in (rollup, metrics):
        monkeypatch.setattr(module, "dealt", lambda stored, by: tables.append(spread(stored, by)) or tables[-1], raising=False)
    return tables


def by_item(facts):
    return sorted(tuples(facts.groupBy("rubric_item").agg(F.count("*"), F.count_distinct("student_id"), F.sum("points_lost"), F.avg("points_lost"))))


def test_the_base_is_grouped_in_tasks_of_few_rows(facts, dealt):
    """However many rows there are, a task groups a bounded number of them."""
    base = rollup.roll_up(facts, ["exam_id", "rubric_item", "section_id", "concept"])
    assert sorted(tuples(rollup.summarize_errors(base))) == by_item(facts)
    assert len(dealt) == 2 and all(d.rdd.getNumPartitions() == -(-d.count() // 4_000) > 2 for d in dealt)


def test_item_totals_are_grouped_in_tasks_of_few_rows(facts, dealt):
    assert sorted(tuples(metrics.errors_by_item(facts))) == by_item(facts)
    assert len(dealt) == 1 and dealt[0].rdd.getNumPartitions() == -(-dealt[0].count() // 4_000) > 2
    assert metrics.errors_by_item(facts.limit(0)).isEmpty() and dealt[1].rdd.getNumPartitions() == 1
