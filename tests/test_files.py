import json

import pytest

from conftest import tuples
from redpencil.operators import metrics
from redpencil.operators.shared import scratch_path
from redpencil.schemas import DEDUCTION_COLUMNS
from redpencil.sources import files


def test_csv_keeps_texts(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('student_id,exam_id,question_id,rubric_item,points_lost,section_id\nu1,E1,Q1,"A, ""b""",1,\nu2,E1,Q2,None,2, NA\n')
    rows = tuples(files.read_csv(spark, str(path)))
    assert rows[0] == ("u1", "E1", "Q1", 'A, "b"', "1", "") and rows[1][3] == "None"
    out = files.load_and_normalize(spark, str(path))
    assert out.mapping is None and out.data.columns == DEDUCTION_COLUMNS
    assert out.data.collect()[1]["section_id"] == "NA"
    with pytest.raises(ValueError, match="rubric_item"):
        files.load_persisted_dataset(spark, str(path), check="scan")


def test_round_trip(spark, sample):
    odd = sample.unionByName(sample.limit(1).na.replace({"u1": 'a "quoted", id'}, subset=["student_id"]))
    path = files.persist_dataset(odd, scratch_path(spark, "set.csv"))
    assert sorted(tuples(files.load_persisted_dataset(spark, path))) == sorted(tuples(odd))
    with pytest.raises(Exception, match="non-negative"):
        files.persist_dataset(sample.withColumn("points_lost", -metrics.F.col("points_lost")), scratch_path(spark, "bad.csv"))


def test_score_file_reads_missing_tokens_as_null(spark, tmp_path):
    path = tmp_path / "scores.csv"
    path.write_text("Student ID,Score\ns1,NA\ns2,3\n")
    assert tuples(files.read_scores(spark, str(path))) == [("s1", None), ("s2", "3")]


def test_concept_map_files(spark, tmp_path):
    path = tmp_path / "map.json"
    assert files.load_concept_map(spark, str(path)).count() == 0
    path.write_text(json.dumps({"Item A": "Valid", "Item B": "none", "Item C": True, "Item D": None}, indent=2))
    assert tuples(files.load_concept_map(spark, str(path), "object")) == [("Item A", "Valid")]
    path.write_text(json.dumps({"rubric_item": "Alpha", "concept": "Beta"}))
    assert sorted(tuples(files.load_concept_map(spark, str(path), "object"))) == [("concept", "Beta"), ("rubric_item", "Alpha")]
    path.write_text('{"rubric_item": "x"}\n{"rubric_item": "y", "concept": "Why"}\n')
    assert tuples(files.load_concept_map(spark, str(path))) == [("y", "Why")]
    path.write_text("[1, 2]")
    with pytest.raises(ValueError):
        files.load_concept_map(spark, str(path), "object")
    with pytest.raises(ValueError, match="lines"):
        files.load_concept_map(spark, str(path), "yaml")
    target = tmp_path / "saved.json"
    bad = spark.createDataFrame([(0, "Item A", "yes"), (1, "Item B", "Valid")], files.ENTRY_DDL)
    with pytest.raises(ValueError, match="1 invalid"):
        files.save_concept_map(bad, str(target))
    assert not target.exists()
    good = spark.createDataFrame([(0, "Item B", "Ünï \"x\""), (1, "Item A", "Other")], files.ENTRY_DDL)
    for form in files.FORMATS:
        files.save_concept_map(good, str(target), form)
        assert sorted(tuples(files.load_concept_map(spark, str(target), form))) == [("Item A", "Other"), ("Item B", "Ünï \"x\"")]


def test_packet_skips_empty_tables(spark, sample):
    folder = scratch_path(spark, "packet")
    tables = {"a/b": metrics.summarize_errors(sample), "empty": sample.limit(0), "exams": metrics.exam_breakdown(sample)}
    assert tuples(files.write_packet(tables, folder)) == [("a/b", "a_b.csv", 5), ("exams", "exams.csv", 3)]
    assert files.read_csv(spark, f"{folder}/exams.csv").count() == 3
    with pytest.raises(ValueError):
        files.write_packet({"../up": sample}, folder)
