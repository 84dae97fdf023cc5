"""CSV with line breaks inside quotes: against the csv module, over block bounds, and through the dataset functions."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from conftest import tuples
from redpencil.operators.shared import scratch_path
from redpencil.sources import files, records


def by_module(text):
    rows = [r for r in csv.reader(io.StringIO(text, newline="")) if r]
    width = len(rows[0])
    return sorted(tuple((r + [""] * width)[:width]) for r in rows[1:])


def written(tmp_path, text, name="in.csv"):
    path = tmp_path / name
    path.write_bytes(text.encode())
    return str(path)


CASES = {
    "plain": "a,b\n1,2\n3,4\n",
    "break": 'a,b\n"x\ny",2\n3,"z\n\n"\n',
    "doubled": 'a,b\n"x ""q""\n""",2\n"""","""\n"""\n',
    "separators": 'a,b\n"x,\n,y",",\n"\n1,2\n',
    "stray quote": 'a,b\n5" pipe,6" pipe\n"x\ny",7"\n1,2\n',
    "carriage returns": 'a,b\r\n"x\r\ny",2\r\n3,4\r\n',
    "short and blank": 'a,b\n\n"x\ny"\n\n1,2\n',
    "header over lines": 'a,"b\nc"\n1,"2\n3"\n',
    "no last break": 'a,b\n1,"x\ny"',
    "empty quoted": 'a,b\n"",""\n"\n",1\n',
    "no rows": "a,b\n",
}


@pytest.mark.parametrize("name", CASES)
def test_cases(spark, tmp_path, name):
    text = CASES[name]
    path = written(tmp_path, text)
    header = next(csv.reader(io.StringIO(text, newline="")))
    for way in (None, True):
        read = files.read_csv(spark, path, way)
        assert read.columns == header
        assert sorted(tuples(read)) == by_module(text)


@pytest.mark.parametrize("seed", range(3))
def test_many_blocks(spark, tmp_path, seed):
    """One file cut into many blocks, with records over several lines and blocks, next to a second file."""
    rng = random.Random(seed)
    cells = ["x", 'q"', ",", "\n", "long " * 40, '""', " ", "ß", "\r\n"]
    texts = []
    for n in range(2):
        out = io.StringIO(newline="")
        writer = csv.writer(out, lineterminator="\n")
        writer.writerow(["id", "a", "b"])
        for k in range(400):
            size = 60 if k % 97 == 5 else 4
            writer.writerow([f"{n}-{k}", *["".join(rng.choices(cells, k=rng.randrange(size))) for _ in range(2)]])
        texts.append(out.getvalue())
    folder = tmp_path / "many"
    folder.mkdir()
    for n, text in enumerate(texts):
        (folder / f"part-{n}.csv").write_bytes(text.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = records._lines(spark, str(folder))
        assert lines.rdd.getNumPartitions() > 10
        assert lines.select("file", "block").distinct().count() > 10
        got = sorted(tuples(files.read_csv(spark, str(folder))))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == sorted(by_module(texts[0]) + by_module(texts[1]))


def test_text_after_a_closing_quote_ends_with_the_line(spark, tmp_path):
    path = written(tmp_path, 'a,b\n"x"y,"p\nq"r\n1,"2"3"\n4,5\n')
    texts = {r["record"] for r in records.records(spark, path).collect()}
    assert texts == {"a,b", '"x"y,"p\nq"r', '1,"2"3"', "4,5"}


def test_open_quote_is_rejected(spark, tmp_path):
    path = written(tmp_path, 'a,b\n1,2\n"x,y\n3,4\n')
    with pytest.raises(ValueError, match="inside quotes"):
        files.read_csv(spark, path)


def test_round_trip_of_datasets(spark, sample):
    texts = ["two\nlines", 'said "x",\nthen ""', ",\n,", "a\r\nb", 'ends in "quote"', '"\n"']
    chosen = F.element_at(F.array(*map(F.lit, texts)), F.pmod(F.xxhash64("student_id", "exam_id", "rubric_item"), F.lit(len(texts))).cast("int") + 1)
    odd = sample.withColumn("topic", chosen)
    path = files.persist_dataset(odd, scratch_path(spark, "odd.csv"))
    assert sorted(tuples(files.load_persisted_dataset(spark, path))) == sorted(tuples(odd))
    assert sorted(tuples(files.load_and_normalize(spark, path).data)) == sorted(tuples(odd))


def test_scores_over_lines(spark, tmp_path):
    path = written(tmp_path, 'Student ID,Comment\ns1,"first\nsecond"\ns2,NA\n')
    assert sorted(tuples(files.read_scores(spark, path))) == [("s1", "first\nsecond"), ("s2", None)]


def test_plain_files_are_read_without_gluing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(records, "records", lambda *a: pytest.fail("glued"))
    path = written(tmp_path, 'a,b\n"x, y",2\n')
    assert tuples(files.read_csv(spark, path)) == [("x, y", "2")]


def test_records_are_parsed_once_and_lines_are_not_shuffled(spark, tmp_path, capsys):
    path = written(tmp_path, 'a,b,c\n"x\ny",2,3\n1,"2\n3",4\n5,6,7\n')
    read = files._missing_to_null(files.read_csv(spark, path, True))
    assert sorted(tuples(read)) == [("1", "2\n3", "4"), ("5", "6", "7"), ("x\ny", "2", "3")]
    read.explain()
    plan = capsys.readouterr().out
    assert plan.count("from_csv") == 1 and "Window" not in plan


def test_a_quote_open_over_whole_blocks(spark, tmp_path):
    """One field goes over many blocks, with lines in it that look like records; a header after blank lines."""
    long = "\n".join(f'{k},x""y' for k in range(3000))
    path = written(tmp_path, f'\n  \na,b\n1,"{long}"\n2,"p\nq"\n3,4\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        found = records.records(spark, path).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(r["record"] for r in found) == sorted(["a,b", f'1,"{long}"', '2,"p\nq"', "3,4"])
    assert [r["record"] for r in found if r["first"]] == ["a,b"]
