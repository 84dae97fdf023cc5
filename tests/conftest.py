import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DEDUCTIONS = """
u1,Fall,Q1,Unit missing,3.0,Units
u1,Spring,Q4,Unit missing,1.0,Units
u2,Fall,Q1,Unit missing,2.0,Units
u2,Spring,Q5,Sign flipped,2.5,Signs
u2,Summer,Q7,Unit missing,1.0,Units
u3,Fall,Q2,Sign flipped,1.5,Signs
u3,Summer,Q7,Sign flipped,0.5,Signs
u3,Summer,Q8,Graph unlabelled,1.0,Graphs
u4,Fall,Q2,Graph unlabelled,4.0,Graphs
u4,Spring,Q5,Unit missing,1.5,Units
u5,Spring,Q4,Step skipped,2.0,Steps
u5,Summer,Q8,Step skipped,3.0,Steps
u5,Summer,Q7,Rounding,0.5,Numbers
"""
CANONICAL_DDL = "student_id string, exam_id string, question_id string, rubric_item string, points_lost double, topic string"


@pytest.fixture(scope="session")
def spark():
    scratch = tempfile.mkdtemp(prefix="redpencil-tests-")
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.checkpoint.dir", f"file://{scratch}/shared")
        .config("spark.sql.warehouse.dir", f"file://{scratch}/warehouse")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sample(spark):
    from redpencil.operators.normalize import canonicalize

    rows = [line.split(",") for line in DEDUCTIONS.strip().splitlines()]
    return canonicalize(spark.createDataFrame([(*r[:4], float(r[4]), r[5]) for r in rows], CANONICAL_DDL))


@pytest.fixture(scope="session")
def persistence_rows(spark):
    shown = "a T1 Axis,a T2 Axis,b T1 Axis,b T2 Axis,c T1 Axis,c T2 Scale,d T1 Scale,d T2 Scale,e T2 Scale"
    rows = [(student, exam, "Q", item, 1.0, "") for student, exam, item in map(str.split, shown.split(","))]
    return spark.createDataFrame(rows, CANONICAL_DDL)


def tuples(df):
    return [tuple(r) for r in df.collect()]
