"""Queries that need several passes over joined facts compute them once."""

from redpencil.operators import recommend
from redpencil.plans import catalog
from test_catalog import FOLDER, last_execution, plans_since


def test_packet_manifest_joins_the_lines_once(spark):
    before = last_execution(spark)
    assert catalog.queries()["packet_manifest"](spark, FOLDER).count() == 4
    assert sum("/lineitem.parquet" in plan for plan in plans_since(spark, before)) == 1


def test_report_lines_reads_its_facts_once(spark, sample, tmp_path):
    path = f"file://{tmp_path}/facts"
    sample.selectExpr("*", "topic AS concept").write.parquet(path)
    facts, before = spark.read.parquet(path), last_execution(spark)
    lines = recommend.report_lines(facts)
    assert {r["section"] for r in lines.collect()} == {"Top issues", "Persistence", "Recommendations"}
    assert sum(str(tmp_path) in plan for plan in plans_since(spark, before)) == 1
