"""The parquet tables of the test data seen as deductions, raw records and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def _order_lines(spark: SparkSession, folder: str) -> DataFrame:
    lines = _table(spark, folder, "lineitem")
    orders = _table(spark, folder, "orders")
    parts = _table(spark, folder, "part")
    customers = _table(spark, folder, "customer")
    return (
        lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
        .join(parts, lines["l_partkey"] == parts["p_partkey"])
        .join(customers, orders["o_custkey"] == customers["c_custkey"])
    )


def deductions(spark: SparkSession, folder: str) -> DataFrame:
    """V1: canonical deductions from order lines."""
    return _order_lines(spark, folder).select(
        F.concat(F.lit("C"), "o_custkey").alias("student_id"),
        F.concat(F.lit("Y"), F.year("o_orderdate")).alias("exam_id"),
        F.concat(F.lit("L"), "l_linenumber").alias("question_id"),
        F.concat("p_brand", F.lit(" "), "p_type").alias("rubric_item"),
        F.col("l_quantity").alias("points_lost"),
        F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_type")).alias("topic"),
        F.when(F.col("c_nationkey") % 5 == 0, "").otherwise(F.col("c_mktsegment")).alias("section_id"),
        F.concat(F.lit("S"), "l_suppkey").alias("ta_id"),
    )


def brand_deductions(spark: SparkSession, folder: str) -> DataFrame:
    """V1 with the brand as rubric item and the topic as concept, for the risk frames."""
    lines = _order_lines(spark, folder)
    return lines.select(
        F.concat(F.lit("C"), "o_custkey").alias("student_id"),
        F.concat(F.lit("Y"), F.year("o_orderdate")).alias("exam_id"),
        F.concat(F.lit("L"), "l_linenumber").alias("question_id"),
        F.col("p_brand").alias("rubric_item"),
        F.col("l_quantity").alias("points_lost"),
        F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_type")).alias("concept"),
    )


def event_records(spark: SparkSession, folder: str) -> DataFrame:
    """V2 before normalisation: event rows under foreign headers, padded with stray whitespace."""
    events = _table(spark, folder, "events")
    k = F.get_json_object("props", "$.k").cast("int") % 20
    return events.select(
        F.concat(F.lit("  U"), "user_id", F.lit("\t")).alias("sid"),
        F.concat(F.lit("W"), F.weekofyear("ts"), F.lit(" ")).alias("exam"),
        F.col("event_type").alias("question"),
        F.concat(F.lit(" "), "event_type", F.lit(": \t "), k).alias("rubric"),
        F.concat(F.lit(" "), F.col("value").cast("string")).alias("loss"),
    )


def event_deductions(spark: SparkSession, folder: str) -> DataFrame:
    """V2: deductions without topic, section or grader."""
    events = _table(spark, folder, "events")
    k = F.get_json_object("props", "$.k").cast("int") % 20
    return events.select(
        F.concat(F.lit("U"), "user_id").alias("student_id"),
        F.concat(F.lit("W"), F.weekofyear("ts")).alias("exam_id"),
        F.col("event_type").alias("question_id"),
        F.concat("event_type", F.lit(":"), k).alias("rubric_item"),
        F.col("value").alias("points_lost"),
        F.lit("").alias("topic"),
        F.lit("").alias("section_id"),
        F.lit("").alias("ta_id"),
    )


def score_records(spark: SparkSession, folder: str) -> DataFrame:
    """V3 before mapping: score rows under spreadsheet headers; every seventh part has no maximum."""
    return _order_lines(spark, folder).select(
        F.col("c_name").alias("Student Name"),
        F.col("o_custkey").alias("Student ID"),
        F.col("o_orderpriority").alias("Assignment"),
        F.col("p_brand").alias("Rubric Item"),
        F.when(F.col("p_size") % 10 != 0, F.col("p_type")).alias("Category"),
        F.when(F.col("l_linenumber") != 7, F.col("l_quantity").cast("string")).otherwise("late").alias("Score"),
        F.when(F.col("l_partkey") % 7 != 0, F.lit(50)).alias("Max Score"),
        F.col("l_returnflag").alias("Comment"),
    )


def scores(spark: SparkSession, folder: str) -> DataFrame:
    """V3: the score table."""
    return _order_lines(spark, folder).select(
        F.col("o_custkey").cast("string").alias("student_id"),
        F.col("c_name").alias("student_name"),
        F.col("o_orderpriority").alias("assignment"),
        F.col("p_brand").alias("rubric_item"),
        F.when(F.col("p_size") % 10 != 0, F.col("p_type")).otherwise("Uncategorized").alias("category"),
        F.when(F.col("l_linenumber") != 7, F.col("l_quantity")).alias("score"),
        F.when(F.col("l_partkey") % 7 != 0, F.lit(50.0)).alias("max_score"),
        F.col("l_returnflag").alias("comment"),
    )


def page_urls(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "pages").select("page_id", "url")
