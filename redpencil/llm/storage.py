"""Intermediate tables in the folder that all executors share, and row identity for documents.

Intermediate results are parquet files, so a lost executor costs a re-read and never a recomputation of what
came before. The folder is the one named in ``spark.checkpoint.dir``; where that is unset (local tests), the
warehouse folder is used.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_path(spark: SparkSession, name: str) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/redpencil-llm/{uuid.uuid4().hex}-{name}"


def store(df: DataFrame, name: str) -> DataFrame:
    """Compute once, write to the shared folder, and return the table read back."""
    return store_at(df, name)[0]


def store_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As ``store``, with the path, so that ``discard`` can free the space when the table is used up."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Free an intermediate table: overwriting it with no rows removes its files through Spark's own writer."""
    spark.createDataFrame([], "gone int").write.mode("overwrite").parquet(path)


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_key(text: str | Column = "text") -> Column:
    """Tells apart rows that share a doc_id but not a text. A null text has a key of its own."""
    column = F.col(text) if isinstance(text, str) else text
    return F.xxhash64(column, column.isNull())


def without_rows(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` without the rows whose (doc_id, text_key) is in ``dropped``; columns and other rows stay as they are.

    Always a merge by shuffle, as what is dropped grows with the corpus. Rows without a doc_id are never dropped.
    """
    id_name, key_name = fresh_name(docs, "_dropped_id"), fresh_name(docs, "_dropped_key")
    gone = dropped.select(F.col("doc_id").alias(id_name), F.col("text_key").alias(key_name))
    same = (F.col("doc_id") == F.col(id_name)) & (text_key() == F.col(key_name))
    return docs.join(gone.hint("merge"), same, "left_anti")
