"""CSV and JSON in and out. Text columns stay text: types are settled by the normaliser, never inferred."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from redpencil.functions.text import safe_name
from redpencil.operators.concepts import clean_concept_map, invalid_entries, valid_entries
from redpencil.operators.normalize import ColumnMapping, Normalized, canonicalize, normalize
from redpencil.operators.shared import materialize
from redpencil.schemas import empty
from redpencil.sources.records import has_broken_lines, read_records

# Texts that a persisted dataset reads as missing.
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
ENTRY_DDL = "pos int, rubric_item string, concept string"
MAP_DDL = "rubric_item string, concept string"
# Forms of a concept-map file: JSON lines of entries, which many tasks write and read, or one JSON object.
FORMATS = ("lines", "object")


def read_csv(spark: SparkSession, path: str, multiline: bool | None = None) -> DataFrame:
    """All columns as text, empty fields as empty text; ``None`` and ``NA`` stay what they are.

    Records may go over line breaks inside quotes, and one file is read by many tasks even so. ``multiline`` says
    whether there are any; where it is left open, the lines are looked through until one is found.
    """
    if multiline is None:
        multiline = has_broken_lines(spark, path)
    if multiline:
        return read_records(spark, path).na.fill("")
    return spark.read.option("header", True).option("escape", '"').csv(path).na.fill("")


def write_csv(df: DataFrame, path: str) -> str:
    writer = df.write.mode("errorifexists").option("header", True).option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


def load_and_normalize(
    spark: SparkSession,
    path: str,
    mapping: ColumnMapping | None = None,
    infer_mapping: bool = True,
    check: str = "inline",
    multiline: bool | None = None,
) -> Normalized:
    return normalize(read_csv(spark, path, multiline), mapping, infer_mapping, check)


def read_scores(spark: SparkSession, path: str, multiline: bool | None = None) -> DataFrame:
    """A score file: as ``read_csv``, with the usual texts for missing entries read as null."""
    return _missing_to_null(read_csv(spark, path, multiline))


def persist_dataset(df: DataFrame, path: str) -> str:
    """Write a dataset in canonical form. A row that fails the checks fails the write, in the same pass."""
    return write_csv(canonicalize(df, check="inline"), path)


def load_persisted_dataset(spark: SparkSession, path: str, check: str = "inline", multiline: bool | None = None) -> DataFrame:
    return canonicalize(_missing_to_null(read_csv(spark, path, multiline)), check)


def write_packet(artifacts: Mapping[str, DataFrame], folder: str) -> DataFrame:
    """Write every table to its own CSV folder; rows (artifact, file, rows) of those that have rows.

    Each table is computed once and counted while it is written. The folder of a table without rows holds no row and
    is not listed.
    """
    spark = next(iter(artifacts.values())).sparkSession if artifacts else SparkSession.active()
    names = spark.createDataFrame([(a,) for a in artifacts], "artifact string")
    safe = {r["artifact"]: r["file"] for r in names.select("artifact", safe_name(F.concat("artifact", F.lit(".csv"))).alias("file")).collect()}
    written = []
    for name, table in artifacts.items():
        if safe[name] is None:
            raise ValueError(f"Not an acceptable export name: {name}")
        path, seen = f"{folder.rstrip('/')}/{safe[name]}", Observation()
        write_csv(table.observe(seen, F.count(F.lit(1)).alias("rows")), path)
        rows = seen.get["rows"]
        if rows:
            written.append((name, safe[name], rows))
    return spark.createDataFrame(written, "artifact string, file string, rows bigint")


def read_concept_entries(spark: SparkSession, path: str, format: str = "lines") -> DataFrame:
    """Raw (pos, rubric_item, concept) entries of a map file in the named format; a missing file has none.

    One JSON object cannot be split, so a file of that format is read by one task.
    """
    _known(format)
    try:
        if format == "lines":
            return spark.read.schema(ENTRY_DDL).json(path)
        whole = spark.read.text(path, wholetext=True)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return empty(spark, ENTRY_DDL)
        raise
    parsed = whole.filter(F.trim("value") != "").select(F.from_json("value", "map<string,string>").alias("m"))
    if parsed.filter(F.col("m").isNull()).limit(1).count() or parsed.isEmpty():
        raise ValueError("A concept map must be a JSON object of rubric item to concept")
    return parsed.select(F.posexplode("m").alias("pos", "rubric_item", "concept"))


def load_concept_map(spark: SparkSession, path: str, format: str = "lines") -> DataFrame:
    """Rows (rubric_item, concept); placeholders are dropped, a missing file is an empty map."""
    return valid_entries(clean_concept_map(read_concept_entries(spark, path, format)))


def save_concept_map(entries: DataFrame, path: str, format: str = "lines") -> DataFrame:
    """Write a map in the named format unless one of its (pos, rubric_item, concept) entries is invalid; returns it.

    The error gives the number of invalid entries; ``invalid_entries(clean_concept_map(entries))`` has them.
    An object is put together in one task, as its format asks; JSON lines are written by many.
    """
    _known(format)
    cleaned = materialize(clean_concept_map(entries))
    wrong = invalid_entries(cleaned).count()
    if wrong:
        raise ValueError(f"The map has {wrong} invalid concept values; invalid_entries() lists them")
    valid = valid_entries(cleaned)
    if format == "object":
        pairs = F.array_sort(F.collect_list(F.struct("rubric_item", "concept")))
        text = valid.agg(F.to_json(F.map_from_entries(pairs)).alias("value"))
        text.coalesce(1).write.mode("overwrite").text(path)
    else:
        valid.select(F.lit(0).alias("pos"), "rubric_item", "concept").write.mode("overwrite").json(path)
    return valid


def _known(format: str) -> None:
    if format not in FORMATS:
        raise ValueError(f"A concept map is written as one of {FORMATS}, not {format!r}")


def _missing_to_null(df: DataFrame) -> DataFrame:
    return df.select(*[F.when(~F.col(f"`{c}`").isin(MISSING_TOKENS), F.col(f"`{c}`")).alias(c) for c in df.columns])
