"""Quality by co-training: a classifier of the text and one of the metadata teach each other.

The text view has statistics of the content (characters, words, lines, repetition); the metadata view has what is
known without reading it (language, source, length, the shape of its page). Each view starts from the
labelled rows. In each round, both score all documents without a label, and the documents of which one view is
confident become training rows, with that label, for the other. At the end the scores of both views, calibrated
on the labelled rows, are combined by a last regression.

The views are fitted by Spark on all their rows: labels and pseudo-labels come from the whole table, and
only the weights, a bounded number, reach the driver. Features are made once and kept.

Defined results: a null or empty text has the statistics of no characters. Labels that contradict each other count as
low quality; a null label is none. A null source, language or length is a value of its own. With labels of one class
only, or none, every score is the share of good labels (0.5 without any). Rows that repeat are scored each. An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redpencil.llm.storage import store, text_key
from redpencil.llm.words import pieces

FOLDS = 5
ROUNDS = 2
# A view teaches the other with documents it scores beyond these shares of certainty.
CONFIDENT = 0.97
# Weight of a pseudo-label beside a label.
PSEUDO_WEIGHT = 0.1
HASHED = 64
PENALTY = 1e-3
_LETTERS = re.compile(r"[^\W\d_]+")


def text_features(text: str) -> list[float]:
    """Statistics of a text; all are shares or logarithms, so that long texts do not stand out by size."""
    n = len(text)
    if not n:
        return [0.0] * 14
    words = text.split()
    lines = text.split("\n")
    seen = Counter(words)
    runs = sum(a == b for a, b in zip(words, words[1:]))
    letters = sum(map(len, _LETTERS.findall(text)))
    m = max(1, len(words))
    return [
        math.log1p(len(words)) / 5,
        sum(map(len, words)) / m / 10,
        len(seen) / m,
        max(seen.values(), default=0) / m,
        runs / m,
        letters / n,
        sum(map(str.isupper, text)) / n,
        sum(map(str.isdigit, text)) / n,
        sum(not (c.isalnum() or c.isspace()) for c in text) / n,
        1 - len(set(lines)) / len(lines),
        math.log1p(n / len(lines)) / 5,
        sum(w[-1] in ".!?" for w in words) / m,
        sum(w == "|" for w in words) / m,
        sum(not w[-1].isalnum() and not w[-2:-1].isalnum() for w in words if len(w) > 2) / m,
    ]


def metadata_features(source: str | None, lang: str | None, n_chars: int | None) -> list[float]:
    """Hashed source and language, apart and together, and the length by decades."""
    out = [0.0] * (HASHED + 3)
    for value in (f"s{source}", f"l{lang}", f"{source}/{lang}", f"n{-1 if n_chars is None else int(math.log2(n_chars + 1))}"):
        out[zlib.crc32(value.encode()) % HASHED] += 1.0
    size = math.log1p(max(0, n_chars or 0)) / 10
    out[HASHED:] = [size, size * size, float(n_chars is None)]
    return out


def featured(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text_key, text_view, page_view)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "text_key", "text_view", "page_view"]
    schema = f"doc_id {id_type}, text_key bigint, text_view array<double>, page_view array<double>"

    def run(batches):
        kind = pa.list_(pa.float64())
        for whole in batches:
            for batch in pieces(whole):
                text = [text_features(t.as_py() or "") for t in batch.column("text")]
                page = [metadata_features(*row) for row in zip(*(batch.column(c).to_pylist() for c in ("source", "lang", "n_chars")))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(text, kind), pa.array(page, kind)], names)

    return docs.select("doc_id", text_key().alias("text_key"), "text", "source", "lang", "n_chars").mapInArrow(run, schema)


def is_held_out(folds: int = FOLDS) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds)) == 0, F.lit(True))


def _fit(rows: DataFrame, view: str) -> tuple[np.ndarray, float]:
    """Weights of a logistic regression on (view, label, weight), fitted by Spark."""
    table = rows.select(array_to_vector(view).alias("features"), F.col("label").cast("double"), "weight")
    model = LogisticRegression(labelCol="label", weightCol="weight", maxIter=40, regParam=PENALTY, tol=1e-5).fit(table)
    return model.coefficients.toArray(), float(model.intercept)


def _probability(view: str, weights: tuple[np.ndarray, float]) -> Column:
    coefficients, intercept = weights
    values = F.array(*[F.lit(float(c)) for c in coefficients])
    margin = F.aggregate(F.zip_with(F.col(view), values, lambda a, b: a * b), F.lit(intercept), lambda total, x: total + x)
    return 1 / (1 + F.exp(-margin))


def _taught(labelled: DataFrame, open_rows: DataFrame, teacher: Column, share: float) -> DataFrame:
    """The labelled rows, and the open rows of which the other view is confident.

    Confidence is read against the share of good labels, so that a rare class is taught as well.
    """
    bad_limit = (1 - CONFIDENT) + CONFIDENT * max(0.0, share - 0.5) * 0.5
    sure = open_rows.withColumn("p", teacher).filter((F.col("p") >= CONFIDENT) | (F.col("p") <= bad_limit))
    taught = sure.select("text_view", "page_view", (F.col("p") >= 0.5).cast("int").alias("label"), F.lit(PSEUDO_WEIGHT).alias("weight"))
    return labelled.select("text_view", "page_view", "label", F.lit(1.0).alias("weight")).unionByName(taught)


def co_train(rows: DataFrame, rounds: int = ROUNDS) -> tuple[tuple, tuple, tuple] | float:
    """Weights of both views and of their combination, or the share of good labels where nothing can be fitted.

    ``rows`` have (text_view, page_view, label); the label is null for documents to be taught from.
    """
    labelled = rows.filter(F.col("label").isNotNull())
    share = labelled.agg(F.avg("label")).first()[0]
    if share in (None, 0.0, 1.0):
        return 0.5 if share is None else share
    open_rows = rows.filter(F.col("label").isNull())
    start = labelled.withColumn("weight", F.lit(1.0))
    text, page = _fit(start, "text_view"), _fit(start, "page_view")
    for _ in range(rounds):
        for_text = _taught(labelled, open_rows, _probability("page_view", page), share)
        for_page = _taught(labelled, open_rows, _probability("text_view", text), share)
        text, page = _fit(for_text, "text_view"), _fit(for_page, "page_view")
    both = start.withColumn("views", F.array(*_margins(text, page)))
    return text, page, _fit(both, "views")


def _margins(text: tuple, page: tuple) -> list[Column]:
    out = []
    for view, weights in (("text_view", text), ("page_view", page)):
        p = F.least(F.greatest(_probability(view, weights), F.lit(1e-6)), F.lit(1 - 1e-6))
        out.append(F.log(p / (1 - p)))
    return out


def scores(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Rows (doc_id, text_key, held_out, text_score, page_score, score)."""
    known = labels.filter(F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("l_id")).agg(F.min("quality").cast("int").alias("label"))
    made = store(featured(docs), "quality-features")
    joined = made.join(known, F.col("doc_id") == F.col("l_id"), "left").drop("l_id").withColumn("held_out", is_held_out())
    rows = store(joined.withColumn("label", F.when(~F.col("held_out"), F.col("label"))), "quality-rows")
    found = co_train(rows, rounds)
    if isinstance(found, float):
        constant = F.lit(found)
        return rows.select("doc_id", "text_key", "held_out", *[constant.alias(c) for c in ("text_score", "page_score", "score")])
    text, page, both = found
    return rows.withColumn("views", F.array(*_margins(text, page))).select(
        "doc_id",
        "text_key",
        "held_out",
        _probability("text_view", text).alias("text_score"),
        _probability("page_view", page).alias("page_score"),
        _probability("views", both).alias("score"),
    )


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (doc_id, held_out, score, text_score, page_score, predicted)."""
    return scores(docs, labels).select(
        "doc_id", "held_out", "score", "text_score", "page_score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
