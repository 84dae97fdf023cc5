"""Exact top-k inner products by MaxScore over shards of postings.

Every component of a vector is a weighted term: dimension and sign. A shard (a bounded block of candidate rows) keeps
for each term the posting list of the rows that hold it, and the largest weight in it. For a query, a term of its own
sign can only add to the score, by at most query weight times largest weight; a term of the other sign can only take
away. With the k-th best score so far as the floor, the adding terms are split by rising bound: as long as the bounds
together stay under the floor, a row that holds nothing else cannot reach it, so these terms are non-essential. Only
the essential postings are traversed. The rows that remain competitive with all that is left are charged what takes
away, and are then probed for the non-essential terms, from the highest bound down, while they stay competitive.

Floors are carried from shard to shard within a task. They start from the scores in a small hashed part of the rows,
which changes how much is pruned and not what is found. The tasks' top rows are merged with a window per query.

Queries are worked on in blocks of at most ``QUERIES`` rows and ``INTEGERS`` components, so that what a task is sent
has a fixed size; the candidates are never moved.

Defined results: vectors that are null, or hold null, NaN or infinite components, take no part, nor do rows without an
id. Where vectors differ in length, missing components are zero. A row is its own candidate never, but rows that
repeat it are. Scores that might not fit 64 bits raise an error. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from redpencil.llm.storage import scratch_path, store
from redpencil.operators.shared import ordinals

K = 10
QUERIES = 2048
INTEGERS = 1 << 18
# Components of the candidates in a shard.
SHARD_INTEGERS = 1 << 19
# Rows that the first floors come from, about.
FIRST_ROWS = 8192


class Shard:
    """Postings of a block of rows: for each term the rows that hold it, their weights, and the largest weight."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, matrix: np.ndarray):
        self.rows, self.ids, self.matrix = rows, ids, matrix
        self.postings = {}
        for j in range(matrix.shape[1]):
            column = matrix[:, j]
            for sign in (1, -1):
                places = np.flatnonzero(column * sign > 0)
                weights = column[places] * sign
                self.postings[j, sign] = places, weights, int(weights.max(initial=0))

    def search(self, query: np.ndarray, floor: int | None, own: int) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) of all rows that score the floor or more, but for the row ``own``."""
        places, scores = self._competitive(query, floor)
        other = self.rows[places] != own
        return scores[other], self.ids[places[other]]

    def _competitive(self, query: np.ndarray, floor: int | None) -> tuple[np.ndarray, np.ndarray]:
        query = query[: self.matrix.shape[1]]
        if floor is None or floor <= 0:  # rows without any term of the query count as well
            return np.arange(len(self.rows)), self.matrix[:, : len(query)] @ query
        terms = []
        for j in np.flatnonzero(query).tolist():
            weight = int(query[j])
            most = self.postings[j, 1 if weight > 0 else -1][2]
            if most:
                terms.append((abs(weight) * most, j, weight))
        terms.sort()
        bounds = np.cumsum([bound for bound, _, _ in terms], dtype=np.int64)
        split = int(np.searchsorted(bounds, floor))  # terms before it stay under the floor together
        rest = int(bounds[split - 1]) if split else 0
        gained, seen = np.zeros(len(self.rows), np.int64), np.zeros(len(self.rows), bool)
        for _, j, weight in terms[split:]:
            places, weights, _ = self.postings[j, 1 if weight > 0 else -1]
            gained[places] += abs(weight) * weights
            seen[places] = True
        alive = np.flatnonzero(seen & (gained + rest >= floor))
        scores = gained[alive] + np.minimum(self.matrix[alive, : len(query)] * query, 0).sum(1)
        for bound, j, weight in reversed(terms[:split]):
            near = scores + rest >= floor
            alive, scores = alive[near], scores[near]
            scores = scores + np.maximum(self.matrix[alive, j] * weight, 0)
            rest -= bound
        near = scores >= floor
        return alive[near], scores[near]


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties to the smaller id."""
    order = np.lexsort([ids, -scores])[:k]
    return scores[order], ids[order]


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """The rows of a list column as a matrix, short ones filled with zeros."""
    lengths = column.value_lengths().to_numpy()
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = column.flatten().to_numpy()
    return out


def _shards(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[Shard]:
    size = max(1, SHARD_INTEGERS // max(1, width))
    held, rows = [], 0

    def made() -> Shard:
        table = pa.Table.from_batches(held).combine_chunks()
        vectors = table.column("vector").combine_chunks()
        return Shard(table.column("row").to_numpy(), table.column("id").to_numpy(), _matrix(vectors, width))

    for whole in batches:
        for start in range(0, whole.num_rows, size):
            batch = whole.slice(start, size)
            if rows + batch.num_rows > size:
                yield made()
                held, rows = [], 0
            held.append(batch)
            rows += batch.num_rows
    if held:
        yield made()


def _search(candidates: DataFrame, asked: tuple, floors: dict[int, int], k: int, width: int) -> DataFrame:
    """Rows (query, query_id, id, score): each task's best rows for each query, none under the query's floor."""
    rows, ids, matrix = asked

    def run(batches):
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in rows]
        least = [floors.get(int(row)) for row in rows]
        for shard in _shards(batches, width):
            for q, row in enumerate(rows):
                scores, near = shard.search(matrix[q], least[q], int(row))
                if not len(scores):
                    continue
                found[q] = best(np.append(found[q][0], scores), np.append(found[q][1], near), k)
                if len(found[q][0]) == k and (least[q] is None or found[q][0][-1] > least[q]):
                    least[q] = int(found[q][0][-1])
        counts = [len(f[0]) for f in found]
        if sum(counts):
            columns = [np.repeat(rows, counts), np.repeat(ids, counts)] + [np.concatenate([f[c] for f in found]) for c in (1, 0)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query", "query_id", "id", "score"])

    return candidates.mapInArrow(run, "query bigint, query_id bigint, id bigint, score bigint")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def integer_vectors(table: DataFrame, id_column: str, vector_column: str, scale: int) -> DataFrame:
    """Rows (id, vector) of floor(scale * component), without those that take no part."""
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    vector = F.col(vector_column)
    return table.filter(vector.isNotNull() & F.col(id_column).isNotNull() & F.forall(vector, sound)).select(
        F.col(id_column).cast("bigint").alias("id"),
        F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("bigint")).alias("vector"),
    )


def top_k(
    table: DataFrame,
    wanted: Column,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    k: int = K,
    scale: int = 1024,
    queries: int = QUERIES,
    first_rows: int = FIRST_ROWS,
) -> DataFrame:
    """Rows (query_id, rank, id, score): for each row that is ``wanted``, the k other rows of the highest inner product.

    Components are read as floor(scale * component). ``wanted`` may use the columns id and vector.
    """
    spark = table.sparkSession
    candidates = store(integer_vectors(table, id_column, vector_column, scale).withColumn("row", F.monotonically_increasing_id()), "vectors")
    most = F.array_max(F.transform("vector", F.abs)).cast("double")
    sizes = candidates.agg(F.count(F.lit(1)), F.max(F.size("vector")), F.max(most)).first()
    total, width, largest = sizes[0], sizes[1] or 0, sizes[2] or 0
    if width * largest * largest >= 2**62:
        raise OverflowError("Scores may not fit 64 bits")
    asked = store(ordinals(candidates.filter(wanted), "row", "number"), "queries")
    block = max(1, min(queries, INTEGERS // max(1, width)))
    last = asked.agg(F.max("number")).first()[0] or 0
    # The first floors come from a hashed part of the rows; any part gives lower bounds of the true k-th scores.
    share = min(1.0, first_rows / max(1, total))
    part = candidates.filter(F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    path = scratch_path(spark, "top")
    shape = "query bigint, query_id bigint, id bigint, score bigint, rank int"
    spark.createDataFrame([], shape).write.parquet(path)
    for start in range(0, last, block):
        chosen = asked.filter((F.col("number") > start) & (F.col("number") <= start + block)).select("row", "id", "vector").toArrow()
        vectors = _matrix(chosen.column("vector").combine_chunks(), width)
        mine = chosen.column("row").to_numpy(), chosen.column("id").to_numpy(), vectors
        floors = {}
        if share < 1:
            reached = _ranked(_search(part, mine, {}, k, width), k).filter(F.col("rank") == k)
            floors = {r["query"]: r["score"] for r in reached.select("query", "score").collect()}
        _ranked(_search(candidates, mine, floors, k, width), k).select(*[c.split()[0] for c in shape.split(", ")]).write.mode("append").parquet(path)
    return spark.read.schema(shape).parquet(path).select("query_id", "rank", "id", "score")
