"""Top-k by MaxScore against brute force: ties, signs, short vectors, blocks of queries, and rows that take no part."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from redpencil.llm import maxscore


def brute(rows, wanted, k, scale=1024):
    sound = [
        (i, n, [math.floor(scale * float(np.float32(x))) for x in v])
        for n, (i, v) in enumerate(rows)
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for i, n, v in sound:
        if wanted(i):
            scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, m, w in sound if m != n)
            out += [(i, rank, j, -score) for rank, (score, j) in enumerate(scored[:k], 1)]
    return sorted(out)


def table(spark, rows, parts=3):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(parts)


def asked(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "id", "score").collect())


@pytest.mark.parametrize("queries, first_rows", [(2048, 8192), (7, 60)])
def test_against_brute_force(spark, queries, first_rows, monkeypatch):
    monkeypatch.setattr(maxscore, "SHARD_INTEGERS", 50 * 12)
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 1, (5, 12))
    vectors = [centres[k % 5] + rng.normal(0, 0.4, 12) for k in range(400)]
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(vectors)]
    found = maxscore.top_k(table(spark, rows), F.col("id") % 20 == 0, queries=queries, first_rows=first_rows)
    assert asked(found) == brute(rows, lambda i: i % 20 == 0, 10)


def test_few_values_give_ties(spark):
    rng = np.random.default_rng(2)
    rows = [(k, [float(x) for x in rng.integers(-1, 2, 4)]) for k in range(300)]
    found = maxscore.top_k(table(spark, rows), F.col("id") % 10 == 0, k=5, scale=1, first_rows=40)
    assert asked(found) == brute(rows, lambda i: i % 10 == 0, 5, 1)


def test_odd_rows(spark):
    rows = [
        (0, [1.0, 2.0]),
        (0, [1.0, 2.0]),
        (10, [0.5]),
        (20, []),
        (30, None),
        (40, [1.0, None]),
        (50, [1.0, float("nan")]),
        (60, [1.0, float("inf")]),
        (None, [9.0, 9.0]),
        (70, [-1.0, -2.0]),
        (80, [0.0, 0.0]),
        (81, [1.0, 2.0, 3.0]),
    ]
    df = table(spark, rows).withColumns({"row": F.lit("own"), "id": F.lit("own"), "vector": F.lit("own"), "score": F.lit("own")})
    assert asked(maxscore.top_k(df, F.col("id") % 10 == 0)) == brute(rows, lambda i: i % 10 == 0, 10)


def test_no_rows_and_no_queries(spark):
    assert maxscore.top_k(table(spark, []), F.col("id") % 100 == 0).collect() == []
    assert maxscore.top_k(table(spark, [(1, [1.0])]), F.col("id") % 100 == 0).collect() == []
    assert maxscore.top_k(table(spark, [(100, [1.0])]), F.col("id") % 100 == 0).collect() == []


def test_scores_beyond_64_bits_are_refused(spark):
    with pytest.raises(OverflowError):
        maxscore.top_k(table(spark, [(100, [1e12]), (101, [1e12])]), F.col("id") % 100 == 0)


def test_search_prunes_but_keeps_all_that_reach_the_floor():
    rng = np.random.default_rng(3)
    matrix = rng.integers(-50, 51, (500, 16)) * (rng.random((500, 16)) < 0.3)
    shard = maxscore.Shard(np.arange(500), np.arange(500) * 2, matrix)
    for q in rng.integers(-50, 51, (40, 16)):
        scores = matrix @ q
        for floor in (None, 0, int(np.sort(scores)[-10]), int(scores.max()) + 1):
            got, ids = shard.search(q, floor, -1)
            want = {(int(s), 2 * k) for k, s in enumerate(scores) if floor is None or s >= floor or floor <= 0}
            assert {(int(s), int(i)) for s, i in zip(got, ids)} == want
