"""Many queries against all rows: equality with single cosines over copies, ties, zeros and rows without a vector; nothing pair by pair in the plan."""

import random

import pytest
from pyspark.sql import functions as F

from quillstone.operators import retrieval as R


@pytest.mark.parametrize("most_queries", [2000, 7])
def test_blocks_equal_single_cosines(spark, most_queries):
    rng = random.Random(6)
    base = [[rng.choice([-1.5, -0.25, 0.0, 0.5, 1.0, 2.0]) for _ in range(6)] for _ in range(40)]
    rows = [(i, rng.choice(base) if i % 3 else [rng.uniform(-1, 1) for _ in range(6)]) for i in range(400)]
    rows += [(500, [0.0] * 6), (501, None), (502, [1.0, 2.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    queries = vectors.filter("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    both = vectors.crossJoin(queries.select("query_id", F.col("embedding").alias("q")))
    scores = both.select("query_id", "vec_id", F.round(R.cosine(F.col("embedding"), F.col("q")), 6).alias("score")).collect()
    want = {}
    for r in sorted(scores, key=lambda r: (r.query_id, r.score is None, -(r.score or 0), r.vec_id)):
        want.setdefault(r.query_id, []).append((r.vec_id, r.score))
    got = {}
    for r in R.top_k_many(vectors, queries, 5, most_queries=most_queries).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == {q: own[:5] for q, own in want.items()}


def test_fewer_rows_than_asked_for(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0])], "vec_id long, embedding array<float>")
    queries = vectors.select(F.col("vec_id").alias("query_id"), "embedding")
    got = R.top_k_many(vectors, queries, 5).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id, r.score, r["rank"]) for r in got] == [(1, 1, 1.0, 0), (1, 2, None, 1), (1, 3, None, 2), (2, 1, None, 0), (2, 2, None, 1), (2, 3, None, 2), (3, 3, 1.0, 0), (3, 1, None, 1), (3, 2, None, 2)]
    assert R.top_k_many(vectors, queries.limit(0), 5).count() == 0


def test_no_row_for_each_pair(spark):
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(60)], "vec_id long, embedding array<float>")
    plan = R.top_k_many(vectors, vectors.select(F.col("vec_id").alias("query_id"), "embedding"), 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan
