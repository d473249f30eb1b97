"""Exact fused top-k and key concepts against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.operators import concepts, retrieval


def fused(dense, lexical, top, k=60):
    order = lambda s: {i: n for n, i in enumerate(sorted(s, key=lambda i: (-s[i], i)))}
    d, x, total = order(dense), order(lexical), len({*dense, *lexical})
    rrf = {i: 1.0 / (k + d.get(i, total)) + 1.0 / (k + x.get(i, total)) for i in {*dense, *lexical}}
    return [(i, rrf[i], n) for n, i in enumerate(sorted(rrf, key=lambda i: (-rrf[i], i))[:top])]


@pytest.mark.parametrize("top", [1, 10, 300])
def test_fused_top_equals_full_ranks(spark, top):
    rng = random.Random(top)
    dense = {i: rng.choice([0.0, 0.1, 0.5, rng.random()]) for i in rng.sample(range(700), 500)}
    lexical = {i: rng.choice([0.0, 0.0, rng.random()]) for i in rng.sample(range(700), 450)}
    frame = lambda s: spark.createDataFrame(list(s.items()), "doc_id long, score double").repartition(3)
    got = [(r.doc_id, r.rrf, r["rank"]) for r in retrieval.fused_top(frame(dense), frame(lexical), top).collect()]
    assert got == fused(dense, lexical, top)


def test_fused_top_of_small_and_empty_lists(spark):
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, score double")
    got = retrieval.fused_top(frame([(1, 3.0), (2, 2.0), (3, 1.0)]), frame([(3, 3.0), (1, 2.0), (2, 1.0)]), 10).collect()
    assert [(r.doc_id, round(r.rrf, 6)) for r in got] == [(1, 0.03306), (3, 0.032796), (2, 0.032522)]
    assert retrieval.fused_top(frame([]), frame([]), 5).count() == 0
    assert [r.doc_id for r in retrieval.fused_top(frame([]), frame([(7, 1.0)]), 5).collect()] == [7]


def test_no_row_is_ranked_in_one_partition(spark):
    scores = spark.range(100).select(F.col("id").alias("doc_id"), F.rand(1).alias("score"))
    plan = scores.groupBy(retrieval._beaten(F.col("score"), F.col("doc_id"), [(0.5, 3), (0.2, 4)]).alias("b")).count()._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" not in plan


def test_bm25_counts_the_vocabulary_only_for_negative_weights(spark):
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "gamma"), (3, None), (4, "gamma delta alpha"), (5, "gamma x")], "doc_id long, text string")
    plan = retrieval.bm25(docs, "beta none")._jdf.queryExecution().analyzed().toString()
    assert "Aggregate" not in plan and "Join" not in plan
    got = {r.doc_id: r.score for r in retrieval.bm25(docs, "gamma beta").collect()}
    assert got[1] > 0 and got[3] == 0 and got[2] > 0  # gamma stands in most texts: its weight is a part of the mean


def brute_concepts(text, most, diversity):
    names = concepts.phrases(text)
    vectors = concepts.hashed_vectors([text, *names])
    unit = lambda v: v / np.linalg.norm(v) if np.linalg.norm(v) else v
    whole = unit(vectors[0])
    near = {n: round(float(unit(v) @ whole), 6) for n, v in zip(names, vectors[1:])}
    order = sorted(names, key=lambda n: (-near[n], n))
    if not diversity:
        return [(n, near[n]) for n in order[:most]]
    own, pool, out = dict(zip(names, vectors[1:])), order[: 4 * most], order[:1]
    while len(out) < min(most, len(pool)):
        gain = lambda n: round((1 - diversity) * near[n] - diversity * max(round(float(unit(own[n]) @ unit(own[o])), 6) for o in out), 6)
        out.append(min((n for n in pool if n not in out), key=lambda n: (-gain(n), n)))
    return [(n, near[n]) for n in out]


@pytest.mark.parametrize("diversity", [0.0, 0.5])
def test_concepts_equal_brute_force(spark, diversity):
    rng = random.Random(2)
    pool = ["índice", "memoria", "caché", "tabla", "x", "filas", "columna", "Índice", "42", "ñu"]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randrange(12, 80))) for _ in range(40)] + [None, "", "short", "x y z " * 20, "a" * 50, "a" * 51, "same same " * 10]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sorted(concepts.key_concepts(df, diversity=diversity).collect(), key=lambda r: (r.doc_id, r.nth))
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.concept, r.score))
    assert got == {i: brute_concepts(t, 4, diversity) for i, t in enumerate(texts) if t and len(t) > 50 and concepts.phrases(t)}
    assert max(map(len, got.values())) == 4


def test_another_model_is_asked_for_phrases_and_text():
    seen = []

    def embed(texts):
        seen.extend(texts)
        return np.array([[t.count("b") + 1.0, len(t)] for t in texts])

    text = "bb ab " * 12
    assert len(concepts.chosen(text, embed)) == 4 and text in seen and "bb ab" in seen
