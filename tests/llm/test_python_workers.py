"""A task of near dedup keeps one Python worker busy: its executions hold one step in Python each."""

import random
import re

from quillstone.llm import dart_minhash


def plans(spark):
    """Physical plans of all executions so far, by number."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    told = spark._jsparkSession.sharedState().statusStore().executionsList()
    return {told.apply(i).executionId(): told.apply(i).physicalPlanDescription() for i in range(told.size())}


def test_pairs_are_compared_in_one_python_step(spark):
    rng = random.Random(4)
    pool = [a + b for a in ("th", "en", "ou", "st", "re", "an") for b in ("e", "ing", "ed", "tion", "er", "of", "at")]
    words = [[rng.choice(pool) for _ in range(120)] for _ in range(8)]
    texts = [" ".join(w[:60] + ["changed"] * (i > 0) + w[60:]) for w in words for i in range(2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    before = plans(spark)
    got = {r.doc_id: r.class_id for r in dart_minhash.near_duplicates(docs).collect()}
    assert got == {i: i - i % 2 for i in range(16)}
    mine = [p.split("== Initial Plan ==")[0] for i, p in plans(spark).items() if i not in before]
    steps = [len(re.findall(r"^[^\n(]*(?:ArrowEvalPython|MapInArrow)\b", p, re.M)) for p in mine]
    assert max(steps) == 1
