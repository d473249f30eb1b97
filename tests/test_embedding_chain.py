"""The embedding chain: cascades, retries, halving, and lists that are given up, all lists in one run."""

import collections
import hashlib

import pytest
from pyspark.sql import functions as F

from quillstone.operators import embedding as E


def vector(text):
    h = hashlib.md5(text.encode()).hexdigest()
    return [int(h[8 * i : 8 * i + 8], 16) / 4294967296 for i in range(2)]


@pytest.fixture(scope="module")
def results(spark):
    list_id, batch, attempt, turn = (F.col(c) for c in ("list_id", "batch", "attempt", "turn"))
    size, n = F.aggregate("texts", F.lit(0), lambda s, t: s + F.length(t["text"])), F.size("texts")
    gemini = (
        F.when(list_id.isin(2, 3, 8), "429 quota")
        .when((list_id == 5) & (batch == 1) & (attempt < 3), "503")
        .when((list_id == 6) & (batch == 1), "503")
        .when((list_id == 7) & (n > 1), "400 INVALID_ARGUMENT")
        .when((list_id == 10) & (batch == 2), "RESOURCE_EXHAUSTED")
        .when((list_id == 9) & (turn == 0), "503")
        .when((list_id == 11) & (batch > 0) & (attempt == 1), "503")
        .when((list_id == 12) & (size > 2), "INVALID_ARGUMENT")
    )
    kind = F.when(list_id == 10, "daily")
    jina = F.when(list_id.isin(3, 8, 9), "payload")
    local = F.when(list_id.isin(8, 9), "out of memory")
    some = F.col("list_id") != 4
    chain = [
        E.rule_provider("gemini", gemini, kind=kind, dimension=2, batch=2, can_serve=some),
        E.rule_provider("jina", jina, dimension=2, batch=3, can_serve=F.col("list_id") != 13),
        E.rule_provider("local", local, dimension=2, can_serve=F.col("list_id") != 13),
    ]
    chain[0] = E.Provider("gemini", chain[0].call, 2, some & (F.col("list_id") != 13))
    texts = [(i, p, f"t{i}.{p}") for i in range(1, 14) for p in range(5)]
    texts += [(14, 0, None), (14, 1, "")] + [(None, 0, "nobody's")]
    rows = E.embedded(spark.createDataFrame(texts, "list_id long, position int, text string"), chain).collect()
    assert collections.Counter((r.list_id, r.position) for r in rows) == collections.Counter((i, p) for i, p, _ in texts if i)
    text = {(i, p): t or "" for i, p, t in texts}
    for r in rows:
        assert (r.embedding is None) == (r.error is not None) == (r.provider is None)
        assert r.embedding is None or r.embedding == vector(text[r.list_id, r.position])
    out = collections.defaultdict(dict)
    for r in rows:
        out[r.list_id][r.position] = (r.provider, r.attempt, r.error)
    return out


def told(results, i):
    return [results[i][p] for p in range(5)]


def test_first_provider_and_cascades(results):
    assert set(told(results, 1)) == {("gemini", 1, None)}
    assert set(told(results, 2)) == {("jina", 1, None)}  # the first batch fails: no retry
    assert set(told(results, 3)) == {("local", 1, None)}
    assert set(told(results, 4)) == {("jina", 1, None)}  # passed over before anything is sent


def test_retries_of_one_batch_and_their_end(results):
    assert told(results, 5) == [("gemini", 1, None)] * 2 + [("gemini", 3, None)] * 2 + [("gemini", 1, None)]
    assert set(told(results, 6)) == {("jina", 1, None)}  # vectors of two providers are never mixed
    assert set(told(results, 10)) == {("jina", 1, None)}  # waiting does not help against a daily quota
    assert told(results, 11) == [("gemini", 1, None)] * 2 + [("gemini", 2, None)] * 3  # two failures are within the retries


def test_halving(results):
    assert set(told(results, 7)) == {("gemini", 1, None)}
    assert {x[0] for x in told(results, 12)} == {"jina"}  # single texts are still too large: no halves, no provider


def test_chain_begins_again_and_ends(results):
    assert set(told(results, 9)) == {("gemini", 1, None)}  # in the second round
    assert set(told(results, 8)) == {(None, None, "out of memory")}
    assert set(told(results, 13)) == {(None, None, "no provider")}
    assert set(results[14].values()) == {("gemini", 1, None)}


def test_empty_list_of_texts(spark):
    none = spark.createDataFrame([], "list_id long, position int, text string")
    assert E.embedded(none, [E.rule_provider("local", F.lit(None).cast("string"))]).count() == 0


def test_estimates(spark):
    rows = spark.createDataFrame([("",), ("a" * 7,), ("a" * 12,), ("a" * 350,)], "t string").select(E.estimated_tokens(F.col("t"))).collect()
    assert [r[0] for r in rows] == [max(1, round(n / 3.5)) for n in (0, 7, 12, 350)]
