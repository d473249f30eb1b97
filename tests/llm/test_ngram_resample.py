"""Importance resampling against a brute-force version, the tries' CRC states, and the defined cases."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quillstone.llm import ngram_resample, queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
    return w, w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def bucket(f):
    return zlib.crc32(f.encode()) % 10000


def brute(docs, target):
    s, t = collections.Counter(), collections.Counter()
    for _, text in docs:
        s.update(map(bucket, features(text)[1]))
    for text in target:
        t.update(map(bucket, features(text)[1]))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000))))
    out = []
    for i, text in docs:
        w, f = features(text)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is not None, r[0]))
    return out, fit, 25 * len(fit) // 100


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(4)
    pool = ["".join(rng.choice("abcdeéñÀ0Ж") for _ in range(rng.randrange(1, 7))) for _ in range(300)]
    docs = [(i, " ".join(rng.choice(pool) for _ in range(rng.choice([0, 1, 19, 20, 21, 200])))) for i in range(120)]
    odd = [(200, None), (201, ""), (202, "AbC-abc  \n abc"), (203, "y" * 300 + " " + "z" * 63 + " " + "z" * 64 + " x"), (204, "w " * 5000), (5, docs[5][1]), (5, docs[5][1]), (None, docs[9][1]), (None, docs[10][1])]
    return docs + odd, [docs[3][1], docs[8][1].upper(), None, ""]


def test_equals_brute_force(spark, tables):
    docs, target = tables
    frame = spark.createDataFrame([(i, t, "r", -1) for i, t in docs], "doc_id long, text string, row string, score int").repartition(4)
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    for most in (ngram_resample.MOST_NODES, 50):
        got = ngram_resample.resample(frame, bench, most=most).select("row.doc_id", "n_words", "n_features", "weight", "score", "rank", "row.row").collect()
        want, fit, drawn = brute(docs, target)
        order = lambda x: tuple((v is None, v or 0) for v in x)
        assert sorted((list(r)[:5] for r in got), key=order) == sorted(want, key=order)
        ranked = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
        assert [r["rank"] for r in ranked] == list(range(1, drawn + 1)) and [(r.score, r.doc_id) for r in ranked] == [(r[4], r[0]) for r in fit[:drawn]]


def test_ties_go_to_smaller_ids(spark, tmp_path):
    rows = [(i, None, 30, 59, 5, 100 if i % 2 else 200) for i in range(40)] + [(None, None, 30, 59, 5, 200), (99, None, 19, 37, 9, 999)]
    spark.createDataFrame(rows, "id long, row string, n_words long, n_features long, weight long, score long").write.parquet(f"{tmp_path}/s")
    got = {r.id: r["rank"] for r in ngram_resample.draw(spark.read.parquet(f"{tmp_path}/s"), share=60).collect()}
    want = [None, *range(0, 40, 2), *range(1, 40, 2)][:24]
    assert got == {i: want.index(i) + 1 if i in want else None for i in [None, 99, *range(40)]}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b " * 30), (2, "")], "doc_id long, text string")
    none = docs.limit(0)
    assert ngram_resample.resample(none, docs).count() == 0
    assert {(r.n_features, r["rank"]) for r in ngram_resample.resample(docs, none).collect()} == {(119, None), (0, None)}


def test_states_of_children_follow_by_table():
    rng = np.random.default_rng(1)
    heads, tails = [rng.bytes(int(n)) for n in rng.integers(0, 90, 300)], [rng.bytes(int(n)) for n in rng.integers(0, 65, 300)]
    got = ngram_resample.extended(*(np.array([zlib.crc32(x) for x in xs], np.uint32) for xs in (heads, tails)), np.array([len(x) for x in tails]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in zip(heads, tails)]


def test_trie_keeps_counts_over_replanting():
    texts = pa.array(["a b a b", None, "b a", "c " * 50, ""])
    small, large = ngram_resample.WordTrie(most=1), ngram_resample.WordTrie()
    for trie in (small, large):
        for i in range(len(texts)):
            trie.count(texts.slice(i, 1))
        trie.flush()
    assert small.totals.tolist() == large.totals.tolist() and small.totals.sum() == 7 + 3 + 99
    assert small.totals[bucket("a b")] == 2 and small.totals[bucket("c c")] == 49


def test_query_columns(spark, tables, tmp_path):
    docs, target = tables
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, t) for t in target], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = queries.op12_target_resample(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    want = brute(docs, target)[0]
    assert sorted((r.score, r.weight) for r in got.collect()) == sorted((r[4], r[3]) for r in want)
