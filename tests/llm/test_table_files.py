"""Tables of few rows have few files, however many partitions a shuffle has; rows and results stay the same."""

import glob
import random

import pytest

from quillstone.llm import dart_minhash, quality_lm
from quillstone.llm.common import materialize, shared_root

HELD = {"spark.sql.shuffle.partitions": "23", "spark.sql.adaptive.coalescePartitions.enabled": "false"}


@pytest.fixture
def many_partitions(spark):
    was = {k: spark.conf.get(k) for k in HELD}
    for k, v in HELD.items():
        spark.conf.set(k, v)
    yield
    for k, v in was.items():
        spark.conf.set(k, v)


def files(spark):
    """Files of each written table."""
    there = glob.glob(f"{shared_root(spark).removeprefix('file:')}/quillstone/*")
    return {t: len(glob.glob(f"{t}/part-*")) for t in there}


def texts():
    rng = random.Random(4)
    pool = [a + b for a in ("th", "en", "ou", "st", "re", "an") for b in ("e", "ing", "ed", "tion", "er", "of", "at")]
    words = [[rng.choice(pool) for _ in range(120)] for _ in range(40)]
    return [" ".join(w[:60] + ["changed"] * i + w[60:]) for w in words for i in range(3)]


def test_bounded_tables_keep_all_rows(spark, many_partitions):
    rows = spark.range(1000).repartition(23)
    before = files(spark)
    got = materialize(rows, "bounded", 1000, 300)
    assert sorted(r.id for r in got.collect()) == list(range(1000))
    assert [n for t, n in files(spark).items() if t not in before] == [4]


def test_model_tables_have_few_files(spark, many_partitions):
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts())], "doc_id long, text string, lang string")
    before = files(spark)
    assert quality_lm.score(docs).count() == 120
    new = {t: n for t, n in files(spark).items() if t not in before and ("gram-counts-below" in t or "gram-model" in t)}
    assert len(new) == 2 * quality_lm.ORDER - 1 and set(new.values()) == {1}


def test_tables_of_near_dedup_have_few_files(spark, many_partitions):
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    before = files(spark)
    assert sorted(r.doc_id for r in dart_minhash.deduplicated(docs).collect()) == list(range(0, 120, 3))
    new = {t: n for t, n in files(spark).items() if t not in before and "signatures" not in t}
    assert len(new) > 8 and max(new.values()) == 1
