"""License scan: base places against brute force, long texts full of license words, and filters on its result."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from quillstone.llm import license_scan


def brute_base(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(license_scan.WORD, low)
    places = [(i, label) for label, p in license_scan.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "z", 3) for i, t in enumerate(texts)], "doc_id long, text string, labels string, n_words int")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    pool = sorted({w for p in license_scan.BASE.values() for w in p.split()} | {"Mit", "CC-BY-NC", "The", "é", "x_y", "Apache\nLicense"})
    out = [" ".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(300)]
    words = sorted({w for t, _ in license_scan.TEMPLATES.values() for w in t.split()})
    return [*out, None, "", " ".join(rng.choice(words) for _ in range(40_000)), "under the mit license " * 3000]


def test_base_places_equal_brute_force(spark, texts):
    got = license_scan.scan(docs_of(spark, texts)).select("row.doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score").collect()
    assert len(got) == len(texts)
    for r in got:
        assert tuple(r[1:6]) == brute_base(texts[r.doc_id])
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_filters_on_every_column_end(spark, texts):
    found = license_scan.scan(docs_of(spark, texts[:40]))
    began = time.time()
    kept = found.filter("labels <> base_labels or score > 2").filter(F.col("n_base") >= 0).select("row.doc_id", "labels")
    assert kept.filter("labels like '%mit%'").count() == 0
    for c in found.columns[1:]:
        found.filter(F.col(c).isNotNull()).groupBy(c).count().collect()
    assert time.time() - began < 60


def test_rare_words_without_the_key_phrase_are_no_license(spark):
    notice = license_scan.TEMPLATES["gpl"][0]
    got = license_scan.scan(docs_of(spark, [notice, notice.replace("gnu general", "general gnu"), "gnu general public license"])).select("row.doc_id", "labels").collect()
    assert {r.doc_id: r.labels for r in got} == {0: "gpl", 1: "", 2: ""}
