"""Every exact link of the given documents lies within one class of near duplicates."""

import re

import pytest

from quillstone.llm import queries

WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")


def shingles(text):
    w = WORD.findall((text or "").lower())
    return {hash(tuple(w[i : i + 5])) for i in range(len(w) - 4)} if len(w) >= 5 else ({hash(tuple(w))} if w else set())


def recall(spark, folder, asked):
    """(links found in one class, links) of the documents ``asked`` against all, at a similarity of 0.8."""
    docs = {r.doc_id: shingles(r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    of = {r.doc_id: r.class_id for r in queries.op2_near_duplicates(spark, folder).select("doc_id", "class_id").collect()}
    own = {i: s for i, s in docs.items() if asked(i) and s}
    holders = {}
    for i, s in own.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    found = links = 0
    for j, s in docs.items():
        shared = {}
        for x in s:
            for i in holders.get(x, ()):
                shared[i] = shared.get(i, 0) + 1
        for i, n in shared.items():
            if i != j and n >= 0.8 * (len(s) + len(own[i]) - n):
                links += 1
                found += of[i] == of[j]
    return found, links


@pytest.mark.parametrize("folder,step", [("/root/testdata/sf0.01", 1)])
def test_no_link_of_the_given_documents_is_lost(spark, folder, step):
    found, links = recall(spark, folder, lambda i: i % step == 0)
    assert links > 100 and found == links
