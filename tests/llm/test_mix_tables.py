"""The mix writes one table, that of the sized rows, whose files grow with the input; what it counts of them is not written."""

import glob

from quillstone.llm import mixing
from quillstone.llm.common import shared_root


def test_counts_of_size_classes_are_not_written(spark):
    docs = spark.createDataFrame([(i, "word " * (i % 7 + 1), f"s{i % 2}") for i in range(40)], "doc_id long, text string, source string")
    there = lambda: set(glob.glob(f"{shared_root(spark).removeprefix('file:')}/quillstone/mix-*"))
    before = there()
    rows = mixing.mix(docs, keep=["doc_id"]).collect()
    assert len(rows) == 40 and sum(r.size for r in rows) == sum(i % 7 + 1 for i in range(40))
    assert len(there() - before) == 1
