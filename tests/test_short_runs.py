"""The greedy rule over many short runs, and the memory of its keys over long ones."""

import random

import pyarrow as pa

from quillstone.operators import similar
from quillstone.operators.dedup import greedy_unique
from tests.test_similar import long_run


def test_short_runs_equal_the_sequential_rule_without_keys(spark, monkeypatch):
    def no_keys(limit):
        raise AssertionError("keys for short runs")

    monkeypatch.setattr(similar, "_keys_of", no_keys)
    rng = random.Random(7)
    runs = {k: long_run(rng, rng.randrange(1, similar.FEW + 1)) for k in range(12)} | {99: [None, "", None, "ab" * 150, "ab" * 150, "X y z", "x y z"]}
    rows = [(k, i, t) for k, own in runs.items() for i, t in enumerate(own)]
    rng.shuffle(rows)
    got = similar.greedy_dedup(spark.createDataFrame(rows, "run_id long, item_idx long, text string").repartition(5)).collect()
    for k, own in runs.items():
        want = [i for i, keep in enumerate(greedy_unique([t or "" for t in own])) if keep]
        assert sorted(r.item_idx for r in got if r.run_id == k) == want
    assert len(got) < len(rows)


def test_keys_come_in_batches_of_bounded_size():
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(500)) for _ in range(3000)] + ["a" * 10, "", "xy"]
    batch = pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "low": texts})
    out = list(similar._keys_of(0.88)(iter([batch])))
    told = similar.Filter(0.88)
    assert len(out) > 1 and all(len(b.column("ks").flatten()) < similar.BATCH + 1000 for b in out)
    got = {(i, q): ks for b in out for i, q, ks in zip(*(b.column(c).to_pylist() for c in ("id", "q", "ks")))}
    assert got == {(i, q): ks.tolist() for i, t in enumerate(texts) for q, ks in told.key_sets(t)}
