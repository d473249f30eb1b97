"""The greedy rule as joins against the sequential rule, on one long run among others."""

import collections
import random
from difflib import SequenceMatcher

import numpy as np
import pytest

from quillstone.operators import similar
from quillstone.operators.dedup import greedy_unique, ratio


def sequential(texts, limit):
    """The sequential rule; pairs whose signs alone bound the ratio below the limit are passed over."""
    low = [(t or "").lower() for t in texts]
    signs = {c: i for i, c in enumerate(sorted(set("".join(low))))}
    counts = np.zeros((len(low), len(signs) + 1), np.int32)
    for i, t in enumerate(low):
        for c, n in collections.Counter(t).items():
            counts[i, signs[c]] = n
    size, kept, out = np.array([len(t) for t in low]), [], []
    for i, t in enumerate(low):
        k = np.array(kept, np.int64)
        bound = 2 * np.minimum(counts[k], counts[i]).sum(1) >= limit * (size[k] + size[i]) - 1e-9 if kept else np.zeros(0, bool)
        twin = any(SequenceMatcher(None, t, low[j]).ratio() >= limit for j in k[bound])
        out.append(not twin)
        if not twin:
            kept.append(i)
    return out


def changed(rng, text, n):
    signs = list(text)
    for _ in range(n):
        i = rng.randrange(len(signs) + 1)
        kind = rng.randrange(3)
        if kind == 0 or i == len(signs):
            signs.insert(i, rng.choice("xyzw "))
        elif kind == 1:
            del signs[i]
        else:
            signs[i] = rng.choice("xyzw ")
    return "".join(signs)


def long_run(rng, n):
    """A third of near copies of one text, families around the limit, short texts, copies, and texts of frequent signs alone."""
    letters = "abcdefghijklmnopqrstuvwxyzñéäöü0123456789"
    base = lambda: "".join(rng.choice(rng.sample(letters, 12)) for _ in range(rng.randrange(12, 180)))
    hot, families = " ".join("lorem ipsum dolor sit amet consectetur adipiscing elit sed do".split()), [base() for _ in range(n // 12)]
    out = []
    for _ in range(n):
        x = rng.random()
        if x < 0.34:
            out.append(changed(rng, hot, rng.randrange(0, 9)))
        elif x < 0.8:
            t = rng.choice(families)
            out.append(changed(rng, t, rng.randrange(0, 2 + len(t) // 6)))
        elif x < 0.9:
            out.append("".join(rng.choice("abAB ") for _ in range(rng.randrange(0, 13))))
        else:
            out.append(rng.choice(families).upper())
    return out


@pytest.mark.parametrize("limit", [0.88, 0.75, 0.6])
def test_filter_promises_what_it_says(limit):
    rng, told = random.Random(3), similar.Filter(limit)
    met = 0
    for _ in range(3000):
        a = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 40)))
        b = changed(rng, a, rng.randrange(0, 8))
        if ratio(a, b) >= limit:
            assert told.close_sizes(len(a), len(b))
            keys = [{q: {k for k, kq in told.keys(t) if kq == q} for q in (1, told.q)} for t in (a, b)]
            shared = {q: len(keys[0][q] & keys[1][q]) for q in keys[0] if keys[0][q] and keys[1][q]}
            assert any(n >= max(told.needed(q, len(a)), told.needed(q, len(b))) or n >= min(len(keys[0][q]), len(keys[1][q])) for q, n in shared.items()), (a, b, shared)
            met += 1
    assert met > 500


def test_one_run_of_ten_thousand_items(spark):
    rng = random.Random(11)
    texts = long_run(rng, 10_000)
    rows = [("big", i, t, i) for i, t in enumerate(texts)]
    small = long_run(rng, 60) + [None, "", "", "ab" * 150, "ab" * 150, "x" * 250, "x" * 250]
    rows += [(None, i, t, -i) for i, t in enumerate(small)] + [("one", 0, "alone", 0)]
    rng.shuffle(rows)
    got = similar.greedy_dedup(spark.createDataFrame(rows, "run_id string, item_idx long, text string, size long").repartition(6)).collect()
    for name, own in (("big", texts), (None, small), ("one", ["alone"])):
        want = {i for i, k in enumerate(sequential(own, 0.88)) if k}
        assert {r.item_idx for r in got if r.run_id == name} == want
        assert all(r.text == own[r.item_idx] for r in got if r.run_id == name)
    assert 500 < sum(r.run_id == "big" for r in got) < 9000
    assert sequential(small, 0.88) == greedy_unique([t or "" for t in small])


def test_another_limit_and_no_items(spark):
    texts = long_run(random.Random(5), 300)
    df = spark.createDataFrame(list(enumerate(texts)), "item_idx long, text string").selectExpr("'r' AS run_id", "*")
    got = {r.item_idx for r in similar.greedy_dedup(df, limit=0.75).collect()}
    assert got == {i for i, k in enumerate(sequential(texts, 0.75)) if k}
    assert similar.greedy_dedup(df.limit(0)).count() == 0
