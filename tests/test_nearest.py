"""The passage nearest to an item: how many pairs meet, and equality with brute force over copies, ties and lost words."""

import random

from quillstone.operators import grounding


def case(rng, n):
    pool, rare = [f"word{i}" for i in range(60)], [f"rare{i}" for i in range(400)]
    texts = []
    for i in range(n):
        if texts and rng.random() < 0.4:  # copies and near copies
            ws = rng.choice(texts).split()
            ws[rng.randrange(len(ws))] = rng.choice(rare + ws)
        else:
            ws = [*rng.sample(pool, rng.randrange(1, 25)), *rng.sample(rare, rng.randrange(0, 4))]
        texts.append(" ".join(ws))
    runs = [rng.choice("rs") for _ in texts]
    passages = [(r, f"c{i}", t, i) for i, (r, t) in enumerate(zip(runs, texts))]
    items = [(r, f"g{i}", t[: rng.randrange(0, 120)]) for i, (r, t) in enumerate(zip(runs, texts))]
    items += [("r", f"far{i}", " ".join([*rng.sample(pool, 6), *(f"none{i}x{j}" for j in range(rng.randrange(0, 20)))])) for i in range(n // 4)]
    return items, passages


def nearest(spark, items, passages):
    rows = spark.createDataFrame(items, "run_id string, gid string, grounding_text string"), spark.createDataFrame(passages, "run_id string, chunk_id string, content string, n int")
    return {r.gid: r.content for r in grounding.best_overlap(*rows, order="n").collect()}


def test_nearest_equals_brute_force_over_copies_and_lost_words(spark):
    items, passages = case(random.Random(4), 160)
    held, want = [(r, n, c, set(c.split())) for r, _, c, n in passages], {}
    for run, key, text in items:
        ws = {w for w in text.split() if len(w) >= 4}
        scored = [(-len(ws & own), n, c) for r, n, c, own in held if r == run and ws and len(ws & own) >= 0.25 * len(ws)]
        if scored:
            want[key] = min(scored)[2]
    assert nearest(spark, items, passages) == want and len(want) < len(items)


def test_items_from_passages_meet_few(spark, monkeypatch):
    rng = random.Random(9)
    texts = [" ".join([*(f"common{j}" for j in range(9)), *(f"own{rng.randrange(10**6)}" for _ in range(4))]) for _ in range(120)]
    sizes, write = {}, grounding.written

    def written(df, path):
        out = write(df, path)
        sizes[path.split("/", -1)[-2]] = sizes.get(path.split("/", -1)[-2], 0) + out.count()
        return out

    monkeypatch.setattr(grounding, "written", written)
    got = nearest(spark, [("r", f"g{i}", t) for i, t in enumerate(texts)], [("r", f"c{i}", t, i) for i, t in enumerate(texts)])
    assert got == {f"g{i}": t for i, t in enumerate(texts)}
    assert sizes["pairs"] <= 2 * len(texts)  # not the square
