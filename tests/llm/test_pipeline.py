"""The pipeline: each stage against brute force or its own promise, and defined cases of all of them together."""

import collections
import random
import re

import public_tokenizers
import pytest

import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, size long, kept boolean, print long"


def words(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())


def shingles(text):
    w = words(text)
    return set(zip(*[w[i:] for i in range(5)])) if len(w) >= 5 else ({tuple(w)} if w else set())


@pytest.fixture(scope="module")
def corpus():
    """Prose, near and exact copies, leaks, rejects, nulls, repeated rows and ids, a very long text."""
    rng = random.Random(12)
    pool = [a + b for a in ("th", "en", "ou", "st", "re", "an", "ti", "on", "ar", "be") for b in ("e", "ing", "ed", "tion", "er", "of", "at", "ly", "ism", "us")]
    prose = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    items = [prose(30) for _ in range(3)] + [None, ""]
    texts = [prose(rng.randrange(60, 200)) for _ in range(60)]
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(texts)]
    rows += [(100 + i, texts[i], "en", "s0") for i in range(5)]  # exact copies
    rows += [(200 + i, texts[i] + " tail word", "en", "s1") for i in range(5, 10)]  # near copies
    rows += [(300 + i, f"{prose(40)} {items[i]} {prose(40)}", "en", "s2") for i in range(3)]  # leaks
    rows += [(400, "too short", "en", "s0"), (401, None, "en", "s0"), (402, "", None, None), (403, "same three words " * 40, "en", "s1")]
    rows += [(500, prose(30_000), "en", "s0"), (None, prose(90), None, None), (None, prose(90), "en", None), (7, texts[7], "en", "s1")]
    return [(i, t, g, s, len(t or ""), "r", 1, None, 9) for i, t, g, s in rows], items


def tables(spark, corpus, folder):
    rows, items = corpus
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def counted(rows):
    return collections.Counter((r.doc_id, r.text, r.source) for r in rows)


@pytest.fixture(scope="module")
def stages(spark, corpus, tmp_path_factory):
    """Rows before and after each stage, and what the last one returns."""
    folder = tables(spark, corpus, tmp_path_factory.mktemp("corpus"))
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        result = stage(spark, docs, folder)
        if name != "token output":
            assert result.columns == docs.columns and [t for _, t in result.dtypes] == [t for _, t in docs.dtypes]
            path = f"{folder}/{name.replace(' ', '-')}.parquet"
            result.write.parquet(path)
            result = docs = spark.read.parquet(path)
        out[name] = before, result.collect()
    out["run"] = [], corpus_pipeline.run(spark, folder).collect()
    return out


def test_quality_rules_drop_what_fails_and_keep_prose(stages):
    before, after = stages["quality rules"]
    rejected = counted(before) - counted(after)
    assert {i for i, _, _ in rejected} >= {400, 401, 402, 403} and not counted(after) - counted(before)
    clean = [r for r in before if len(words(r.text)) >= 60 and r.doc_id != 403]
    assert sum((counted(clean) & counted(after)).values()) >= 0.95 * len(clean)


def test_near_dedup_keeps_one_of_each_class(stages):
    before, after = stages["near dedup"]
    sets = [(r, shingles(r.text)) for r in before]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and len(a & b) >= 0.8 * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    classes = collections.defaultdict(list)
    for i, (r, _) in enumerate(sets):
        classes[find(i)].append(r)
    assert len(classes) < len(before) - 5
    left = counted(after)
    for members in classes.values():
        assert sum(left[k] > 0 for k in {(r.doc_id, r.text, r.source) for r in members}) == 1 and sum(left[k] for k in {(r.doc_id, r.text, r.source) for r in members}) == 1
    assert sum(left.values()) == len(classes)


def test_decontamination_drops_documents_with_items(stages, corpus):
    before, after = stages["decontamination"]
    items = [shingles(t) for t in corpus[1] if words(t)]
    clean = [r for r in before if not any(len(s & shingles(r.text)) >= 0.8 * len(s) for s in items)]
    assert counted(after) == counted(clean) and len(clean) == len(before) - 3


def test_source_mix_takes_copies_near_the_targets(stages):
    before, after = stages["source mix"]
    kinds, copies = counted(before), counted(after)
    assert set(copies) <= set(kinds) and all(n <= 3 * kinds[k] for k, n in copies.items())
    size = lambda c: collections.Counter({s: sum(n * len((t or "").split()) for (_, t, x), n in c.items() if x == s) for s in {x for _, _, x in c}})
    have, taken = size(kinds), size(copies)
    whole, names = sum(have.values()), sorted((s for s in have if s is not None)) + ([None] if None in have else [])
    weight = {s: n % 3 + 1 for n, s in enumerate(names)}
    target, open_ = {}, set(names)
    while open_:  # targets stop at three times a source's size; the excess goes to the others by weight
        rest = whole - sum(target.values())
        over = {s for s in open_ if rest * weight[s] / sum(weight[x] for x in open_) > 3 * have[s]}
        if not over:
            target |= {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
            break
        target |= {s: 3 * have[s] for s in over}
        open_ -= over
    longest = {s: max(len((t or "").split()) for _, t, x in kinds if x == s) for s in names}
    assert all(abs(taken[s] - target[s]) <= max(2 * longest[s], 0.1 * target[s]) for s in names)


def test_token_output_has_every_document_in_order(stages):
    from tokenizers import Tokenizer

    before, after = stages["token output"]
    tok = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    sizes = collections.Counter((r.doc_id, len(tok.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in before)
    assert sizes == collections.Counter((r.doc_id, r.n_tokens) for r in after)
    order = sorted(after, key=lambda r: r.start)
    assert [r.start for r in order] == [sum(r.n_tokens for r in order[:i]) for i in range(len(order))]
    ids = [r.doc_id for r in order]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))


def test_run_is_its_stages_one_after_the_other(stages):
    assert collections.Counter(map(tuple, stages["run"][1])) == collections.Counter(map(tuple, stages["token output"][1]))


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


