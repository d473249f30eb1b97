"""The Kneser-Ney model against a plain version, both ways of scoring, and what the bands reject."""

import collections
import math
import random

import pytest

from quillstone.llm import quality_lm

ORDER = quality_lm.ORDER


def plain_model(rows):
    """p(last | before) for every n-gram of (language, text) rows, written with dictionaries."""
    out = {}
    for lang in {g for g, _ in rows}:
        count, texts = collections.Counter(), collections.defaultdict(set)
        for g, t in rows:
            for i in range(len(t or "") - ORDER + 1 if g == lang else 0):
                count[t[i : i + ORDER]] += 1
                texts[t[i : i + ORDER]].add(t)
        levels = [(count, texts)]
        for _ in range(ORDER - 1):
            upper, held = levels[0]
            lower, lower_texts = collections.Counter(g[1:] for g in upper), collections.defaultdict(set)
            for g, x in held.items():
                lower_texts[g[1:]] |= x
            levels.insert(0, (lower, lower_texts))
        below = None
        for n, x in levels:
            of = collections.Counter(n.values())
            y = of[1] / (of[1] + 2 * of[2]) if of[1] and of[2] else 0.5
            cut = {i: max(0.05, min(i - 0.05, i - (i + 1) * y * of[i + 1] / of[i] if of[i] else 0.5 * i)) for i in (1, 2, 3)}
            own = {g: c - cut[min(c, 3)] if len(x[g]) > 1 else 0.0 for g, c in n.items()}
            total, kept = collections.Counter(), collections.Counter()
            for g, c in n.items():
                total[g[:-1]] += c
                kept[g[:-1]] += own[g]
            here = {}
            for g in n:
                lower = 1 / (len(n) + 1) if below is None else below[g[1:]]
                here[g] = own[g] / total[g[:-1]] + (1 - kept[g[:-1]] / total[g[:-1]]) * lower
            below = here
        out.update({(lang, g): p for g, p in below.items()})
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    pool = ["the", "then", "there", "in", "inner", "dinner", "né", "日本語", "𝒳y", "of"]
    out = [(rng.choice(["en", "en", "fr", None]), " ".join(rng.choice(pool) for _ in range(rng.randrange(80)))) for _ in range(60)]
    return [*out, ("en", None), ("en", ""), ("en", "abc"), ("xx", "qqqqqqqqqq qqq"), out[0], out[0]]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, g, "z") for i, (g, t) in enumerate(rows)], "doc_id long, text string, lang string, n_words string")


def test_model_equals_a_plain_one(spark, rows):
    counts = quality_lm.gram_counts(docs_of(spark, rows))
    got = {(r.lang_key, r.gram): r.p for r in quality_lm.kneser_ney(counts).collect()}
    want = {("" if g is None else "=" + g, x): p for (g, x), p in plain_model(rows).items()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


def test_perplexity_equals_a_plain_one_both_ways(spark, rows):
    model = plain_model(rows)
    for most in (quality_lm.MOST_ENTRIES, 0):
        got = {r.doc_id: r.log_ppl for r in quality_lm.score(docs_of(spark, rows).repartition(3), most_entries=most).select("row.doc_id", "log_ppl").collect()}
        assert len(got) == len(rows)
        for i, (g, t) in enumerate(rows):
            words, grams = len((t or "").split()), [(t or "")[j : j + ORDER] for j in range(len(t or "") - ORDER + 1)]
            if not words or not grams:
                assert got[i] is None
            else:
                assert math.isclose(got[i], -sum(math.log(model[g, x]) for x in grams) / words, rel_tol=1e-5)


def test_counts_that_leave_a_task_early_add_up(spark, rows, monkeypatch):
    import pyarrow as pa

    batch = pa.record_batch({"text": pa.array([t or "" for _, t in rows]), "lang_key": pa.array([g or "" for g, _ in rows]), "x": pa.array(range(len(rows)), pa.int64())})

    def added():
        out = collections.Counter()
        for b in quality_lm._count_task([batch] * 3):
            out.update({(r["lang_key"], r["gram"]): 0 for r in b.to_pylist()})
            for r in b.to_pylist():
                out[r["lang_key"], r["gram"]] += r["n"]
        return out

    whole = added()
    monkeypatch.setattr(quality_lm, "MOST_HELD", 50)
    assert added() == whole


def test_bands_reject_junk_between_texts_of_the_language(spark):
    rng = random.Random(2)
    pool = [a + b for a in ("th", "en", "ou", "st", "re", "an") for b in ("e", "ing", "ed", "tion", "er", "of", "at")]
    prose = lambda n: [rng.choice(pool) for _ in range(n)]
    texts = [" ".join(prose(80)) for _ in range(200)]
    junk = [" ".join("".join(rng.choice("QXZJ0#%w") for _ in range(5)) for _ in range(80)) for _ in range(3)]
    junk += [" ".join(w + rng.choice(["$$$", "&&&", "%%%"]) for w in prose(80)) for _ in range(3)]  # signs behind every word
    junk += ["".join(x if x != " " or rng.random() < 0.4 else "" for x in " ".join(prose(200))) for _ in range(3)]  # words run together
    junk += [" ".join("".join(rng.sample(w, len(w))) for w in prose(80)) for _ in range(3)]  # letters of each word shuffled
    rows = [("en", t) for t in texts + junk]
    got = {r.doc_id: (r.kept, r.base_failed) for r in quality_lm.quality(docs_of(spark, rows)).select("row.doc_id", "kept", "base_failed").collect()}
    assert all(got[i] == (True, False) for i in range(200)) and all(got[i] == (False, False) for i in range(200, len(rows)))


def test_each_language_has_its_own_model(spark):
    langs = [f"l{i}" for i in range(400)]
    rows = [(g, "shared words of all languages and " + g) for g in langs for _ in range(2)]
    counts = quality_lm.gram_counts(docs_of(spark, rows)).groupBy("lang_key").count().collect()
    assert len(counts) == 400
