"""Quality rules: n-gram perplexity under a modified Kneser-Ney model counted by Spark, with bands per language.

The model is over characters as they stand (code points, case kept), of order 5, one for each language by its name. Tasks count the
n-grams of every document, Spark adds the counts up and computes the interpolated model in joins and windows over
(language, n-gram) tables, which grow with the corpus. Counts of lower orders are those of distinct left neighbours. An n-gram
that stands in one distinct text only is left to its lower order: a text does not vouch for itself, so what no other text
has is improbable however often the text repeats it.

The result, a log-probability for each n-gram of the corpus, lies in arrays sorted by a 64-bit hash of language and n-gram. With
at most ``most_entries`` n-grams (counted first) the arrays are broadcast. Beyond, documents stay where they are in a table of
parts, every part asks for the n-grams that stand in it, and meets their probabilities and its documents in one task, the
probabilities first (:func:`_score_in_parts`). Both ways give the same figures.

A document's log-perplexity is the negative log-probability of all its characters after the fourth, by word: junk in words
(signs, fused words, tables) costs more a word than prose does, while by character it would hide among cheap repetitions.

A document goes if the base rules fail it or if its log-perplexity lies outside its language's band ``[q2 - spread * (q2 - q1),
q2 + spread * (q3 - q2)]`` around the median, of the quartiles over all documents of that language that pass the base rules (no
narrower than ``least_width`` to each side).

Defined cases: a null text counts as empty (no words, ``base_failed``); a null language is a language of its own; texts without
words or shorter than one n-gram have no perplexity and are judged by the base rules alone; repeated rows are judged alike and each
stays; an empty table gives an empty result; other columns of any name pass through untouched inside ``row``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textarrays as ta
from .common import bounded_batches, materialize, release, text_of, trimmed

ORDER = 5
#: N-grams that are broadcast at most: 12 bytes each.
MOST_ENTRIES = 1 << 21
#: Distinct n-grams that a counting task holds before it hands them on.
MOST_HELD = 400_000
#: Code points of texts that are grouped at once; their places fit into 22 bits.
AT_ONCE = 700_000
#: N-grams of a file of the model's tables, at most on average.
FILE_GRAMS = 50_000
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)


def language_key(name):
    """Languages by name; null is one of its own."""
    return F.coalesce(F.concat(F.lit("="), name), F.lit(""))


def _seeds(keys: pa.Array) -> np.ndarray:
    """A 64-bit hash of each language."""
    coded = keys.dictionary_encode()
    seeds = [int.from_bytes(hashlib.blake2b(k.encode(), digest_size=8).digest(), "little") for k in coded.dictionary.to_pylist()]
    return np.array(seeds, np.uint64)[np.asarray(coded.indices)] if len(keys) else np.zeros(0, np.uint64)


def _hashes(points: np.ndarray, starts: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Hashes of language and n-gram for the n-grams that begin at ``starts`` of ``points``."""
    rolled = np.zeros(max(len(points) - ORDER + 1, 0), np.uint64)
    for j in range(ORDER):
        rolled *= _STEP
        rolled += points[j : j + len(rolled)]
    return ta.mix64(rolled[starts] + seeds)


class Grams:
    """All n-grams of some texts, text by text: their hashes, sorted; ``order`` says where each stands."""

    def __init__(self, text: pa.Array, seeds: np.ndarray):
        raw, bounds = ta.flat_bytes(text)
        lead = (raw & 0xC0) != 0x80
        at = np.concatenate([[0], np.cumsum(lead)])[bounds]
        self.points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        full = np.maximum(np.diff(at) - ORDER + 1, 0)
        self.bounds = np.concatenate([[0], np.cumsum(full)]).astype(np.int64)
        self.owner = np.repeat(np.arange(len(full), dtype=np.int32), full)
        self.starts = np.arange(self.bounds[-1]) + np.repeat(at[:-1] - self.bounds[:-1], full)
        h = _hashes(self.points, self.starts, seeds[self.owner])
        if len(h) <= 1 << 22:  # a plain sort of shortened hashes with their places; n-grams that it mixes up fall into more groups
            short = np.sort(h >> np.uint64(22) << np.uint64(22) | np.arange(len(h), dtype=np.uint64))
            self.order = (short & np.uint64((1 << 22) - 1)).astype(np.int32)
        else:
            self.order = np.argsort(h)
        h = h[self.order]
        self.first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        self.hash = h[self.first]
        self.count = np.diff(np.append(self.first, len(h)))

    def spell(self) -> np.ndarray:
        """Code points of each distinct n-gram."""
        return self.points[self.starts[self.order[self.first]][:, None] + np.arange(ORDER)]


def _strings(points: np.ndarray) -> pa.Array:
    """Rows of code points as strings."""
    size = (1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)).sum(1)
    data = points.astype("<u4").tobytes().decode("utf-32-le", "replace").encode()
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(points), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


_COUNTS = "lang_key string, gram string, n long, multi boolean, who long"


def _count_task(batches):
    """Counts of distinct n-grams; ``who`` is a hash of the one text that has it, ``multi`` says that there are more."""
    held: list[tuple] = []
    names: list[str] = []
    number: dict[str, int] = {}

    def merged():
        h, lang, points, n, multi, who = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(h, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(h[order]) != 0]))
        low, high = np.minimum.reduceat(who[order], first), np.maximum.reduceat(who[order], first)
        many = np.logical_or.reduceat(multi[order], first) | (low != high)
        one = order[first]
        return h[one], lang[one], points[one], np.add.reduceat(n[order], first), many, low

    def out():
        _, lang, points, n, multi, who = merged()
        for i in range(0, len(n), 50_000):
            part = slice(i, i + 50_000)
            keys = pa.DictionaryArray.from_arrays(pa.array(lang[part]), pa.array(names)).cast(pa.string())
            yield pa.record_batch({"lang_key": keys, "gram": _strings(points[part]), "n": pa.array(n[part]), "multi": pa.array(multi[part]), "who": pa.array(np.where(multi[part], 0, who[part]))})

    for batch in batches:
        text, keys, texts = batch.column("text"), batch.column("lang_key"), np.asarray(batch.column("x"))
        coded = keys.dictionary_encode()
        for k in coded.dictionary.to_pylist():
            if k not in number:
                number[k] = len(names)
                names.append(k)
        lang = np.array([number[k] for k in coded.dictionary.to_pylist()], np.int32)[np.asarray(coded.indices)]
        seeds = _seeds(keys)
        for a, b in ta.slices(text, AT_ONCE):
            g = Grams(text.slice(a, b - a), seeds[a:b])
            if not len(g.hash):
                continue
            owner = g.owner[g.order]
            who = texts[a:b][owner]
            low, high = np.minimum.reduceat(who, g.first), np.maximum.reduceat(who, g.first)
            held.append((g.hash, lang[a:b][owner[g.first]], g.spell(), g.count, low != high, low))
            if sum(len(x[0]) for x in held) > MOST_HELD:
                held = [merged()]
                if len(held[0][0]) > MOST_HELD // 2:
                    yield from out()
                    held = []
    if held:
        yield from out()


def gram_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang_key, gram, n, multi, who) over all documents: ``multi``, whether more than one distinct text has the n-gram."""
    t = text_of(docs, text)
    rows = docs.select(t.alias("text"), language_key(F.col(f"`{lang}`").cast("string")).alias("lang_key"), F.xxhash64(t).alias("x"))
    found = rows.mapInArrow(trimmed(_count_task), _COUNTS)
    return found.groupBy("lang_key", "gram").agg(F.sum("n").alias("n"), *_apart())


def _apart():
    single = F.when(~F.col("multi"), F.col("who"))
    return (F.max("multi") | F.coalesce(F.min(single) != F.max(single), F.lit(False))).alias("multi"), F.coalesce(F.min(single), F.lit(0)).alias("who")


def _by_language(rows: DataFrame):
    """How to join tables of one row a language: broadcast, so that a large language is not dealt to one task, if languages are few."""
    return F.broadcast if rows.select("lang_key").distinct().count() <= 100_000 else lambda table: table


def kneser_ney(counts: DataFrame) -> DataFrame:
    """(lang_key, gram, p) for every n-gram in ``counts``: interpolated modified Kneser-Ney probabilities of its last character.

    ``counts`` is read several times: pass a written table. Each order is written, too.
    """
    tables = [counts.select("lang_key", "gram", "n", "multi", "who")]
    rows_of = [counts.count()]
    for _ in range(ORDER - 1):
        upper = tables[0].select("lang_key", F.substring("gram", 2, ORDER).alias("gram"), "multi", "who")
        lower = upper.groupBy("lang_key", "gram").agg(F.count("*").alias("n"), *_apart())
        tables.insert(0, materialize(lower, "gram-counts-below", rows_of[0], FILE_GRAMS))
        rows_of.insert(0, tables[0].count())
    small = _by_language(counts)
    below = None
    for order, table in enumerate(tables, 1):
        of = F.least("n", F.lit(4))
        seen = table.groupBy("lang_key").agg(*[F.count_if(of == i).cast("double").alias(f"n{i}") if i < 4 else F.count_if(F.col("n") == 4).cast("double").alias("n4") for i in range(1, 5)])
        y = F.when((F.col("n1") > 0) & (F.col("n2") > 0), F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(F.lit(0.5))
        cuts = [
            F.greatest(F.lit(0.05), F.least(F.lit(i - 0.05), F.when(F.col(f"n{i}") > 0, i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}")).otherwise(F.lit(0.5 * i))))
            for i in (1, 2, 3)
        ]
        discounts = seen.select("lang_key", F.array(*cuts).alias("cut"))
        kept = F.when(F.col("multi"), F.col("n") - F.get("cut", (F.least("n", F.lit(3)) - 1).cast("int"))).otherwise(F.lit(0.0))
        context = Window.partitionBy("lang_key", F.substring("gram", 1, order - 1))
        rows = table.join(small(discounts), "lang_key").withColumn("own", kept)
        rows = rows.withColumn("total", F.sum("n").over(context)).withColumn("left", 1 - F.sum("own").over(context) / F.col("total"))
        if below is None:
            letters = table.groupBy("lang_key").agg((F.count("*") + 1).alias("letters"))  # and one for all others
            rows = rows.join(small(letters), "lang_key").withColumn("lower", 1 / F.col("letters"))
        else:
            rows = rows.withColumn("suffix", F.substring("gram", 2, ORDER)).join(below.select("lang_key", F.col("gram").alias("suffix"), F.col("p").alias("lower")), ["lang_key", "suffix"])
        below = rows.select("lang_key", "gram", (F.col("own") / F.col("total") + F.col("left") * F.col("lower")).alias("p"))
        below = materialize(below, "gram-model", rows_of[order - 1], FILE_GRAMS)  # an order at a time: small plans
    return below


def text_stats(raw: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts of each text."""
    inside = ta.SPACE[raw]
    starts, ends = ta.stretches(raw, bounds, inside)
    words = np.searchsorted(starts, bounds)
    lead = (raw & 0xC0) != 0x80
    out = {
        "n_words": np.diff(words),
        "word_chars": ta.per_text(inside & lead, bounds),
        "n_symbols": ta.per_text(SYMBOLS[raw], bounds),
    }
    line_starts, line_ends = ta.stretches(raw, bounds, raw != 10)
    worded = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends = line_starts[worded], line_ends[worded]
    lines = np.searchsorted(line_starts, bounds)
    unique = np.diff(ta.distinct(ta.stretch_hashes(raw, line_starts, line_ends), lines)[1])
    out["n_dup_lines"] = np.diff(lines) - unique
    three, three_bounds = ta.shingle_hashes(ta.stretch_hashes(raw, starts, ends), words, 3)
    who = ta.owners(three_bounds)
    key = ta.mix64(three + who.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    same = np.zeros(len(key), bool)
    if len(key) > 1:
        twin = key[order[1:]] == key[order[:-1]]
        same[order[1:]] |= twin
        same[order[:-1]] |= twin
    hit = np.zeros(len(starts) + 2, bool)
    at = np.flatnonzero(same)
    at = at - three_bounds[who[at]] + words[who[at]]
    for j in range(3):
        hit[at + j] = True
    out["n_repeat_words"] = ta.per_text(hit[: len(starts)], words)
    return {k: v.astype(np.int64) for k, v in out.items()}


STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _hash_task(batches):
    for batch in batches:
        grams = batch.column("gram")
        points = np.frombuffer("".join(grams.to_pylist()).encode("utf-32-le"), np.uint32)
        h = _hashes(points, ORDER * np.arange(len(grams)), _seeds(batch.column("lang_key")))
        cols = {c: batch.column(c) for c in batch.schema.names if c in ("part",)}
        yield pa.record_batch({**cols, "h": pa.array(h.view(np.int64)), "logp": pa.array(np.log(np.asarray(batch.column("p"))).astype(np.float32))})


def _sorted_arrays(h: np.ndarray, logp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = h.view(np.uint64)
    order = np.argsort(h)
    return h[order], logp[order]


def _scored(batch, keys: np.ndarray, logp: np.ndarray, text_name: str):
    """Rows of a batch with counts and log-perplexity, under a model in sorted arrays."""
    text = batch.column("text") if "text" in batch.schema.names else batch.column("row").field(text_name).cast(pa.string())
    seeds = _seeds(batch.column("lang_key"))
    for a, b in ta.slices(text, AT_ONCE):
        stats = text_stats(*ta.flat_bytes(text.slice(a, b - a)))
        g = Grams(text.slice(a, b - a), seeds[a:b])
        value = np.zeros(len(g.order), np.float64)
        if len(g.hash):
            at = np.searchsorted(keys, g.hash)
            if not (keys[np.minimum(at, len(keys) - 1)] == g.hash).all():
                raise ValueError("the documents are not those that were counted")
            value[g.order] = np.repeat(logp[at].astype(np.float64), g.count)
        none = (np.diff(g.bounds) == 0) | (stats["n_words"] == 0)
        mean = -ta.per_text(value, g.bounds) / np.maximum(stats["n_words"], 1)
        cols = {"row": batch.column("row").slice(a, b - a), "lang_key": batch.column("lang_key").slice(a, b - a)}
        cols |= {k: pa.array(stats[k]) for k in STATS} | {"log_ppl": pa.array(mean, mask=none)}
        yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))


def _score_task(model, text_name):
    def task(batches):
        keys, logp = model.value
        for batch in batches:
            yield from _scored(batch, keys, logp, text_name)

    return trimmed(task)


def _parts_task(text_name):
    """Of rows in order of part: first its n-grams with their probabilities, then its documents."""

    def task(batches):
        part, held, model = None, [], None
        for batch in batches:
            parts = np.asarray(batch.column("part"))
            cuts = np.flatnonzero(np.diff(parts)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(parts)]):
                piece = batch.slice(a, b - a)
                if parts[a] != part:
                    part, held, model = parts[a], [], None
                docs = np.asarray(piece.column("is_doc").cast(pa.int8())).astype(bool)
                n = int((~docs).sum())
                if n:
                    held.append(tuple(np.array(piece.column(c).slice(0, n)) for c in ("h", "logp")))
                if n < len(piece):
                    if model is None:
                        model = _sorted_arrays(*(np.concatenate(x) for x in zip(*held))) if held else (np.zeros(0, np.uint64), np.zeros(0, np.float32))
                        held = []
                    yield from _scored(piece.slice(n), *model, text_name)

    return trimmed(task)


def _wanted_task(batches):
    """(part, lang_key, gram): the distinct n-grams of each part, batch by batch."""
    for batch in batches:
        text, keys = batch.column("text"), batch.column("lang_key")
        seeds = _seeds(keys)
        for a, b in ta.slices(text, AT_ONCE):
            g = Grams(text.slice(a, b - a), seeds[a:b])
            if len(g.hash):
                at = g.order[g.first]
                yield pa.record_batch({"part": batch.column("part").slice(a, b - a).take(pa.array(g.owner[at])), "lang_key": keys.slice(a, b - a).take(pa.array(g.owner[at])), "gram": _strings(g.spell())})


def _score_in_parts(rows: DataFrame, model: DataFrame, text: str, schema) -> DataFrame:
    """Scores where the model is too large for a broadcast: the table of parts fixes which documents are together."""
    stored = materialize(rows.withColumn("part", F.spark_partition_id()), "quality-parts")
    text_in = F.col("text") if "text" in rows.columns else F.coalesce(F.col("row").getField(text).cast("string"), F.lit(""))
    wanted = stored.select(text_in.alias("text"), "lang_key", "part").mapInArrow(trimmed(_wanted_task), "part int, lang_key string, gram string").distinct()
    answers = wanted.join(model, ["lang_key", "gram"]).select("part", "lang_key", "gram", "p").mapInArrow(trimmed(_hash_task), "part int, h long, logp float")
    answers = answers.withColumn("is_doc", F.lit(False))
    both = stored.withColumn("is_doc", F.lit(True)).unionByName(answers, allowMissingColumns=True)
    n = stored.agg(F.max("part")).collect()[0][0]
    dealt = both.repartitionById((n or 0) + 1, "part").sortWithinPartitions("part", "is_doc")
    return dealt.mapInArrow(_parts_task(text), schema)


def score(docs: DataFrame, text: str = "text", lang: str = "lang", keep: list[str] | None = None, most_entries: int = MOST_ENTRIES) -> DataFrame:
    """``row`` (the columns in ``keep``; all of them if None), lang_key, the base counts and ``log_ppl`` of every document."""
    spark = docs.sparkSession
    bounded_batches(spark)
    counts = materialize(gram_counts(docs, text, lang), "gram-counts")
    model = kneser_ney(counts)
    keep = docs.columns if keep is None else keep
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"),
        *([] if text in keep else [text_of(docs, text).alias("text")]),  # a text that is kept is sent once
        language_key(F.col(f"`{lang}`").cast("string")).alias("lang_key"),
    )
    schema = rows.drop("text").schema
    for name in STATS:
        schema = schema.add(name, "long")
    schema = schema.add("log_ppl", "double")
    if model.count() > most_entries:
        return _score_in_parts(rows, model, text, schema)
    table = model.mapInArrow(_hash_task, "h long, logp float").toArrow()
    arrays = _sorted_arrays(*(table.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("h", "logp")))
    told = spark.sparkContext.broadcast(arrays)
    del table, arrays
    release()
    return rows.mapInArrow(_score_task(told, text), schema)


def judge(scored: DataFrame, spread: float = 6.0, least_width: float = 0.2) -> DataFrame:
    """Add base_failed, perplexity, the language's band and kept. ``scored`` is read twice: pass a written table."""
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    q = F.col("q")
    bands = (
        scored.filter(~base & F.col("log_ppl").isNotNull())
        .groupBy("lang_key")
        .agg(F.percentile_approx("log_ppl", [0.25, 0.5, 0.75], 10000).alias("q"))
        .select(
            "lang_key",
            (q[1] - F.greatest(F.lit(least_width), spread * (q[1] - q[0]))).alias("band_low"),
            (q[1] + F.greatest(F.lit(least_width), spread * (q[2] - q[1]))).alias("band_high"),
        )
    )
    bands = materialize(bands, "bands")
    inside = F.coalesce(F.col("log_ppl").between(F.col("band_low"), F.col("band_high")), F.lit(True))
    return (
        scored.join(_by_language(bands)(bands), "lang_key", "left")
        .withColumn("base_failed", base)
        .withColumn("perplexity", F.exp(F.least("log_ppl", F.lit(700.0))))
        .withColumn("kept", ~base & inside)
    )


def quality(docs: DataFrame, text: str = "text", lang: str = "lang", keep: list[str] | None = None, most_entries: int = MOST_ENTRIES, **bands) -> DataFrame:
    """Every document's ``row``, counts, perplexity and verdict."""
    return judge(materialize(score(docs, text, lang, keep, most_entries), "quality-scores"), **bands)
