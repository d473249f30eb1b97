"""Grounding: whether items are supported by the passages that they cite; scores and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..tables import dropped, shared_folder, written

# --- fixed values -----------------------------------------------------------------------------------------------
NEGATIONS = ["no", "nunca", "jamás", "jamas", "sin", "excepto", "neither", "nor", "not", "never", "without", "except"]
MIN_RESOLVE, MIN_EXTRACT, MIN_CLAIM = 0.25, 0.45, 0.25
#: Rarest words of an item that look for passages first, and the numbers of 64 bits in the bitmap of a sieve.
FIRST, SLOTS = 2, 1 << 19
# ----------------------------------------------------------------------------------------------------------------


def words(c: Column) -> Column:
    """Distinct lower-cased words of four and more letters or digits."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([\p{L}\p{N}_]{4,})"), F.lit(1)))


def negations(c: Column) -> Column:
    all_words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    return F.array_distinct(F.filter(all_words, lambda w: w.isin(NEGATIONS)))


def number_marks(c: Column, strict: bool = False) -> Column:
    """What the numeric gate compares: the decimal suffixes of numbers, empty for whole ones; ``strict``: the numbers."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\b\d+([.,]\d+)?\b"), F.lit(0 if strict else 1))
    return F.array_distinct(F.transform(found, lambda x: F.coalesce(x, F.lit(""))))


def share(part: Column, whole: Column) -> Column:
    """Of the first set's words, the share that the second has; 0 for an empty set."""
    return F.when(F.size(part) > 0, F.size(F.array_intersect(part, whole)) / F.size(part)).otherwise(0.0)


def verdict(extract: Column, claim: Column, grounding: Column, passage: Column, strict: bool = False) -> Column:
    """Whether a passage supports a source.

    A verbatim extract settles it. Else the claim's negations and numbers must occur in the passage, and enough of the
    extract's words, or without an extract of the grounding text's words.
    """
    e, p = F.lower(F.btrim(F.coalesce(extract, F.lit("")))), F.lower(F.btrim(F.coalesce(passage, F.lit(""))))
    verbatim = (e != "") & (p.contains(e) | e.contains(p))
    gates = (F.size(F.array_except(negations(claim), negations(p))) == 0) & (F.size(F.array_except(number_marks(claim, strict), number_marks(p, strict))) == 0)
    by_extract = (F.size(words(e)) > 0) & (share(words(e), words(p)) >= MIN_EXTRACT)
    by_claim = (e == "") & (share(words(grounding), words(p)) >= MIN_CLAIM)
    return (p != "") & (verbatim | (gates & (by_extract | by_claim)))


def aliases(passages: DataFrame, chunk: str = "chunk_id", text: str = "content", run: str = "run_id", order: str = "chunk_id") -> DataFrame:
    """(run, alias, content): a passage by its id and by what stands before ``_child_`` in it, later passages winning; and by its id
    without a number at the end, if nothing else has that name, earlier ones winning. ``order``: the order of passages."""
    rows = passages.select(run, F.col(chunk).alias("alias"), F.col(text).alias("content"), F.col(order).alias("n"))
    parent = F.when(F.col("alias").contains("_child_"), F.regexp_replace("alias", r"(?s)^(.*)_child_.*$", "$1"))
    short = F.nullif(F.regexp_replace("alias", r"[-_]\d+$", ""), F.col("alias"))
    named = rows.select(run, F.explode(F.array_compact(F.array("alias", parent))).alias("alias"), "content", "n")
    late = named.groupBy(run, "alias").agg(F.max_by("content", "n").alias("late"))
    early = rows.select(run, short.alias("alias"), "content", "n").filter("alias <> ''").groupBy(run, "alias").agg(F.min_by("content", "n").alias("early"))
    return late.join(early, [run, "alias"], "full").select(run, "alias", F.coalesce("late", "early").alias("content"))


def _named(passages: DataFrame, run: str, order: str) -> DataFrame:
    """(run, chunk_id, n, mark): the passages that :func:`aliases` names, without their texts; null where the text is empty."""
    state = F.when(F.col("content").isNull(), 0).when(F.col("content") == "", 1).otherwise(2)
    own = F.struct(F.col(order).alias("n"), F.xxhash64("content").alias("mark"), state.alias("state"))
    ids = aliases(passages.select(run, "chunk_id", order, F.when(F.col("content").isNotNull(), own).alias("own")), text="own", run=run, order=order)
    text = lambda c: F.when(F.col("content.state") == 2, F.col(f"content.{c}")).alias(c)
    return ids.select(run, F.col("alias").alias("chunk_id"), text("n"), text("mark"))


def _texts(passages: DataFrame, run: str, order: str) -> DataFrame:
    """(run, n, mark, content), each once."""
    rows = passages.select(run, F.col(order).alias("n"), F.xxhash64("content").alias("mark"), "content")
    return rows.groupBy(run, "n", "mark").agg(F.first("content").alias("content"))


def _sieved(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows whose number ``h`` is wanted, and some others: a bitmap of ``SLOTS`` * 64 bits is broadcast, however many are wanted."""
    slot = F.pmod("h", F.lit(SLOTS)).alias("slot")
    bit = F.expr(f"shiftleft(1L, CAST(pmod(shiftrightunsigned(h, {SLOTS.bit_length() - 1}), 64) AS INT))").alias("bit")
    bits = wanted.select(slot, bit).groupBy("slot").agg(F.bit_or("bit").alias("bits"))
    return rows.withColumns({"slot": slot, "bit": bit}).join(F.broadcast(bits), "slot").filter(F.col("bits").bitwiseAND(F.col("bit")) != 0).drop("slot", "bit", "bits")


def _nearest(items: DataFrame, passages: DataFrame, run: str, key: str, text: str, order: str) -> DataFrame:
    """(run, key, n, mark) of the passage that :func:`best_overlap` finds."""
    spark = items.sparkSession
    folder = shared_folder(spark, "nearest")
    item_words = items.select(run, key, F.array_sort(words(F.col(text))).alias("ws")).filter(F.size("ws") > 0)
    # items of equal words are one
    asked = written(item_words.select(run, "ws").distinct().withColumn("g", F.monotonically_increasing_id()), f"{folder}/asked")
    mark = F.xxhash64("content").alias("mark")
    hashes = F.transform(words(F.col("content")), lambda w: F.hash(F.col(run), w))
    held = written(passages.select(F.col(order).alias("n"), mark, hashes.alias("hs")), f"{folder}/words")
    postings = held.select("n", "mark", F.explode("hs").alias("h"))
    each = asked.select("g", F.size("ws").alias("of"), F.explode(F.transform("ws", lambda w: F.hash(F.col(run), w))).alias("h"))
    own = F.struct("n", "mark")
    rarity = _sieved(postings, each).groupBy("h").agg(F.count("*").alias("df"), F.min(own).alias("lead"))
    whole = Window.partitionBy("g")
    facts = [F.row_number().over(whole.orderBy("df", "h")).alias("place"), F.count("*").over(whole).alias("p"), F.max("lead").over(whole).alias("top")]
    placed = written(each.join(rarity, "h").select("g", "of", "h", "lead", *facts), f"{folder}/placed")

    def compared(pairs: DataFrame, best: DataFrame | None, n: int) -> DataFrame:
        pairs = written(pairs.distinct().withColumn("h", F.hash("n", "mark")), f"{folder}/pairs/{n}")
        met = _sieved(passages.select(run, F.col(order).alias("n"), mark, "content").withColumn("h", F.hash("n", "mark")), pairs)
        full = pairs.drop("h").join(asked, "g").join(met.select(run, "n", "mark", words(F.col("content")).alias("pw")), [run, "n", "mark"])
        scored = full.select("g", F.struct((-F.size(F.array_intersect("ws", "pw"))).alias("less"), "n", "mark").alias("best"))
        scored = scored if best is None else scored.union(best)
        return written(scored.groupBy("g").agg(F.min("best").alias("best")), f"{folder}/best/{n}")

    # the first passage of a rare word, if it holds all words that any passage holds, is the first that does
    leads = placed.filter(F.col("place") <= FIRST).select("g", F.explode(F.array("lead", "top")).alias("c")).select("g", "c.n", "c.mark")
    best, before, upto, n = compared(leads, None, 0), 0, FIRST, 1
    looking = postings.select("n", "mark", F.col("h").alias("held"))
    while True:
        rare = placed.join(best, "g", "left").withColumn("miss", F.col("p") + F.coalesce("best.less", F.lit(0))).filter("miss > 0")
        # what is as good as the best so far misses no more words than it; what is better misses fewer
        rare = rare.filter((F.col("place") > before) & (F.col("place") <= F.least(F.col("miss") + 1, F.col("p") - F.ceil(F.col("of") * MIN_RESOLVE - 1e-9) + 1)))
        if not rare.head(1):
            break
        rare = rare.filter(F.col("place") <= upto).select("g", "h", "place", "miss", F.col("best.n").alias("least"), F.col("top.n").alias("top"))
        as_good = F.col("least").isNull() | (F.col("n") < F.col("least"))
        better = (F.col("place") <= F.col("miss")) & ((F.col("miss") > 1) | (F.col("n") >= F.col("top")))
        pairs = rare.join(_sieved(looking.withColumn("h", F.col("held")), rare).drop("h"), (F.col("h") == F.col("held")) & (as_good | better))
        best = compared(pairs.select("g", "n", "mark"), best, n)
        before, upto, n = upto, upto * 4, n + 1
    found = best.join(asked, "g").filter(-F.col("best.less") / F.size("ws") >= MIN_RESOLVE)
    found = found.select(run, "ws", "best.n", "best.mark")
    result = written(item_words.join(found, [run, "ws"]).select(run, key, "n", "mark"), f"{folder}/result")
    for part in ("asked", "words", "placed", "pairs", "best"):
        dropped(spark, f"{folder}/{part}")
    return result


def best_overlap(items: DataFrame, passages: DataFrame, run: str = "run_id", key: str = "gid", text: str = "grounding_text", order: str = "chunk_id") -> DataFrame:
    """(run, key, content): for each item its run's passage that holds most of its words, if a quarter; ties: the first in ``order``.

    A passage that misses m of an item's words holds one of any m + 1 of them. First the first passages of an item's rarest words are compared:
    one that holds all words that any passage holds settles it. Else the rarest words look for passages that miss no more than the best so far
    and stand before it, or miss fewer. Words are met as numbers, behind a bitmap of those that look; what counts is then counted by the words
    themselves. Each step writes its table.
    """
    found = _nearest(items, passages, run, key, text, order)
    return found.join(_texts(passages, run, order), [run, "n", "mark"]).groupBy(run, key).agg(F.min("content").alias("content"))


def verify(items: DataFrame, sources: DataFrame, passages: DataFrame, run: str = "run_id", key: str = "gid", language: str | None = "Spanish", strict: bool = False, order: str = "chunk_id") -> DataFrame:
    """(run, key, chunk_id, verified) for every source of every item.

    items: run, key, claim_text, grounding_text. sources: run, key, chunk_id, extracto. passages: run, chunk_id,
    content and ``order``. A source that names no passage is tried with the passage that shares most words. Passages are found without their
    texts, which join once.
    """
    named = sources.select(run, key, "chunk_id", "extracto").join(_named(passages, run, order), [run, "chunk_id"], "left")
    named = written(named, shared_folder(items.sparkSession, "named"))
    texts = items.select(run, key, "claim_text", "grounding_text")
    lost = named.filter(F.col("n").isNull()).select(run, key).distinct().join(texts.drop("claim_text"), [run, key]).distinct()
    fallback = _nearest(lost, passages, run, key, "grounding_text", order).groupBy(run, key).agg(F.min(F.struct("n", "mark")).alias("near"))
    rows = named.join(fallback, [run, key], "left")
    own = F.col("n").isNotNull()
    rows = rows.withColumns({"n": F.when(own, F.col("n")).otherwise(F.col("near.n")), "mark": F.when(own, F.col("mark")).otherwise(F.col("near.mark"))})
    rows = rows.drop("near").join(texts, [run, key]).join(_texts(passages, run, order), [run, "n", "mark"], "left")
    ok = verdict(F.col("extracto"), F.col("claim_text"), F.col("grounding_text"), F.col("content"), strict)
    ok = F.coalesce(ok, F.lit(False)) & T.is_language_pure(F.col("grounding_text"), language)
    return rows.select(run, key, "chunk_id", ok.alias("verified"))


def grounded(items: DataFrame, verified: DataFrame, run: str = "run_id", key: str = "gid") -> DataFrame:
    """Items with ``grounded``: any source verified; without sources false."""
    per = verified.groupBy(run, key).agg(F.bool_or("verified").alias("grounded"))
    return items.join(per, [run, key], "left").withColumn("grounded", F.coalesce("grounded", F.lit(False)))


def with_critic(items: DataFrame, records: DataFrame, run: str = "run_id", key: str = "gid") -> DataFrame:
    """Items with the critic's vote (true without a record), clarity, and ``verified``: grounded and not voted down."""
    out = items.join(records.select(run, key, F.col("verified").alias("vote"), "clarity"), [run, key], "left")
    out = out.withColumn("vote", F.coalesce("vote", F.lit(True)))
    return out.withColumn("verified", F.col("grounded") & F.col("vote"))


def after_critic(items: DataFrame, run: str = "run_id") -> DataFrame:
    """Items that the critic flagged and that are not grounded go, unless a run would lose all."""
    flagged = ~F.col("vote") & ~F.col("grounded")
    left = items.groupBy(run).agg(F.count_if(~flagged).alias("left"))
    return items.join(left, run).filter(~flagged | (F.col("left") == 0)).drop("left")


def score(items: DataFrame, run: str = "run_id", ok: str = "verified") -> DataFrame:
    """(run, n, score): the verified share, to two places."""
    return items.groupBy(run).agg(F.count("*").alias("n"), F.bround(F.least(F.lit(1.0), F.sum(F.col(ok).cast("double")) / F.greatest(F.lit(1), F.count("*"))), 2).alias("score"))


def refreshed(old: DataFrame, new: DataFrame, run: str = "run_id", key: str = "gid") -> DataFrame:
    """Verdicts of ``new`` in place of those of ``old``."""
    fresh = new.select(run, key, *[F.col(c).alias(f"new_{c}") for c in ("vote", "clarity")])
    out = old.join(fresh, [run, key], "left")
    return out.withColumns({c: F.coalesce(f"new_{c}", c) for c in ("vote", "clarity")}).drop("new_vote", "new_clarity")


def route(items: DataFrame, targets: DataFrame, run: str = "run_id") -> DataFrame:
    """(run, route): repair if an item is ungrounded or unclear and not repaired; refiner if the run is short of its
    target and its text bears more; else formatter. targets: run, target, capacity."""
    weak = (~F.col("verified") | F.coalesce(F.col("clarity"), F.lit("")).isin("Baja", "Low")) & ~F.col("repaired")
    per = items.groupBy(run).agg(F.bool_or(weak).alias("weak"), F.count("*").alias("n"))
    out = targets.join(per, run, "left")
    n = F.coalesce("n", F.lit(0))
    choice = F.when(F.coalesce("weak", F.lit(False)), "repair").when((n < F.col("target")) & (F.col("capacity") > n), "refiner").otherwise("formatter")
    return out.select(run, choice.alias("route"))


def completion(items: DataFrame, topics: DataFrame, targets: DataFrame, run: str = "run_id", fmt: str = "flashcards") -> DataFrame:
    """Deterministic items for what a run is short of, its topics taken in turn. topics: run, topic_no, topic, context."""
    from .items import fallback_items

    have = targets.join(items.groupBy(run).agg(F.count("*").alias("n")), run, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    gap = have.filter(F.col("target") > F.col("n")).select(run, F.explode(F.sequence("n", F.col("target") - 1)).alias("item_idx"))
    n_topics = topics.groupBy(run).agg(F.count("*").alias("n_topics"))
    place = gap.join(n_topics, run).withColumn("topic_no", F.pmod("item_idx", "n_topics"))
    return fallback_items(place.join(topics, [run, "topic_no"]), fmt)


def fallback_cascade(run_step, attempts: int = 1):
    """At most ``attempts`` rounds of a step (frame -> frame, done); the loop of repair and refinement is bounded."""

    def loop(frame: DataFrame) -> DataFrame:
        for _ in range(attempts):
            frame, done = run_step(frame)
            if done:
                break
        return frame

    return loop
