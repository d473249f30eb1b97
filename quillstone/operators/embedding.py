"""Embedding of lists of texts by a chain of providers.

All texts of a list (a document's chunks) get their vectors from one provider. A provider that cannot serve a list is passed over beforehand.
Texts are sent in batches. A batch whose size or payload is rejected is halved, again and again; other failures are retried, within a number of
retries a list, unless nothing of the list has been embedded (its first batch fails) or waiting cannot help (a daily quota, a batch
that is too large): then the list moves to the next provider, and after the last one through the chain again, ``CHAIN_ROUNDS`` times in all. What
no provider serves is reported with the last error.

Every list is at its own place in this; a round sends what is pending of all of them as one frame of calls and writes two tables, the
answers and the segments pending next. Vectors of earlier rounds stay where they are written and are not asked for again; the last join takes, for each list, those of the
provider that served it. The number of rounds grows with the logarithm of a batch and with the chain, not with the data.

In the reference rule a list's batches follow one another and stop at the first that is lost; here they are sent together, so a list that
fails may have been sent in part. What is served, and by whom, is the same.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..tables import dropped, shared_folder, written

# --- fixed values -----------------------------------------------------------------------------------------------
CHAIN_ROUNDS, RETRIES = 2, 2
CHARS_A_TOKEN = 3.5
BATCHES = {"gemini": 20, "jina": 50}
DAILY_TEXTS, MINUTE_TOKENS, JINA_TOKENS = 900, 25_000, 90_000
# ----------------------------------------------------------------------------------------------------------------
#: Texts of one call to a provider that takes a list as a whole; such a provider's answers do not depend on it.
WHOLE = 256

SEGMENT = ["list_id", "turn", "batch", "attempt", "lo", "hi", "n_texts", "tokens", "used"]


@dataclass(frozen=True)
class Provider:
    """``call`` maps calls (the columns of ``SEGMENT`` and ``texts``, an array of (position, text)) to the same columns with ``vectors`` (an array of
    arrays, in the order of ``texts``), or ``message``, ``code`` and ``kind`` (of a limit: per_minute, daily, batch_too_large) of an error.
    ``can_serve`` is a condition on ``n_texts`` and ``tokens`` of a list."""

    name: str
    call: Callable[[DataFrame], DataFrame]
    batch: int = WHOLE
    can_serve: Column | None = None


def estimated_tokens(text: Column) -> Column:
    """Tokens of a text, at least one; halves go to the even number."""
    return F.greatest(F.lit(1), F.bround(F.length(text) / CHARS_A_TOKEN)).cast("long")


def quota_of(name: str) -> Column:
    """Whether a list can be within the known limits of a provider, without asking it."""
    if name == "gemini":
        return F.col("n_texts") <= DAILY_TEXTS
    return F.col("tokens") <= JINA_TOKENS if name == "jina" else F.lit(True)


def _next_turn(after: Column, providers: list[Provider], rounds: int) -> Column:
    """The first turn behind ``after`` whose provider can serve the list; null if there is none."""
    can = [F.lit(True) if p.can_serve is None else p.can_serve for p in providers]
    turns = [F.when((F.lit(t) > after) & can[t % len(providers)], F.lit(t)) for t in range(rounds * len(providers))]
    return F.coalesce(*turns)


def _of_provider(providers: list[Provider], turn: str = "turn") -> Column:
    return F.element_at(F.array(*[F.lit(p.batch) for p in providers]), (F.col(turn) % len(providers) + 1).cast("int"))


def _segments(lists: DataFrame, providers: list[Provider]) -> DataFrame:
    """All batches of lists (list_id, n_texts, tokens, turn), first attempts."""
    size = _of_provider(providers)
    rows = lists.withColumn("batch", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_texts") - 1) / size).cast("int"))))
    rows = rows.withColumns({"attempt": F.lit(1), "used": F.lit(0), "lo": F.col("batch") * size})
    return rows.withColumn("hi", F.least(F.col("lo") + size, F.col("n_texts"))).select(*SEGMENT)


def _answers(pending: DataFrame, texts: DataFrame, providers: list[Provider]) -> DataFrame:
    out = None
    for nth, p in enumerate(providers):
        own = pending.filter(F.col("turn") % len(providers) == nth)
        held = own.join(texts.withColumn("batch", F.floor(F.col("position") / p.batch).cast("int")), ["list_id", "batch"])
        held = held.filter((F.col("position") >= F.col("lo")) & (F.col("position") < F.col("hi")))
        calls = held.groupBy(*SEGMENT).agg(F.sort_array(F.collect_list(F.struct("position", "text"))).alias("texts"))  # a batch at most
        answer = p.call(calls).select(*SEGMENT, F.lit(p.name).alias("provider"), F.col("texts.position").alias("positions"), "vectors", "message", "code", "kind")
        out = answer if out is None else out.unionByName(answer)
    return out


def _judged(answers: DataFrame) -> DataFrame:
    """Answers with ``outcome``: served, split or failed."""
    split = L.is_splittable(F.col("provider"), F.col("message"), F.col("code")) & F.col("kind").isNull() & (F.col("hi") - F.col("lo") > 1)
    return answers.withColumn("outcome", F.when(F.col("message").isNull(), "served").when(F.coalesce(split, F.lit(False)), "split").otherwise("failed"))


def _next(judged: DataFrame, providers: list[Provider], rounds: int, retries: int) -> DataFrame:
    """Segments pending after a round; a list that no provider is left for has one row, without a turn and with its ``error``."""
    failed = F.col("outcome") == "failed"
    hopeless = failed & F.coalesce(F.col("kind") != "per_minute", F.lit(False))
    per_batch = judged.groupBy("list_id", "turn", "batch").agg(
        F.max(failed).alias("failed"), F.max(hopeless).alias("hopeless"), F.min_by("message", F.when(failed, F.col("lo"))).alias("error"), F.max("attempt").alias("attempt"),
        *[F.max(c).alias(c) for c in ("n_texts", "tokens", "used")],
    )
    per_list = per_batch.groupBy("list_id", "turn").agg(
        (F.max("used") + F.count_if("failed")).cast("int").alias("used"), F.max(F.col("failed") & (F.col("batch") == 0)).alias("first_failed"), F.count_if("failed").alias("n_failed"),
        F.max("hopeless").alias("hopeless"), F.min_by("error", F.when(F.col("failed"), F.col("batch"))).alias("error"), F.max("n_texts").alias("n_texts"), F.max("tokens").alias("tokens"),
    )
    lost = (F.col("n_failed") > 0) & (F.col("first_failed") | F.col("hopeless") | (F.col("used") > retries))
    per_list = per_list.withColumn("lost", lost)
    stay = per_list.filter(~F.col("lost")).select("list_id", "turn", "used")
    middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    halves = judged.filter("outcome = 'split'").drop("used").join(stay, ["list_id", "turn"]).join(per_batch.filter("failed").select("list_id", "turn", "batch"), ["list_id", "turn", "batch"], "left_anti")
    halves = halves.withColumn("part", F.explode(F.array(F.struct(F.col("lo").alias("lo"), middle.alias("hi")), F.struct(middle.alias("lo"), F.col("hi").alias("hi")))))
    halves = halves.withColumns({"lo": F.col("part.lo"), "hi": F.col("part.hi")}).select(*SEGMENT)
    size = _of_provider(providers)
    again = per_batch.filter("failed").drop("used").join(stay, ["list_id", "turn"]).withColumns({"attempt": F.col("attempt") + 1, "lo": F.col("batch") * size})
    again = again.withColumn("hi", F.least(F.col("lo") + size, F.col("n_texts"))).select(*SEGMENT)
    moved = per_list.filter("lost").withColumn("turn", _next_turn(F.col("turn"), providers, rounds))
    fresh = _segments(moved.filter("turn IS NOT NULL"), providers)
    over = moved.filter("turn IS NULL").select("list_id", "error")
    return halves.unionByName(again).unionByName(fresh).withColumn("error", F.lit(None).cast("string")).unionByName(over, allowMissingColumns=True)


def embedded(texts: DataFrame, providers: list[Provider], rounds: int = CHAIN_ROUNDS, retries: int = RETRIES) -> DataFrame:
    """texts (list_id, position from 0, text) -> (list_id, position, provider, attempt, embedding, error): a row a text, with an embedding or the error for which its
    list was given up.

    A list without a provider that can serve it has the error ``no provider``. A null text counts as empty; null list ids are not embedded and not returned.
    """
    spark = texts.sparkSession
    folder = shared_folder(spark, "embedding-chain")
    texts = texts.filter("list_id IS NOT NULL").select("list_id", F.col("position").cast("int").alias("position"), F.coalesce("text", F.lit("")).alias("text"))
    lists = texts.groupBy("list_id").agg((F.max("position") + 1).alias("n_texts"), F.sum(estimated_tokens(F.col("text"))).alias("tokens"))
    lists = lists.withColumn("turn", _next_turn(F.lit(-1), providers, rounds))
    unserved = lists.filter("turn IS NULL").select("list_id", F.lit("no provider").alias("error"))
    pending = _segments(lists.filter("turn IS NOT NULL"), providers).withColumn("error", F.lit(None).cast("string")).unionByName(unserved, allowMissingColumns=True)
    pending, n, states = written(pending, f"{folder}/pending/{0}"), 0, []
    while True:
        states.append(pending.filter("turn IS NULL").select("list_id", "error"))
        if not pending.filter("turn IS NOT NULL").head(1):
            break
        answers = written(_judged(_answers(pending.filter("turn IS NOT NULL").drop("error"), texts, providers)), f"{folder}/answers/{n}")
        pending = written(_next(answers, providers, rounds, retries), f"{folder}/pending/{n + 1}")
        n += 1
    given_up = states[0]
    for s in states[1:]:
        given_up = given_up.unionByName(s)
    missing = texts.select("list_id", "position").join(given_up, "list_id")
    missing = missing.select("list_id", "position", F.lit(None).cast("string").alias("provider"), F.lit(None).cast("int").alias("attempt"), F.lit(None).cast("array<double>").alias("embedding"), "error")
    if not n:
        return written(missing, f"{folder}/result")
    every = spark.read.schema(answers.schema).parquet(*[f"{folder}/answers/{i}" for i in range(n)])
    told = every.drop("vectors", "positions")
    last = told.groupBy("list_id").agg(F.max("turn").alias("turn")).join(given_up, "list_id", "left_anti")
    tries = told.join(last, ["list_id", "turn"]).groupBy("list_id", "turn", "batch").agg(F.max("attempt").alias("attempt"))
    served = every.filter("outcome = 'served'").join(tries, ["list_id", "turn", "batch", "attempt"])
    rows = served.select("list_id", "provider", "attempt", F.explode(F.arrays_zip("positions", "vectors")).alias("v"))
    rows = rows.select("list_id", F.col("v.positions").alias("position"), "provider", "attempt", F.col("v.vectors").alias("embedding"), F.lit(None).cast("string").alias("error"))
    result = written(rows.unionByName(missing), f"{folder}/result")
    for part in ("answers", "pending"):
        dropped(spark, f"{folder}/{part}")
    return result


def rule_provider(name: str, error: Column, code: Column | None = None, kind: Column | None = None, dimension: int = 4, batch: int | None = None, can_serve: Column | None = None) -> Provider:
    """A stand-in without a service: vectors are digits of each text's hash; ``error`` (null: none), ``code`` and ``kind`` are conditions on a call."""
    coordinate = lambda h, i: F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("double") / 4294967296.0
    vector = lambda t: F.array(*[coordinate(F.md5(t["text"].cast("binary")), i) for i in range(dimension)])

    def call(calls: DataFrame) -> DataFrame:
        told = calls.withColumn("message", error)
        failed = F.col("message").isNotNull()
        none = F.lit(None)
        return told.withColumns(
            {
                "vectors": F.when(~failed, F.transform("texts", vector)),
                "code": F.when(failed, none.cast("int") if code is None else code),
                "kind": F.when(failed, none.cast("string") if kind is None else kind),
            }
        )

    return Provider(name, call, batch or BATCHES.get(name, WHOLE), quota_of(name) if can_serve is None else can_serve)
