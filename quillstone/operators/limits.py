"""Limits of calls to providers: sliding windows, waits, cool-downs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

# --- fixed values -----------------------------------------------------------------------------------------------
REQUESTS_MINUTE, TOKENS_MINUTE, REQUESTS_DAY = 80, 25_000, 900
WINDOW_S, DAY_S, MARGIN_S = 60, 86_400, 0.25
PACE_S, BREAK_AFTER, BREAK_S = 3.5, 2, 60
EMPTY_PER_MINUTE = 5
# ----------------------------------------------------------------------------------------------------------------


def usage(events: DataFrame, key: str = "user_id", at: str = "ts", requests: str = "requests", tokens: str = "tokens") -> DataFrame:
    """Each event with what its key used in the last minute and day; an event expires when its age reaches the window."""
    rows = events.withColumn("_us", F.unix_micros(F.col(at).cast("timestamp")))
    span = lambda s: Window.partitionBy(key).orderBy("_us").rangeBetween(-(s * 1_000_000 - 1), 0)
    out = rows.withColumns({"requests_minute": F.sum(requests).over(span(WINDOW_S)), "tokens_minute": F.sum(tokens).over(span(WINDOW_S)), "requests_day": F.sum(requests).over(span(DAY_S))})
    over = F.when(F.col(tokens) > TOKENS_MINUTE, "batch_too_large").when(F.col("requests_day") > REQUESTS_DAY, "daily").when((F.col("requests_minute") > REQUESTS_MINUTE) | (F.col("tokens_minute") > TOKENS_MINUTE), "per_minute")
    return out.withColumn("limit_hit", over).drop("_us")


class SlidingLimiter:
    """Admission by a sliding minute of requests and tokens and a day of requests; plain state, for workers and tests."""

    def __init__(self, requests: int = REQUESTS_MINUTE, tokens: int = TOKENS_MINUTE, per_day: int = REQUESTS_DAY, events: list | None = None):
        self.requests, self.tokens, self.per_day = requests, tokens, per_day
        self.events: list[tuple[float, int, int]] = list(events or [])

    def _within(self, now: float, span: float) -> list[tuple[float, int, int]]:
        return [e for e in self.events if e[0] + span > now]

    def wait(self, now: float, requests: int, tokens: int) -> float:
        """Seconds until a batch fits; infinity if the day's quota is used or the batch can never fit."""
        if tokens > self.tokens or requests > self.requests or sum(e[1] for e in self._within(now, DAY_S)) + requests > self.per_day:
            return math.inf
        held = sorted(self._within(now, WINDOW_S))
        r, t, pause = sum(e[1] for e in held), sum(e[2] for e in held), 0.0
        for at, n, k in held:
            if r + requests <= self.requests and t + tokens <= self.tokens:
                break
            r, t, pause = r - n, t - k, at + WINDOW_S - now + MARGIN_S
        return pause

    def reserve(self, now: float, requests: int, tokens: int) -> bool:
        ok = self.wait(now, requests, tokens) == 0.0
        if ok:
            self.events = [*self._within(now, DAY_S), (now, requests, tokens)]
        return ok

    def simulate(self, batches: list[tuple[int, int]], now: float = 0.0) -> float:
        """Seconds that batches sent one after the other spend waiting."""
        total = 0.0
        for requests, tokens in batches:
            pause = self.wait(now, requests, tokens)
            if math.isinf(pause):
                return pause
            total, now = total + pause, now + pause
            self.events.append((now, requests, tokens))
        return total


def simulated_waits(batches: DataFrame, key: str = "document_id", order: str = "batch_no", requests: str = "requests", tokens: str = "tokens") -> DataFrame:
    """(key, wait_s): the waiting of each key's batches, sent one after the other. A key's batches are one small group."""
    import pandas as pd

    kind = batches.schema[key].dataType.simpleString()

    def one(frame):
        frame = frame.sort_values(order)
        wait = SlidingLimiter().simulate(list(zip(frame[requests].astype(int), frame[tokens].astype(int))))
        return pd.DataFrame({key: [frame[key].iloc[0]], "wait_s": [float(wait)]})

    return batches.groupBy(key).applyInPandas(one, f"`{key}` {kind}, wait_s double")


def admitted(times: list[float], most: int = EMPTY_PER_MINUTE, span: float = WINDOW_S) -> list[bool]:
    """Which calls a limit of ``most`` in a sliding window admits; refused calls don't count."""
    kept: list[float] = []
    out = []
    for t in times:
        kept = [k for k in kept if k + span > t]
        out.append(len(kept) < most)
        if out[-1]:
            kept.append(t)
    return out


def admissions(calls: DataFrame, key: str = "user_id", at: str = "ts", nth: str = "event_id", most: int = EMPTY_PER_MINUTE) -> DataFrame:
    """Calls with ``admitted``. What is admitted depends on what was before, so a key's calls run in order in one task,
    in Arrow batches with the few admitted times as the only state."""
    names = calls.columns
    schema = StructType([*calls.schema.fields, StructField("admitted", BooleanType())])

    def task(frames):
        state, last = [], object()
        for frame in frames:
            flags = []
            for k, t in zip(frame[key], frame["_s"]):
                if k != last:
                    state, last = [], k
                state = [x for x in state if x + WINDOW_S > t]
                flags.append(len(state) < most)
                if flags[-1]:
                    state.append(t)
            yield frame[names].assign(admitted=flags)

    rows = calls.withColumn("_s", F.unix_micros(F.col(at).cast("timestamp")) / 1e6)
    n = int(calls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, key).sortWithinPartitions(key, at, nth).mapInPandas(task, schema)
