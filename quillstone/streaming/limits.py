"""Limits, breakers and progress over streams: rules that need a key's events in order, replayed from a buffer behind the watermark.

Events arrive in any order and in batches of any size. A key's events wait in its state until the watermark has passed them; then
an event-time timer takes them out in order of time and number and runs the rule over them. The result of a stream is therefore that
of the batch operators over the same events, however they were cut into batches; events later than the watermark allows are
dropped by Spark. A key's state is what the rule remembers, and the events of the allowed delay.

State of this kind needs the RocksDB state store (:func:`quillstone.session.get_session` sets it).
"""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..operators.breaker import NO_PAUSE, Breaker
from ..operators.lifecycle import LAST_NODE
from ..operators.limits import EMPTY_PER_MINUTE, WINDOW_S


class Admission:
    """Five calls in a sliding minute; refused calls do not count. Remembers the admitted times of the last minute."""

    state, out = "held array<bigint>", "admitted boolean"

    def __init__(self, held=()):
        self.held = list(held or ())

    def take(self, us: int, value: str | None) -> list[tuple]:
        self.held = [t for t in self.held if t + WINDOW_S * 1_000_000 > us]
        admitted = len(self.held) < EMPTY_PER_MINUTE
        if admitted:
            self.held.append(us)
        return [(admitted,)]

    def left(self) -> tuple:
        return (self.held,)


class Break:
    """The circuit breaker; values are ``ok`` and ``fail``."""

    state, out = "failures bigint, until bigint", "attempted boolean, failures bigint, cool_us bigint"

    def __init__(self, failures=0, until=NO_PAUSE):
        self.breaker = Breaker(failures, until)

    def take(self, us: int, value: str | None) -> list[tuple]:
        attempted = self.breaker.call(us, None if value is None else value == "ok")
        return [(attempted, self.breaker.failures, self.breaker.until if self.breaker.until > us else None)]

    def left(self) -> tuple:
        return self.breaker.failures, self.breaker.until


class Progress:
    """Stages of a run as its nodes finish, and ``done`` behind the last node; values are names of nodes. Nothing follows ``done``."""

    state, out = "n bigint, last bigint", "nth bigint, stage string, us bigint"

    def __init__(self, n=0, last=0):
        self.n, self.last = n, last

    def take(self, us: int, value: str | None) -> list[tuple]:
        if self.n < 0:
            return []
        self.n += 1
        out = [(self.n, value, us - self.last if self.n > 1 else None)]
        self.last = us
        if value == LAST_NODE:
            out.append((self.n + 1, "done", 0))
            self.n = -1
        return out

    def left(self) -> tuple:
        return self.n, self.last


class _Ordered(StatefulProcessor):
    """Runs a rule over each key's events in order, as the watermark passes them."""

    def __init__(self, rule):
        self.rule = rule

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us bigint, event_id bigint, value string")
        self.memory = handle.getValueState("memory", self.rule.state)

    def handleInputRows(self, key, rows, timerValues):
        first = None
        for frame in rows:
            events = [(int(u), int(i), v) for u, i, v in zip(frame["us"], frame["event_id"], frame["value"].astype(object).where(frame["value"].notna(), None))]
            if events:
                self.waiting.appendList(events)
                low = min(e[0] for e in events)
                first = low if first is None else min(first, low)
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        passed = timerValues.getCurrentWatermarkInMs() * 1000
        events = sorted(self.waiting.get(), key=lambda e: (e[0], e[1]))
        due = [e for e in events if e[0] < passed]
        rest = events[len(due) :]
        if not due:
            return
        rule = self.rule(*(self.memory.get() if self.memory.exists() else ()))
        out = [(key[0], i, *values) for us, i, value in due for values in rule.take(us, value)]
        self.memory.update(rule.left())
        if rest:
            self.waiting.put([tuple(e) for e in rest])
            self.handle.registerTimer(rest[0][0] // 1000 + 1)
        else:
            self.waiting.clear()
        names = ["key", "event_id", *[c.split(" ")[0] for c in self.rule.out.split(", ")]]
        if out:
            frame = pd.DataFrame(out, columns=names)
            yield frame.astype({c: "Int64" for c, kind in zip(names[2:], self.rule.out.split(", ")) if kind.endswith("bigint")})

    def close(self) -> None:
        pass


def ordered(events: DataFrame, rule, late: str = "10 minutes") -> DataFrame:
    """events (key string, event_id, ts, value string) -> (key, event_id, the rule's columns), once the watermark, ``late`` behind, has passed them."""
    rows = events.select("key", F.col("event_id").cast("long").alias("event_id"), "ts", F.unix_micros("ts").alias("us"), F.col("value").cast("string").alias("value"))
    keyed = rows.withWatermark("ts", late).groupBy("key")
    return keyed.transformWithStateInPandas(_Ordered(rule), f"key string, event_id bigint, {rule.out}", "append", "EventTime")


def admissions(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """events (key, event_id, ts) -> (key, event_id, admitted): five a minute for each key."""
    return ordered(events.withColumn("value", F.lit(None).cast("string")), Admission, late)


def breakers(calls: DataFrame, late: str = "10 minutes") -> DataFrame:
    """calls (key, event_id, ts, ok) -> (key, event_id, attempted, failures, cool_until); a key stands for a provider and a model."""
    out = ordered(calls.withColumn("value", F.when(F.col("ok"), "ok").when(~F.col("ok"), "fail")), Break, late)
    return out.select("key", "event_id", "attempted", "failures", F.timestamp_micros("cool_us").alias("cool_until"))


def node_progress(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """events (run_id, event_id, ts, node), one for each node that finished -> (run_id, event_id, nth, stage, ms)."""
    out = ordered(events.select(F.col("run_id").alias("key"), "event_id", "ts", F.col("node").alias("value")), Progress, late)
    return out.select(F.col("key").alias("run_id"), "event_id", "nth", "stage", (F.col("us") / 1000).alias("ms"))


def windowed_usage(events: DataFrame, late: str = "10 minutes", window: str = "1 minute") -> DataFrame:
    """Requests and values per type and minute with a watermark (an extension: the limits above use no event-time windows)."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type")
    return rows.agg(F.count("*").alias("requests"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "requests", "total")


def progress_sink(events: DataFrame, path: str, checkpoint: str):
    """A stream of progress events to files of server-sent frames."""
    from ..sources.store import sse_frames

    return sse_frames(events).writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
