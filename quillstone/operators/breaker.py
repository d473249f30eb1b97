"""The circuit breaker of calls to providers, as an automaton that is folded in parts.

Each provider and model has a count of failures and the end of a pause. A call at or after the pause's end is attempted, one before it is not. A success sets the
count to zero, at any time, and does not end a pause; a failure counts unless it falls into a pause; the second in a row begins a pause of 60
seconds and sets the count to zero.

A key's calls are cut into slices of time. A slice is a map of states, from what the slices before leave to what it leaves: the pause that
it inherits ends within its first 60 seconds or outlasts it, and where it ends decides the rest, so the map is a short list of cases. All
slices of all keys are folded at once, the maps of a key are then applied one after the other (a scan over rows of slices, not of calls),
and each slice is run again from the state it begins with. No key is held by one task, however many calls it has.

:class:`Breaker` is the automaton itself, for the slices and for streams.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .limits import BREAK_AFTER, BREAK_S

NO_PAUSE = -(1 << 63)
_PAUSE_US = BREAK_S * 1_000_000
#: Seconds of a slice: a few thousand calls even of a busy provider.
SLICE_S = 3600


class Breaker:
    """One key's state: failures in a row, and the end of the pause in microseconds."""

    def __init__(self, failures: int = 0, until: int = NO_PAUSE):
        self.failures, self.until = failures, until

    def call(self, us: int, ok: bool | None) -> bool:
        """Whether a call is attempted; its outcome changes the state. A call without an outcome changes nothing."""
        attempted = us >= self.until
        if ok:
            self.failures = 0
        elif ok is not None and attempted:
            self.failures += 1
            if self.failures >= BREAK_AFTER:
                self.failures, self.until = 0, us + _PAUSE_US
        return attempted


def state_map(times: list[int], oks: list[bool | None]) -> tuple[list[tuple[int, list[int]]], bool]:
    """The map of a slice of calls in order: (bound, left) cases and whether any call succeeded.

    The first case whose bound is not before the inherited pause's end holds; ``left`` has failures and pause for each number of failures
    inherited. If none holds, the pause outlasts the slice: it stays, and so do the failures unless a call succeeded.
    """
    n = len(times)
    # by place of the first call behind the pause: what is left for each number of failures
    left: list[list[tuple[int, int]]] = [[(f, NO_PAUSE) for f in range(BREAK_AFTER)]]
    for i in range(n - 1, -1, -1):
        behind = left[-1]
        if oks[i] is None:
            left.append(behind)
        elif oks[i]:
            left.append([behind[0]] * BREAK_AFTER)
        else:
            until = times[i] + _PAUSE_US
            j = bisect_left(times, until, i + 1)
            tripped = left[n - j][0] if j < n else (0, until)
            left.append([*behind[1:], tripped])
    left.reverse()
    cases: list[tuple[int, list[int]]] = []
    success = False
    for j in range(n):
        if j and times[j - 1] >= times[0] + _PAUSE_US:
            break
        now = [left[j][0]] * BREAK_AFTER if success else left[j]
        flat = [x for pair in now for x in pair]
        if cases and cases[-1][1] == flat:
            cases.pop()
        cases.append((times[j], flat))
        success = success or bool(oks[j])
    if n and times[-1] < times[0] + _PAUSE_US:
        return cases, any(bool(x) for x in oks)
    # no inherited pause is longer than the slice: the last case holds for all others
    cases[-1] = (times[-1], cases[-1][1])
    return cases, False


def applied(cases: list[tuple[int, list[int]]], success: bool, failures: int, until: int) -> tuple[int, int]:
    """The state that a slice leaves."""
    for bound, flat in cases:
        if until <= bound:
            return flat[2 * failures], flat[2 * failures + 1]
    return 0 if success else failures, until


def _runs(batches: Iterator, keys: list[str], values: list[str]) -> Iterator:
    """(key, columns) of consecutive rows of equal keys, over the bounds of batches."""
    key, held = None, None
    for batch in batches:
        columns = {c: batch.column(c).to_pylist() for c in (*keys, *values)}
        marks = list(zip(*(columns[k] for k in keys)))
        start = 0
        while start < len(marks):
            end = start
            while end < len(marks) and marks[end] == marks[start]:
                end += 1
            if held is None or marks[start] != key:
                if held is not None:
                    yield key, held
                key, held = marks[start], {v: [] for v in values}
            for v in values:
                held[v].extend(columns[v][start:end])
            start = end
    if held is not None:
        yield key, held


_KEY = ["provider", "model", "slice"]
_CASES = "array<struct<bound:bigint,left:array<bigint>>>"


def _map_task(batches):
    import pyarrow as pa

    kind = pa.list_(pa.struct([("bound", pa.int64()), ("left", pa.list_(pa.int64()))]))
    for (provider, model, piece), held in _runs(batches, _KEY, ["us", "ok"]):
        cases, success = state_map(held["us"], held["ok"])
        yield pa.record_batch(
            {
                "provider": pa.array([provider], pa.string()), "model": pa.array([model], pa.string()), "slice": pa.array([piece], pa.int64()),
                "cases": pa.array([[{"bound": b, "left": x} for b, x in cases]], kind), "success": pa.array([success]),
            }
        )


def _scan_task(batches):
    import pyarrow as pa

    key, failures, until = None, 0, NO_PAUSE
    for batch in batches:
        out = {c: [] for c in (*_KEY, "failures", "until")}
        for row in batch.to_pylist():
            own = row["provider"], row["model"]
            if own != key:
                key, failures, until = own, 0, NO_PAUSE
            for c, v in zip(out, (*own, row["slice"], failures, until)):
                out[c].append(v)
            failures, until = applied([(c["bound"], c["left"]) for c in row["cases"]], row["success"], failures, until)
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        yield pa.record_batch({c: pa.array(v, k) for (c, v), k in zip(out.items(), kinds)})


def _run_task(batches):
    import pyarrow as pa

    for (provider, model, _), held in _runs(batches, _KEY, ["head", "failures", "until", "us", "nth", "ok"]):
        state = Breaker(held["failures"][0], held["until"][0])  # the first row is the state
        attempted, failures, until = [], [], []
        for us, ok in zip(held["us"][1:], held["ok"][1:]):
            attempted.append(state.call(us, ok))
            failures.append(state.failures)
            until.append(state.until if state.until > us else None)
        n = len(attempted)
        yield pa.record_batch(
            {
                "provider": pa.array([provider] * n, pa.string()), "model": pa.array([model] * n, pa.string()), "nth": pa.array(held["nth"][1:], pa.int64()),
                "attempted": pa.array(attempted, pa.bool_()), "failures": pa.array(failures, pa.int64()), "until": pa.array(until, pa.int64()),
            }
        )


def breaker(calls: DataFrame, provider: str = "provider", model: str = "model", at: str = "ts", ok: str = "ok", nth: str = "event_id", slice_s: int = SLICE_S) -> DataFrame:
    """(provider, model, nth, attempted, failures, cool_until) of every call, in the order of time and ``nth``: whether it is attempted, and the count and
    the end of a present pause after it. Null providers and models are keys of their own; calls without a time are left out."""
    us = F.unix_micros(F.col(at).cast("timestamp"))
    rows = calls.select(F.col(provider).cast("string").alias("provider"), F.col(model).cast("string").alias("model"), us.alias("us"), F.col(nth).cast("long").alias("nth"), F.col(ok).alias("ok"))
    rows = rows.filter("us IS NOT NULL").withColumn("slice", F.floor(F.col("us") / (slice_s * 1_000_000)))
    dealt = rows.repartition(*_KEY).sortWithinPartitions(*_KEY, "us", "nth")
    key = "provider string, model string"
    maps = dealt.mapInArrow(_map_task, f"{key}, slice long, cases {_CASES}, success boolean")
    begins = maps.repartition("provider", "model").sortWithinPartitions(*_KEY).mapInArrow(_scan_task, f"{key}, slice long, failures long, until long")
    met = rows.withColumn("head", F.lit(1)).unionByName(begins.withColumn("head", F.lit(0)), allowMissingColumns=True)
    run = met.repartition(*_KEY).sortWithinPartitions(*_KEY, "head", "us", "nth").mapInArrow(_run_task, f"{key}, nth long, attempted boolean, failures long, until long")
    return run.select("provider", "model", F.col("nth").alias(nth), "attempted", "failures", F.timestamp_micros("until").alias("cool_until"))
