"""Breakers, admissions and progress: literal cases, brute force, and streams that replay the batch answers."""

import random

import pytest
from pyspark.sql import functions as F

from quillstone.operators import breaker as B
from quillstone.operators import lifecycle, limits
from quillstone.streaming import limits as S

SECOND = 1_000_000


def automaton(calls):
    """The breaker of one key, call by call; calls are (us, ok)."""
    state = B.Breaker()
    return [(state.call(us, ok), state.failures, state.until if state.until > us else None) for us, ok in calls]


def test_breaker_literal_cases():
    run = lambda *calls: automaton([(s * SECOND, ok) for s, ok in calls])
    assert run((0, False), (1, True), (2, False)) == [(True, 1, None), (True, 0, None), (True, 1, None)]
    # two in a row begin a pause of 60 seconds, and the count is zero again
    assert run((0, False), (1, False), (2, False), (61, False), (62, False)) == [(True, 1, None), (True, 0, 61 * SECOND), (False, 0, 61 * SECOND), (True, 1, None), (True, 0, 122 * SECOND)]
    # a success does not end a pause
    assert run((0, False), (1, False), (2, True), (3, False)) == [(True, 1, None), (True, 0, 61 * SECOND), (False, 0, 61 * SECOND), (False, 0, 61 * SECOND)]


def test_maps_of_slices_are_the_automaton():
    rng = random.Random(6)
    for _ in range(3000):
        times = sorted(rng.randrange(200) * SECOND for _ in range(rng.randrange(1, 15)))
        oks = [rng.choice([True, False, False, None]) for _ in times]
        failures, until = rng.randrange(2), rng.choice([B.NO_PAUSE, times[0] - 5, times[0] + rng.randrange(60) * SECOND])
        state = B.Breaker(failures, until)
        for us, ok in zip(times, oks):
            state.call(us, ok)
        got = B.applied(*B.state_map(times, oks), failures, until)
        live = lambda u: u if u > times[-1] else None  # noqa: E731  a pause that is over is none
        assert (got[0], live(got[1])) == (state.failures, live(state.until))


@pytest.mark.parametrize("slice_s", [7, 60, 3600])
def test_breaker_equals_one_fold_of_each_key(spark, slice_s):
    rng = random.Random(slice_s)
    rows = [(rng.choice(["a", "a", "a", None]), rng.choice(["m", "n"]), i, rng.randrange(400), rng.choice([True, False, False, None])) for i in range(900)]
    df = spark.createDataFrame(rows, "provider string, model string, event_id long, s long, ok boolean").withColumn("ts", F.timestamp_seconds("s"))
    df = df.unionByName(spark.createDataFrame([("a", "m", -1, None, True)], "provider string, model string, event_id long, s long, ok boolean").withColumn("ts", F.lit(None).cast("timestamp")))
    got = {r.event_id: (r.attempted, r.failures, r.u) for r in B.breaker(df, slice_s=slice_s).withColumn("u", F.unix_micros("cool_until")).collect()}
    want = {}
    for key in {r[:2] for r in rows}:
        own = sorted((r for r in rows if r[:2] == key), key=lambda r: (r[3], r[2]))
        want |= dict(zip((r[2] for r in own), automaton([(r[3] * SECOND, r[4]) for r in own])))
    assert got == want


def test_breaker_of_no_calls(spark):
    assert B.breaker(spark.createDataFrame([], "provider string, model string, event_id long, ts timestamp, ok boolean")).count() == 0


def replayed(spark, tmp_path, rows, schema, function, files, name):
    """All results of a stream over ``rows``, one file a batch; rows come in any order within the allowed delay."""
    folder = tmp_path / name
    cuts = [len(rows) * i // files for i in range(files + 1)]
    for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    query = function(stream, late="200 seconds").writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{folder}/at").trigger(availableNow=True).start()
    query.awaitTermination(300)
    return spark.table(name).collect()


def shuffled(rng, rows, at):
    """Rows out of order by less than 200 seconds, and one far behind that lets the watermark pass them all."""
    return sorted(rows, key=lambda r: at(r) + rng.randrange(90))


@pytest.mark.parametrize("files", [1, 7])
def test_streams_give_the_batch_answer(spark, tmp_path, files):
    import datetime

    rng = random.Random(files)
    stamp = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    calls = [(rng.choice("aab"), i, rng.randrange(600), rng.choice([True, False, False])) for i in range(300)]
    calls = shuffled(rng, calls, lambda r: r[2]) + [("end", 10**6, 10**6, True)]
    rows = [(k, i, stamp(s), ok) for k, i, s, ok in calls]
    schema = "key string, event_id long, ts timestamp, ok boolean"
    got = {(r.key, r.event_id): (r.attempted, r.failures, r.cool_until) for r in replayed(spark, tmp_path, rows, schema, S.breakers, files, f"paused{files}")}
    batch = spark.createDataFrame([(k, "", i, t, ok) for k, i, t, ok in rows if k != "end"], "provider string, model string, event_id long, ts timestamp, ok boolean")
    want = {(r.provider, r.event_id): (r.attempted, r.failures, r.cool_until) for r in B.breaker(batch).collect()}
    assert got == want and any(v[2] for v in want.values())
    got = {(r.key, r.event_id): r.admitted for r in replayed(spark, tmp_path, [r[:3] for r in rows], "key string, event_id long, ts timestamp", S.admissions, files, f"admitted{files}")}
    batch = spark.createDataFrame([r[:3] for r in rows if r[0] != "end"], "user_id string, event_id long, ts timestamp")
    assert got == {(r.user_id, r.event_id): r.admitted for r in limits.admissions(batch).collect()} and not all(got.values())
    nodes = [(f"run{i % 9}", i, t, "formatter" if i % 61 == 60 else rng.choice(["planner", "writer", "critic"])) for _, i, t, _ in rows[:-1]]
    got = replayed(spark, tmp_path, [*nodes, ("end", 10**6, stamp(10**6), "planner")], "run_id string, event_id long, ts timestamp, node string", S.node_progress, files, f"progress{files}")
    want = lifecycle.node_progress(spark.createDataFrame(nodes, "run_id string, event_id long, ts timestamp, node string")).collect()
    key = lambda r: (r.run_id, r.nth)
    assert [tuple(r) for r in sorted(got, key=key)] == [tuple(r) for r in sorted(want, key=key)]
    assert sum(r.stage == "done" for r in got) >= 3


def test_progress_ends_with_done(spark):
    rows = [("r", 1, 0, "planner"), ("r", 2, 3, "writer"), ("r", 3, 4, "formatter"), ("r", 4, 5, "critic"), ("cached", 5, 9, "formatter")]
    df = spark.createDataFrame(rows, "run_id string, event_id long, s long, node string").withColumn("ts", F.timestamp_seconds("s"))
    got = sorted((r.run_id, r.nth, r.stage, r.ms) for r in lifecycle.node_progress(df).collect())
    assert got == [("cached", 1, "formatter", None), ("cached", 2, "done", 0.0), ("r", 1, "planner", None), ("r", 2, "writer", 3000.0), ("r", 3, "formatter", 1000.0), ("r", 4, "done", 0.0)]
