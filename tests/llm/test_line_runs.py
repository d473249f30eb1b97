"""Line dedup against a brute-force version, its runs, and its defined cases."""

import collections
import hashlib
import random

import pytest

from quillstone.llm import line_runs, queries

BLANK = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(BLANK).translate(LOWER)


def brute(rows, shortest=40, least=5):
    """(doc_id, n_lines, n_dropped, text) of rows (doc_id, text), each row a document."""
    holders = collections.defaultdict(list)
    for i, t in rows:
        for k in {key(line) for line in (t or "").split("\n")}:
            holders[k].append(float("-inf") if i is None else i)
    out = []
    for i, t in rows:
        own = float("-inf") if i is None else i
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(key(x)) < shortest or len(holders[key(x)]) < least or max(holders[key(x)]) == own]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


def rows_of(seed, n):
    rng = random.Random(seed)
    shared = [" ".join(rng.choice(["Éa", "word", "ñu", "LINE", "of", "text"]) for _ in range(12)) for _ in range(8)]
    edge = ["x" * 39, "x" * 40, "é" * 40, " \t" + "Y" * 40 + "\r", "\x1c" + "y" * 40, "y" * 40]
    own = lambda i: f"a line that only document {i} holds, long enough to count"
    rows = []
    for i in range(n):
        lines = rng.sample(shared, rng.randrange(0, 6)) + rng.sample(edge, 3) + [own(i)] * rng.randrange(0, 3) + [""]
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("batches,fan", [(1, 2), (4, 2), (5, 3)])
def test_equals_brute_force(spark, batches, fan):
    rows = [*rows_of(3, 60), (None, None), (None, ""), (7, rows_of(3, 60)[7][1]), (59, rows_of(3, 60)[59][1]), (-5, "é" * 40 + "\n" + "é" * 40), (None, "Y" * 40)]
    docs = spark.createDataFrame([(i, t, "r", 1, "l") for i, t in rows], "doc_id long, text string, row string, n_lines int, lost string").repartition(5)
    got = line_runs.dedup(docs, batches=batches, fan=fan).select("row.doc_id", "n_lines", "n_dropped", "text", "row.row", "row.lost").collect()
    assert all((r.row, r.lost) == ("r", "l") for r in got)
    order = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert sorted((tuple(r)[:4] for r in got), key=order) == sorted(brute(rows), key=order)


def test_empty_table(spark):
    assert line_runs.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_levels_and_anti_join(spark, tmp_path):
    runs = line_runs.LineRuns(spark, str(tmp_path), least=2, fan=2, buckets=4)
    batch = lambda rows: spark.createDataFrame([(k.encode(), i) for k, i in rows], "key binary, id long")
    runs.add(batch([("a", 9), ("a", 8), ("b", 9)]))
    # 'a' is settled: the second batch adds nothing of it; 'b' becomes settled when both runs are compacted
    runs.add(batch([("a", 3), ("b", 4), ("c", 4)]))
    assert [len(x) for x in runs.levels] == [0, 1]
    told = {bytes(r.key): (r.n, r.seq, r.holder) for r in spark.table(runs.runs()[0]).collect()}
    assert told == {b"a": (2, 0, 9), b"b": (2, 0, 9), b"c": (1, 1, 4)}
    fresh = batch([("a", 1), ("b", 1), ("d", 1)]).groupBy("key").count().withColumnRenamed("count", "n")
    assert {bytes(r.key) for r in runs.unsettled(fresh).collect()} == {b"d"}
    for i in range(3):
        runs.add(batch([(f"e{i}", 1), ("c", 0)]))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert {bytes(r.key): r.holder for r in runs.settled().collect()} == {b"a": 9, b"b": 9, b"c": 4}
    plan = runs.unsettled(fresh)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1  # of the batch alone
    names = runs.runs()
    runs.close()
    assert not runs.runs() and not any(spark.catalog.tableExists(n) for n in names) and not any(tmp_path.iterdir())


def test_query_returns_checksums(spark, tmp_path):
    rows = rows_of(9, 30)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in queries.op11_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {i: (n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in brute(rows)}
    assert sum(d for _, d, _ in got.values()) > 20
