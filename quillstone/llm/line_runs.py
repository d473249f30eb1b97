"""Line dedup: levelled sorted runs of line hashes.

A line's key is the line without ASCII white space at its ends and with A-Z lower-cased; keys of at least ``SHORTEST`` code
points count, each once a document, as 128-bit hashes. :class:`LineRuns` keeps what is known of the keys as sorted runs:
tables bucketed and sorted by key, so that a batch meets them in a merge join without another shuffle of theirs. Each new batch

1. merge-anti-joins the runs: keys that are settled there (found in ``least`` documents) add nothing,
2. adds what is left of it as a run of level 0, a row a key with the number of its documents and its holder.

``FAN`` runs of a level are compacted to one of the next level: counts are summed and the holder of the earliest batch stays. A key
is thus in few runs, whatever the number of batches, and each row is rewritten once a level.

The holder of a key is the largest id of the earliest batch that holds it; :func:`dedup` deals the documents by descending ids
into ``BATCHES`` batches, so that it is the largest id of all. Only hashes are shuffled for this, pre-aggregated by task. Then
each document meets the frequent keys that it holds and does not own, once, and its text loses their lines.

Defined cases: each row is a document; rows of one id in one batch; a null id is smaller than all others and all null ids are equal; a null
or empty text has one empty line; repeated rows count as often as they come, and those of the largest id all keep their lines; a key
that stands twice in one document counts once there, and is lost or kept with all its lines; an empty table gives an empty
result; other columns pass through inside ``row``.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, drop, materialize, shared_root, text_of, trimmed
from .textarrays import slices

SHORTEST, LEAST = 40, 5
#: Batches of :func:`dedup`, and runs of one level that are compacted.
BATCHES, FAN = 4, 2
#: Bytes of texts that are cut into lines at once.
SLICE = 4_000_000
_BLANK = " \t\n\v\f\r"
_NO_ID = -(1 << 63)


def line_keys(lines: pa.Array) -> pa.Array:
    """The keys of lines."""
    return pc.ascii_lower(pc.ascii_trim(lines, characters=_BLANK))


def _digests(keys: pa.Array) -> list[bytes]:
    digest = xxhash.xxh3_128_digest
    return [digest(k) for k in keys.cast(pa.large_binary()).to_pylist()]


def _keys_task(shortest: int):
    """(id, print, key) of each distinct long line of each text."""

    def task(batches):
        for batch in batches:
            text = batch.column("text").cast(pa.large_string())
            for a, b in slices(text, SLICE):
                split = pc.split_pattern(text.slice(a, b - a), "\n")
                keys = line_keys(pc.list_flatten(split))
                long = pc.greater_equal(pc.utf8_length(keys), shortest)
                owner = pc.list_parent_indices(split).filter(long)
                held = list(dict.fromkeys(zip(owner.to_pylist(), _digests(keys.filter(long)))))
                at = pa.array([o + a for o, _ in held], pa.int64())
                columns = [batch.column("id").take(at), batch.column("print").take(at), pa.array([k for _, k in held], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "print", "key"])

    return trimmed(task)


class LineRuns:
    """Sorted runs of (key, n, seq, holder) in levels, as bucketed tables below ``path``."""

    def __init__(self, spark: SparkSession, path: str, least: int = LEAST, fan: int = FAN, buckets: int | None = None):
        self.spark, self.path, self.least, self.fan = spark, path.rstrip("/"), least, fan
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.batches = 0

    def _write(self, rows: DataFrame) -> str:
        name = f"quillstone_run_{uuid.uuid4().hex}"
        # the shuffle of the aggregation below deals rows out as the buckets do
        rows.write.format("parquet").bucketBy(self.buckets, "key").sortBy("key").option("path", f"{self.path}/{name}").saveAsTable(name)
        return name

    def _forget(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            drop(self.spark, f"{self.path}/{name}")

    def runs(self) -> list[str]:
        """Names of all runs."""
        return [name for level in self.levels for name in level]

    def unsettled(self, keys: DataFrame) -> DataFrame:
        """The rows (key, n, ...) of ``keys`` whose key no run has settled: a merge anti-join with each run."""
        for name in self.runs():
            run = self.spark.table(name).filter(F.col("n") >= self.least).select(F.col("key").alias("known")).hint("merge")
            # a condition on n keeps the join above the count of the batch: only pre-aggregated keys are shuffled
            keys = keys.join(run, (F.col("key") == F.col("known")) & (F.col("n") > 0), "left_anti")
        return keys

    def add(self, held: DataFrame) -> None:
        """Add a batch of rows (key, id), one for each document that holds the key, and compact levels that are full."""
        own = held.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("holder"))
        fresh = self.unsettled(own).select("key", "n", F.lit(self.batches).cast("long").alias("seq"), "holder")
        self.batches += 1
        self.levels = self.levels or [[]]
        self.levels[0].append(self._write(fresh))
        level = 0
        while len(self.levels[level]) >= self.fan:
            if level + 1 == len(self.levels):
                self.levels.append([])
            full, self.levels[level] = self.levels[level], []
            self.levels[level + 1].append(self._write(self._merged(full)))
            self._forget(full)
            level += 1

    def _merged(self, names: list[str]) -> DataFrame:
        """One row a key of several runs, by merge joins of sorted runs.

        Not by a union and an aggregation: Spark 4.1 takes a union of bucketed tables for bucketed, though its columnar form is not.
        """
        rows = self.spark.table(names[0])
        for name in names[1:]:
            one, two = (t.select("key", F.struct("n", "seq", "holder").alias(c)) for t, c in ((rows, "one"), (self.spark.table(name).hint("merge"), "two")))
            early = F.when(F.col("two").isNull() | (F.col("one.seq") <= F.col("two.seq")), F.col("one")).otherwise(F.col("two"))
            n = F.coalesce("one.n", F.lit(0)) + F.coalesce("two.n", F.lit(0))
            rows = one.join(two, "key", "full_outer").select("key", n.alias("n"), early.getField("seq").alias("seq"), early.getField("holder").alias("holder"))
        return rows

    def settled(self) -> DataFrame:
        """(key, holder) of all keys found in ``least`` documents or more; there must be a run."""
        return self._merged(self.runs()).filter(F.col("n") >= self.least).select("key", "holder")

    def close(self) -> None:
        """Drop all runs."""
        self._forget(self.runs())
        self.levels = []


def batch_of(ids: DataFrame, id_col: str, n: int) -> Column:
    """The number of a row's batch: 0 has the largest ids. Bounds are approximate quantiles of all ids."""
    cuts = ids.agg(F.percentile_approx(id_col, [i / n for i in range(1, n)], 10_000)).collect()[0][0] if n > 1 else None
    out = F.lit(0)
    for cut in sorted(set(cuts or [])):
        out = out + F.when(F.col(id_col) <= cut, 1).otherwise(0)
    return out


def _drop_task(shortest: int):
    """n_lines, n_dropped and what is left of each text."""

    def task(batches):
        for batch in batches:
            text, lost = batch.column("text").cast(pa.large_string()), batch.column("lost")
            n_lines = pc.add(pc.cast(pc.count_substring(text, "\n"), pa.int64()), 1)
            dropped, changed = [0] * len(text), {}
            for i in pc.indices_nonzero(pc.is_valid(lost)).to_pylist():
                lines = text[i].as_py().split("\n")
                keys = line_keys(pa.array(lines, pa.large_string()))
                gone = set(lost[i].as_py())
                keep = [len(k) < shortest or xxhash.xxh3_128_digest(k.encode()) not in gone for k in keys.to_pylist()]
                changed[i] = "\n".join(line for line, k in zip(lines, keep) if k)
                dropped[i] = len(keep) - sum(keep)
            if changed:
                mask = pc.is_valid(lost)
                text = pc.replace_with_mask(text, mask, pa.array([changed[i] for i in sorted(changed)], pa.large_string()))
            yield pa.RecordBatch.from_arrays([batch.column("row"), n_lines, pa.array(dropped, pa.int64()), text.cast(pa.string())], ["row", "n_lines", "n_dropped", "text"])

    return trimmed(task)


def dedup(
    docs: DataFrame, text: str = "text", id_col: str = "doc_id", keep: list[str] | None = None, shortest: int = SHORTEST, least: int = LEAST, batches: int = BATCHES, fan: int = FAN
) -> DataFrame:
    """``row`` (the columns in ``keep``; all if None), n_lines, n_dropped and ``text`` without the lines that it loses."""
    spark = docs.sparkSession
    keep = docs.columns if keep is None else keep
    bounded_batches(spark)
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_NO_ID)).alias("id"), text_of(docs, text).alias("text")
    ).withColumn("print", F.xxhash64("text"))  # rows of equal id and text lose the same lines
    held = rows.select("id", "print", "text").mapInArrow(_keys_task(shortest), "id long, print long, key binary")
    folder = f"{shared_root(spark)}/quillstone/lines-{uuid.uuid4().hex}"
    held.withColumn("batch", batch_of(rows.select("id"), "id", batches)).write.partitionBy("batch").parquet(f"{folder}/held")
    held = spark.read.schema("id long, print long, key binary, batch int").parquet(f"{folder}/held")
    runs = LineRuns(spark, f"{folder}/runs", least, fan)
    for b in range(batches):
        runs.add(held.filter(F.col("batch") == b).select("key", "id"))
    settled = materialize(runs.settled(), "settled-keys")  # a table, so that both sides of the join are plain shuffles, whose hot keys Spark splits
    lost = held.join(settled, "key").filter("id != holder").groupBy("id", "print").agg(F.collect_set("key").alias("lost"))
    lost = materialize(lost, "line-losses")
    runs.close()
    drop(spark, folder)
    found = rows.join(lost, ["id", "print"], "left").select("row", "text", "lost")
    schema = rows.select("row").schema.add("n_lines", "long").add("n_dropped", "long").add("text", "string")
    return found.mapInArrow(_drop_task(shortest), schema)


def oracle_sql(shortest: int = SHORTEST, least: int = LEAST) -> str:
    """The same result as DuckDB SQL, each row a document."""
    return rf"""
WITH rows AS (
  SELECT row_number() OVER () AS nth, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), lines AS (
  SELECT nth, doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS i FROM rows
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), frequent AS (
  SELECT k, max(coalesce(doc_id, -9223372036854775808)) AS holder FROM keyed WHERE length(k) >= {shortest} GROUP BY k HAVING count(DISTINCT nth) >= {least}
), judged AS (
  SELECT nth, doc_id, i, line, f.k IS NOT NULL AND coalesce(doc_id, -9223372036854775808) <> f.holder AS gone FROM keyed LEFT JOIN frequent f USING (k)
)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY nth
"""
