"""An object store on any file system that Spark reaches: contents and a manifest as Parquet; sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_OBJECT = 25 * 1024 * 1024
_SCHEMA = "object_key string, content binary, sha256 string, size long, content_type string, deleted boolean, version long"


class ObjectStore:
    """Append-only versions of objects; the latest one of a key counts, a deleted one is not there."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _all(self) -> DataFrame:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.schema(_SCHEMA).parquet(self.root)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], _SCHEMA)

    def manifest(self, prefix: str = "") -> DataFrame:
        """(object_key, sha256, size, content_type) of what is there; contents are not read."""
        newest = self._all().groupBy("object_key").agg(F.max_by(F.struct("sha256", "size", "content_type", "deleted"), "version").alias("m"))
        return newest.filter(~F.col("m.deleted") & F.col("object_key").startswith(prefix)).select("object_key", "m.sha256", "m.size", "m.content_type")

    def plan(self, objects: DataFrame) -> DataFrame:
        """objects (object_key, content, content_type) with ``action``: upload, skip (same hash) or refuse (too large or
        a key that leaves the root)."""
        rows = objects.withColumns({"sha256": F.sha2("content", 256), "size": F.length("content").cast("long")})
        held = self.manifest().select("object_key", "sha256", F.lit(True).alias("held"))
        bad = (F.col("size") > MAX_OBJECT) | F.col("object_key").rlike(r"(^|/)\.\.(/|$)|^/") | (F.col("object_key") == "")
        return rows.join(held, ["object_key", "sha256"], "left").withColumn("action", F.when(bad, "refuse").when(F.col("held"), "skip").otherwise("upload")).drop("held")

    def _next(self) -> int:
        return (self._all().agg(F.max("version")).collect()[0][0] or 0) + 1

    def put(self, objects: DataFrame, dry_run: bool = False) -> DataFrame:
        """Write what is new; (action, n) of the plan."""
        plan = self.plan(objects)
        counts = plan.groupBy("action").agg(F.count("*").alias("n"))
        if dry_run:
            return counts
        counted = self.spark.createDataFrame(counts.collect(), counts.schema)  # three rows
        new = plan.filter("action = 'upload'").select("object_key", "content", "sha256", "size", "content_type", F.lit(False).alias("deleted"), F.lit(self._next()).alias("version"))
        new.write.mode("append").parquet(self.root)
        return counted

    def get(self, keys: DataFrame) -> DataFrame:
        """(object_key, content) of the given keys."""
        rows = self._all().join(keys.select("object_key").distinct(), "object_key", "left_semi")
        newest = rows.groupBy("object_key").agg(F.max_by(F.struct("content", "deleted"), "version").alias("m"))
        return newest.filter(~F.col("m.deleted")).select("object_key", "m.content")

    def delete(self, keys: DataFrame) -> None:
        """Mark keys as deleted; keys that aren't there are no error."""
        gone = self.manifest().join(keys.select("object_key").distinct(), "object_key", "left_semi")
        rows = gone.select("object_key", F.lit(b"").alias("content"), "sha256", "size", "content_type", F.lit(True).alias("deleted"), F.lit(self._next()).alias("version"))
        rows.write.mode("append").parquet(self.root)


def migration_plan(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(action, n): objects to copy, and those whose hash is already there. local, remote: object_key, sha256."""
    held = remote.select("object_key", "sha256", F.lit(True).alias("held")).distinct()
    rows = local.join(held, ["object_key", "sha256"], "left")
    return rows.groupBy(F.when(F.col("held"), "skip").otherwise("copy").alias("action")).agg(F.count("*").alias("n"))


def write_vectors(vectors: DataFrame, path: str, doc: str = "document_id") -> None:
    """Vectors by document; a document's index is its folder. Rows are dealt by document first, so that no task opens
    more folders than it has documents."""
    vectors.repartition(doc).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(doc).parquet(path)


def read_vectors(spark: SparkSession, path: str, doc: str = "document_id", only: str | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.filter(F.col(doc) == only) if only is not None else rows


def sse_frames(events: DataFrame) -> DataFrame:
    """Events as server-sent frames: one line of JSON and a blank line."""
    return events.select(F.concat(F.lit("data: "), F.to_json(F.struct(*events.columns)), F.lit("\n\n")).alias("frame"))


def parse_sse(chunks: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Rows from text of frames; lines that aren't data or hold no valid JSON are passed over."""
    lines = chunks.select(F.explode(F.split(column, "\n")).alias("line")).filter(F.col("line").startswith("data:"))
    rows = lines.select(F.from_json(F.trim(F.substring("line", 6, 1 << 30)), schema, {"mode": "PERMISSIVE"}).alias("e"))
    return rows.filter("e is not null").select("e.*")
