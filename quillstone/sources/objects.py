"""Documents and artifacts in an object store, written in two phases through a data source of Spark.

``spark.read/write.format("quillstone_objects")`` stores objects below any folder that Arrow's file systems reach. Each task writes its contents and one manifest
under names of its own; the commit on the driver then adds one log entry that lists the manifests of the tasks that succeeded, and only what the log lists
is there. A write that fails leaves nothing visible, and its files are deleted. Entries are named by time and a random number, so writers
at once never take the same version, no entry is lost, and all readers see the same order: the later entry of a key counts.

:class:`DocumentStorage` is the facade: uploads, downloads, artifacts, metadata beside the objects, deletions. Manifests alone answer what exists;
contents are read for the keys that are asked for.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .store import MAX_OBJECT

MANIFEST = "object_key string, version string, nth bigint, path string, sha256 string, size bigint, content_type string, metadata map<string,string>, deleted boolean"
# --- fixed values -----------------------------------------------------------------------------------------------
CONTENT_TYPES = {".pdf": "application/pdf", ".txt": "text/plain", ".md": "text/markdown"}
OTHER_TYPE, ANONYMOUS, DONE = "application/octet-stream", "anonymous", "completado"
# ----------------------------------------------------------------------------------------------------------------


def _store(root: str):
    """The file system of a folder, and the folder's path on it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


@dataclass
class _Written(WriterCommitMessage):
    manifest: str | None


class _Writer(DataSourceWriter):
    def __init__(self, root: str):
        self.root, self.id = root.rstrip("/"), uuid.uuid4().hex

    def write(self, iterator: Iterator) -> _Written:
        import hashlib

        import pyarrow as pa
        import pyarrow.parquet as pq

        fs, root = _store(self.root)
        folder, rows = f"{root}/data/{self.id}", []
        fs.create_dir(folder, recursive=True)
        for nth, row in enumerate(iterator):
            gone = bool(getattr(row, "deleted", False))
            path = None if gone else f"{folder}/{uuid.uuid4().hex}"
            content = bytes(row.content or b"")
            if path:
                with fs.open_output_stream(path) as out:
                    out.write(content)
            rows.append((row.object_key, nth, path, hashlib.sha256(content).hexdigest(), len(content), row.content_type, list((row.metadata or {}).items()), gone))
        if not rows:
            return _Written(None)
        kinds = {"object_key": pa.string(), "nth": pa.int64(), "path": pa.string(), "sha256": pa.string(), "size": pa.int64(), "content_type": pa.string(), "metadata": pa.map_(pa.string(), pa.string()), "deleted": pa.bool_()}
        manifest = f"{folder}/{uuid.uuid4().hex}.manifest"
        pq.write_table(pa.table({c: pa.array(v, k) for (c, k), v in zip(kinds.items(), zip(*rows))}), manifest, filesystem=fs)
        return _Written(manifest)

    def commit(self, messages: list) -> None:
        fs, root = _store(self.root)
        listed = [m.manifest for m in messages if m is not None and m.manifest]
        fs.create_dir(f"{root}/log", recursive=True)
        entry = f"{time.time_ns():020d}-{self.id}.json"
        with fs.open_output_stream(f"{root}/log/.{entry}") as out:
            out.write(json.dumps(listed).encode())
        fs.move(f"{root}/log/.{entry}", f"{root}/log/{entry}")  # an entry is there whole or not at all

    def abort(self, messages: list) -> None:
        fs, root = _store(self.root)
        fs.delete_dir_contents(f"{root}/data/{self.id}", missing_dir_ok=True)


@dataclass
class _Manifest(InputPartition):
    version: str
    path: str


class _Reader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root.rstrip("/")

    def partitions(self) -> list:
        from pyarrow import fs as afs

        fs, root = _store(self.root)
        out = []
        for entry in sorted(fs.get_file_info(afs.FileSelector(f"{root}/log", allow_not_found=True)), key=lambda e: e.base_name):
            if entry.base_name.endswith(".json") and not entry.base_name.startswith("."):
                with fs.open_input_stream(entry.path) as f:
                    out += [_Manifest(entry.base_name[:-5], path) for path in json.loads(f.read())]
        return out or [_Manifest("", "")]

    def read(self, partition: _Manifest) -> Iterator[tuple]:
        import pyarrow.parquet as pq

        if partition.path:
            fs, _ = _store(self.root)
            for r in pq.read_table(partition.path, filesystem=fs).to_pylist():
                yield r["object_key"], partition.version, r["nth"], r["path"], r["sha256"], r["size"], r["content_type"], dict(r["metadata"] or []), r["deleted"]


class ObjectSource(DataSource):
    """Option ``path``: the store's folder. Reading gives all versions of all manifests; writing appends (object_key, content, content_type, metadata[, deleted])."""

    @classmethod
    def name(cls) -> str:
        return "quillstone_objects"

    def schema(self) -> str:
        return MANIFEST

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        if overwrite:
            raise ValueError("objects are appended, the later version of a key counts")
        return _Writer(self.options["path"])


def document_key(user: Column, document: Column, name: Column) -> Column:
    """Where a user's document is kept; documents without a user are anonymous."""
    extension = F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"[^/\\](\.[^./\\]+)$", 1))
    return F.concat(F.lit("usuarios/"), F.coalesce(F.nullif(user, F.lit("")), F.lit(ANONYMOUS)), F.lit("/documentos/"), document, extension)


class DocumentStorage:
    """Documents and JSON artifacts of many users as frames; ``root`` is a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        spark.dataSource.register(ObjectSource)
        self.spark, self.root = spark, root

    def _write(self, rows: DataFrame) -> None:
        rows.write.format("quillstone_objects").option("path", self.root).mode("append").save()

    def versions(self) -> DataFrame:
        """All versions of all objects, deletions among them."""
        return self.spark.read.format("quillstone_objects").option("path", self.root).load()

    def head(self) -> DataFrame:
        """(object_key, version, path, sha256, size, content_type, metadata) of what is there."""
        fields = ["version", "path", "sha256", "size", "content_type", "metadata", "deleted"]
        last = self.versions().groupBy("object_key").agg(F.max_by(F.struct(*fields), F.struct("version", "nth", "path")).alias("m"))
        return last.filter(~F.col("m.deleted")).select("object_key", *[f"m.{c}" for c in fields[:-1]])

    def exists(self, keys: DataFrame) -> DataFrame:
        """(object_key, there) of distinct keys."""
        return keys.select("object_key").distinct().join(self.head().select("object_key", F.lit(True).alias("there")), "object_key", "left").select("object_key", F.coalesce("there", F.lit(False)).alias("there"))

    def upload(self, objects: DataFrame) -> DataFrame:
        """objects (object_key, content, content_type, metadata) -> (object_key, status): stored, same (its content is there), or refused: too large, a key that leaves the
        root, or that comes more than once."""
        from ..tables import shared_folder, written

        rows = objects.select("object_key", "content", "content_type", "metadata", F.sha2("content", 256).alias("sha256"), F.length("content").alias("size"))
        twice = rows.groupBy("object_key").agg(F.count("*").alias("n"))
        held = self.head().select("object_key", "sha256", F.lit(True).alias("held"))
        rows = rows.join(twice, "object_key").join(held, ["object_key", "sha256"], "left")
        bad = (F.col("n") > 1) | (F.col("size") > MAX_OBJECT) | F.col("object_key").rlike(r"(^|/)\.\.(/|$)|^/") | (F.col("object_key") == "")
        rows = written(rows.withColumn("status", F.when(bad, "refused").when(F.col("held"), "same").otherwise("stored")), shared_folder(self.spark, "uploads"))
        self._write(rows.filter("status = 'stored'").select("object_key", "content", "content_type", "metadata"))
        return rows.select("object_key", "status")

    def upload_documents(self, documents: DataFrame) -> DataFrame:
        """documents (user_id, document_id, name, content) -> (object_key, status); the file's name and its type are kept beside the content."""
        extension = F.lower(F.regexp_extract("name", r"(\.[^./\\]+)$", 1))
        kind = F.coalesce(F.create_map(*[F.lit(x) for kv in CONTENT_TYPES.items() for x in kv])[extension], F.lit(OTHER_TYPE))
        key = document_key(F.col("user_id"), F.col("document_id"), F.col("name"))
        return self.upload(documents.select(key.alias("object_key"), "content", kind.alias("content_type"), F.create_map(F.lit("name"), "name").alias("metadata")))

    def upload_json(self, artifacts: DataFrame, bucket: str) -> DataFrame:
        """artifacts (object_name, data: JSON text) -> (bucket, objeto_id, status_upload)."""
        rows = artifacts.select(F.col("object_name").alias("object_key"), F.encode("data", "UTF-8").alias("content"), F.lit("application/json").alias("content_type"), F.create_map(F.lit("bucket"), F.lit(bucket)).alias("metadata"))
        return self.upload(rows).select(F.lit(bucket).alias("bucket"), F.col("object_key").alias("objeto_id"), F.when(F.col("status") == "refused", "refused").otherwise(DONE).alias("status_upload"))

    def download(self, keys: DataFrame) -> DataFrame:
        """(object_key, content, content_type, metadata) of the keys that are there."""
        root = self.root

        def task(frames):
            fs, _ = _store(root)
            for frame in frames:
                contents = []
                for path in frame["path"]:
                    with fs.open_input_stream(path) as f:
                        contents.append(f.read())
                yield frame.assign(content=contents)[["object_key", "content"]]

        found = self.head().join(keys.select("object_key").distinct(), "object_key", "left_semi")
        contents = found.select("object_key", "path").mapInPandas(task, "object_key string, content binary")
        return contents.join(found.select("object_key", "content_type", "metadata"), "object_key").select("object_key", "content", "content_type", "metadata")

    def delete(self, keys: DataFrame) -> None:
        """Delete objects; one that is already gone counts as deleted. Raises if the deletion could not be written."""
        gone = self.head().join(keys.select("object_key").distinct(), "object_key", "left_semi")
        self._write(gone.select("object_key", F.lit(b"").alias("content"), "content_type", "metadata", F.lit(True).alias("deleted")))
