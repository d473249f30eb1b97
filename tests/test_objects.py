"""The object store: read-back, versions, writers at once, failed writes, refusals."""

import threading

import pytest
from pyspark.sql import functions as F

from quillstone.sources.objects import DocumentStorage


def objects(spark, rows):
    return spark.createDataFrame([(k, c.encode(), "text/plain", m) for k, c, m in rows], "object_key string, content binary, content_type string, metadata map<string,string>").repartition(3)


def keys(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "object_key string")


def statuses(df):
    return sorted((r.object_key, r.status) for r in df.collect())


def test_documents_come_back_with_their_metadata(spark, tmp_path):
    store = DocumentStorage(spark, str(tmp_path / "store"))
    assert store.head().count() == 0 and store.download(keys(spark, "x")).count() == 0
    docs = spark.createDataFrame([("u1", "d1", "Guía.PDF", b"%PDF"), (None, "d2", "notes.md", b"# T"), ("", "d3", "noext", b"\x00\x01"), ("u1", "d4", "a.b/c", b"")], "user_id string, document_id string, name string, content binary")
    got = statuses(store.upload_documents(docs))
    assert got == [("usuarios/anonymous/documentos/d2.md", "stored"), ("usuarios/anonymous/documentos/d3", "stored"), ("usuarios/u1/documentos/d1.pdf", "stored"), ("usuarios/u1/documentos/d4", "stored")]
    back = {r.object_key: r for r in store.download(keys(spark, "usuarios/u1/documentos/d1.pdf", "usuarios/anonymous/documentos/d3", "absent", "absent")).collect()}
    assert {k: bytes(r.content) for k, r in back.items()} == {"usuarios/u1/documentos/d1.pdf": b"%PDF", "usuarios/anonymous/documentos/d3": b"\x00\x01"}
    assert back["usuarios/u1/documentos/d1.pdf"].content_type == "application/pdf" and back["usuarios/u1/documentos/d1.pdf"].metadata == {"name": "Guía.PDF"}
    out = store.upload_json(spark.createDataFrame([("a/b.json", '{"x": "ñ"}')], "object_name string, data string"), "artifacts").collect()
    assert [tuple(r) for r in out] == [("artifacts", "a/b.json", "completado")]
    assert bytes(store.download(keys(spark, "a/b.json")).first().content).decode() == '{"x": "ñ"}'


def test_versions_deletions_and_refusals(spark, tmp_path):
    store = DocumentStorage(spark, str(tmp_path))
    assert statuses(store.upload(objects(spark, [("a", "1", {"v": "1"}), ("b", "1", None), ("../up", "x", None), ("/abs", "x", None), ("twice", "1", None), ("twice", "2", None), ("", "x", None)]))) == [
        ("", "refused"), ("../up", "refused"), ("/abs", "refused"), ("a", "stored"), ("b", "stored"), ("twice", "refused"), ("twice", "refused"),
    ]
    assert statuses(store.upload(objects(spark, [("a", "2", {"v": "2"}), ("b", "1", None)]))) == [("a", "stored"), ("b", "same")]
    assert bytes(store.download(keys(spark, "a")).first().content) == b"2" and store.head().filter("object_key = 'a'").first().metadata == {"v": "2"}
    store.delete(keys(spark, "a", "never there"))
    store.delete(keys(spark, "a"))
    assert {r.object_key: r.there for r in store.exists(keys(spark, "a", "b", "c")).collect()} == {"a": False, "b": True, "c": False}
    assert statuses(store.upload(objects(spark, [("a", "2", None)]))) == [("a", "stored")]  # deleted, so it is new again
    assert store.versions().filter("object_key = 'a'").count() == 4


def test_writers_at_once_lose_nothing(spark, tmp_path):
    faults = []

    def write(n):
        try:
            DocumentStorage(spark, str(tmp_path))._write(objects(spark, [(f"own-{n}", str(n), None), ("shared", str(n), None)]))
        except Exception as e:  # told to the test below
            faults.append(e)

    threads = [threading.Thread(target=write, args=(n,)) for n in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    store = DocumentStorage(spark, str(tmp_path))
    assert not faults and {r.object_key for r in store.head().collect()} == {"shared", *(f"own-{n}" for n in range(6))}
    versions = [r.version for r in store.versions().filter("object_key = 'shared'").collect()]
    last = max(store.versions().filter("object_key = 'shared'").collect(), key=lambda r: r.version)
    assert len(set(versions)) == 6 and store.head().filter("object_key = 'shared'").first().path == last.path


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    store = DocumentStorage(spark, str(tmp_path))
    store.upload(objects(spark, [("kept", "1", None)]))
    broken = objects(spark, [(f"k{i}", "x", None) for i in range(20)]).withColumn("object_key", F.when(F.col("object_key") == "k7", F.raise_error(F.lit("lost"))).otherwise(F.col("object_key")))
    with pytest.raises(Exception, match="lost"):
        store._write(broken)
    assert [r.object_key for r in store.head().collect()] == ["kept"]
    assert sum(1 for f in tmp_path.glob("data/*/*") if f.is_file()) == 2  # one object and its manifest
