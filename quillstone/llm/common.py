"""What the training-data operators share: tables in the shared folder, packing of rows, Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``. Only where that is unset (tests on one machine) a temporary
    folder takes its place.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = getattr(shared_root, "_local", None)
        if root is None:
            root = shared_root._local = tempfile.mkdtemp(prefix="quillstone-")
    return root.rstrip("/")


_scope: dict = {"open": False, "tables": []}


@contextmanager
def stage_tables(spark: SparkSession):
    """For the stages of a pipeline, each of whose results is written before the next stage begins: tables that a stage
    materialises inside this context are dropped when the next stage enters its own. Tables made outside stay."""
    for path in _scope["tables"]:
        drop(spark, path)
    _scope.update(open=True, tables=[])
    try:
        yield
    finally:
        _scope["open"] = False


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system holds it."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def materialize(df: DataFrame, label: str, rows: int | None = None, a_file: int = 100_000) -> DataFrame:
    """Write a frame as Parquet in the shared folder and read it again: cuts lineage, survives lost executors.

    ``rows``, if given, are the most that the frame can have: it is written by a task for each ``a_file`` of them at most, as a
    shuffle may have far more partitions than its rows need, and every file costs an executor several process starts on local disks.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // a_file)))
    path = f"{shared_root(spark)}/quillstone/{label}-{uuid.uuid4().hex}"
    if _scope["open"]:
        _scope["tables"].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def packed(df: DataFrame, **named: Column) -> DataFrame:
    """All columns as one struct ``row``, beside the given ones, so that no name can clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(k) for k, c in named.items()])


def unpacked(df: DataFrame, names: list[str], **extra: Column) -> DataFrame:
    """The columns that :func:`packed` put away, and more."""
    return df.select(*[F.col("row").getField(c).alias(c) for c in names], *[c.alias(k) for k, c in extra.items()])


def text_of(df: DataFrame, name: str = "text") -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


#: Rows of texts that Spark hands to Python at once, at most; texts of any length then stay small beside a task's memory.
BATCH_ROWS = 500


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ``BATCH_ROWS`` rows where they are larger or unbounded."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def release() -> None:
    """Give freed memory back to the system; the driver and reused Python workers would keep it."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def trimmed(task):
    """A task over batches that leaves no freed memory behind in its Python worker."""

    def run(batches):
        try:
            yield from task(batches)
        finally:
            release()

    return run
