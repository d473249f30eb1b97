"""Readers of documents and their validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------------------------------------
EXTENSIONS = [".pdf", ".md", ".markdown", ".txt"]
MAX_BYTES = 20 * 1024 * 1024
MIN_IMAGE = 50
# ----------------------------------------------------------------------------------------------------------------


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def fault(path: Column, length: Column) -> Column:
    """Why a file is refused: its type, its size, nothing in it; else null."""
    return F.when(~extension(path).isin(EXTENSIONS), "extension").when(length > MAX_BYTES, "size").when(length <= 0, "empty")


def files(spark: SparkSession, folder: str) -> DataFrame:
    """All files below a folder with ``fault``; contents are only read where a later step asks for them."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return rows.withColumn("fault", fault(F.col("path"), F.col("length")))


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, text) of the sound Markdown and text files below a folder."""
    sound = files(spark, folder).filter(F.col("fault").isNull() & extension(F.col("path")).isin(".md", ".markdown", ".txt"))
    return sound.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.decode("content", "UTF-8").alias("text"))


def inline(df: DataFrame, key: str, title: str, text: str) -> DataFrame:
    """Texts of a table as documents, cleaned."""
    from ..functions.text import clean_text

    return df.select(F.col(key).alias("document_id"), F.col(title).cast("string").alias("name"), clean_text(F.coalesce(F.col(text), F.lit(""))).alias("text"))


def pdf_texts(spark: SparkSession, folder: str, extractors: list | None = None) -> DataFrame:
    """(path, text, error) of PDF files. ``extractors`` (bytes -> pages) are tried in turn; the first that works counts.

    Without an extractor library the error says so; pages are joined with ``[PÁGINA n]`` marks.
    """
    import pandas as pd

    tools = extractors or []

    def task(frames):
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"]):
                text, error = None, "no extractor"
                for tool in tools:
                    try:
                        pages = tool(bytes(content))
                    except Exception as e:  # an extractor's failure is the next one's turn
                        error = f"{type(e).__name__}: {e}"
                        continue
                    text = "\n\n".join(f"[PÁGINA {i}]\n{p}" for i, p in enumerate(pages, 1) if p.strip())
                    error = None if text else "no text"
                    if text:
                        break
                rows.append((path, text or None, error))
            yield pd.DataFrame(rows, columns=["path", "text", "error"])

    pdfs = files(spark, folder).filter(F.col("fault").isNull() & (extension(F.col("path")) == ".pdf"))
    return pdfs.select("path", "content").mapInPandas(task, "path string, text string, error string")


def image_rows(images: DataFrame, least: int = MIN_IMAGE) -> DataFrame:
    """Embedded images (path, page, image_index, format, width, height) that are large enough."""
    return images.filter((F.col("width") >= least) & (F.col("height") >= least))


def visual_appendix(described: DataFrame, doc: str = "document_id") -> DataFrame:
    """(doc, appendix) of described images, those without educational content left out."""
    part = F.format_string("### Figure (Page %d, Image %d)\n\n%s", "page", "image_index", "description")
    rows = described.filter(~F.col("description").contains("NO_EDUCATIONAL_CONTENT"))
    return rows.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "image_index", part.alias("t")))), lambda x: x["t"]), "\n\n").alias("appendix"))
