"""Cleaning over whole tables: repeated page lines, statistics, paragraphs, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def exploded_lines(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row a line: keys, line_no (from 0), line."""
    return df.select(*keys, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("line_no", "line"))


def remove_repeated_lines(pages: DataFrame, doc: str = "document_id", page: str = "page_number", text: str = "text", ratio: float = 0.4, protect_structure: bool = False) -> DataFrame:
    """(doc, page, text) without lines that stand on many pages of a document.

    Lines count once a page. A line goes if it stands on at least ``max(2, floor(pages * ratio))`` pages; documents of
    fewer than three pages stay as they are. The line counts are aggregated map-side by (document, line), so a line that
    is on every page of a huge document is one combined row.
    """
    lines = exploded_lines(pages, [doc, page], text).withColumn("key", T.strip(F.col("line")))
    n_pages = pages.groupBy(doc).agg(F.countDistinct(page).alias("n_pages"))
    seen = lines.filter("key <> ''").select(doc, page, "key").distinct().groupBy(doc, "key").agg(F.count("*").alias("n"))
    noisy = seen.join(n_pages, doc).filter((F.col("n_pages") >= 3) & (F.col("n") >= F.greatest(F.lit(2), F.floor(F.col("n_pages") * F.lit(ratio)))))
    if protect_structure:
        noisy = noisy.filter(~F.col("key").rlike(T.MARKDOWN_STRUCTURE))
    kept = lines.join(noisy.select(doc, "key", F.lit(True).alias("noisy")), [doc, "key"], "left").filter("noisy is null")
    body = kept.groupBy(doc, page).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return pages.select(doc, page).join(body, [doc, page], "left").select(doc, page, F.coalesce("text", F.lit("")).alias("text"))


def cleaning_stats(text: Column) -> dict[str, Column]:
    """What cleaning would change, as counters that add up."""
    unified = T.unify_line_ends(text)
    return {
        "characters_normalized": T.normalized_count(text).cast("long"),
        "page_number_lines": F.size(F.filter(F.split(unified, "\n"), T.is_page_number_line)).cast("long"),
        "hyphenated_joins": F.regexp_count(unified, F.lit(r"[A-Za-zÁÉÍÓÚÜÑáéíóúüñ]-[ \t]*\n[ \t]*[a-záéíóúüñ]")).cast("long"),
    }


def paragraphs(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, paragraph_no from 0, paragraph): stretches between blank lines, stripped, empty ones dropped."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\n\s*\n"), T.strip), lambda p: p != "")
    return df.select(key, F.posexplode(parts).alias("paragraph_no", "paragraph"))


def batches(df: DataFrame, group: str, order: list[str], size: int) -> DataFrame:
    """Consecutive batches of ``size`` rows within a group, numbered from 0."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1
    return df.withColumn("batch_no", F.floor(place / size).cast("long"))
