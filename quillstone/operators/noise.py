"""Noise filter over sections of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import noise as N
from ..functions import text as T


def classified(sections: DataFrame, key: str = "document_id", patterns: dict | None = None, categories: tuple[str, ...] = N.CATEGORIES) -> DataFrame:
    """Sections with category, their document's noise ratio, the reason to skip filtering, and ``kept``.

    A document is left alone when all its sections are noise or when noise is more than the allowed share of its
    characters. The per-document sums are map-side combined and joined back, so a document of any number of sections
    does not meet in one task.
    """
    marked = sections.withColumn("category", N.category(F.col("title"), F.col("content"), patterns, categories))
    chars = F.length(F.coalesce("content", F.lit("")))
    totals = marked.groupBy(key).agg(
        F.sum(F.when(F.col("category").isNotNull(), chars).otherwise(0)).alias("noise_chars"),
        F.sum(chars).alias("total_chars"),
        F.count("category").alias("noise_sections"),
        F.count("*").alias("all_sections"),
    )
    share = F.when(F.col("total_chars") > 0, F.col("noise_chars") / F.col("total_chars")).otherwise(0.0)
    reason = F.when((F.col("all_sections") > 0) & (F.col("noise_sections") == F.col("all_sections")), "all_noise").when(share > N.MAX_DISCARD, "ratio")
    totals = totals.select(key, "noise_chars", "total_chars", F.bround(share, 4).alias("noise_ratio"), reason.alias("skip_reason"))
    out = marked.join(totals, key)
    return out.withColumn("kept", F.col("category").isNull() | F.col("skip_reason").isNotNull())


def filter_sections(sections: DataFrame, key: str = "document_id", dry_run: bool = False, **options) -> DataFrame:
    """The kept sections with their columns; a dry run keeps all."""
    out = classified(sections, key, **options)
    return (out if dry_run else out.filter("kept")).select(*sections.columns)


def report(sections: DataFrame, key: str = "document_id", dry_run: bool = False, **options) -> DataFrame:
    """One row for each detected section: category, title, page, characters, preview, whether it is discarded."""
    out = classified(sections, key, **options).filter("category is not null")
    page = F.col("page_number") if "page_number" in sections.columns else F.lit(None).cast("int")
    return out.select(
        key, "category", T.normalize_title(F.coalesce("title", F.lit(""))).alias("title"), page.alias("page_number"),
        F.length("content").cast("long").alias("chars"), T.preview(F.col("content")).alias("preview"), (~F.col("kept") & F.lit(not dry_run)).alias("discarded"),
    )


def discarded_summary(report_rows: DataFrame, key: str = "document_id") -> DataFrame:
    """(key, discarded, categories): how many sections went, and their classes in order."""
    gone = report_rows.filter("discarded")
    return gone.groupBy(key).agg(F.count("*").alias("discarded"), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"))


def first_per(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_nth", nth).filter("_nth = 1").drop("_nth")
