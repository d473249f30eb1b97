"""Citations: where cited passages stand, what nothing cites yet, what citations lack."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NO_SOURCE = "__sin_fuente__"  # fixed value


def _blank(name: str):
    return F.coalesce(F.btrim(F.col(name)), F.lit("")) == ""


def locations(excerpts: DataFrame, run: str = "run_id", order: str = "nth") -> DataFrame:
    """(run, chunk_id, located): the section of each passage that has one; of several, the last in order."""
    rows = excerpts.filter(~_blank("chunk_id") & ~_blank("section"))
    return rows.groupBy(run, F.btrim("chunk_id").alias("chunk_id")).agg(F.max_by(F.btrim("section"), order).alias("located"))


def _cited(sources: DataFrame, excerpts: DataFrame, run: str, order: str) -> DataFrame:
    """Sources with the section that they stand in: the passage's, else the one they name."""
    rows = sources.withColumn("chunk_id", F.btrim(F.coalesce("chunk_id", F.lit("")))).join(locations(excerpts, run, order), [run, "chunk_id"], "left")
    return rows.withColumn("cited", F.coalesce("located", F.nullif(F.btrim("section"), F.lit(""))))


def section_keys(items: DataFrame, sources: DataFrame, excerpts: DataFrame, run: str = "run_id", item: str = "item_idx", order: str = "nth") -> DataFrame:
    """(run, item, sections): the distinct sections that an item cites, sorted; a mark of its own for none."""
    per = _cited(sources, excerpts, run, order).groupBy(run, item).agg(F.array_sort(F.collect_set("cited")).alias("sections"))
    out = items.select(run, item).join(per, [run, item], "left")
    return out.withColumn("sections", F.when(F.coalesce(F.size("sections"), F.lit(0)) > 0, F.col("sections")).otherwise(F.array(F.lit(NO_SOURCE))))


def pending_sections(sources: DataFrame, excerpts: DataFrame, run: str = "run_id", order: str = "nth") -> DataFrame:
    """(run, section, nth): sections of the plan that no item cites, in order of first appearance."""
    rows = excerpts.filter(~_blank("chunk_id") & ~_blank("section"))
    all_ = rows.groupBy(run, F.btrim("section").alias("section")).agg(F.min(order).alias("first"))
    cited = _cited(sources, excerpts, run, order).filter("cited is not null").select(run, F.col("cited").alias("section")).distinct()
    nth = F.row_number().over(Window.partitionBy(run).orderBy("first", "section"))
    return all_.join(cited, [run, "section"], "left_anti").select(run, "section", nth.alias("nth"))


def enriched(sources: DataFrame, excerpts: DataFrame, run: str = "run_id", order: str = "nth") -> DataFrame:
    """Sources with the page, section and breadcrumb of their passage where they lack them; of several passages, the first."""
    first = excerpts.filter(~_blank("chunk_id")).groupBy(run, F.btrim("chunk_id").alias("of")).agg(F.min_by(F.struct("page", "section", "breadcrumb"), order).alias("e"))
    rows = sources.withColumn("of", F.btrim(F.coalesce("chunk_id", F.lit("")))).join(first, [run, "of"], "left")
    page = F.coalesce(F.nullif("page", F.lit(0)), F.when(F.col("e.page") > 0, F.col("e.page")))
    text = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.nullif(F.col(f"e.{c}"), F.lit("")), F.col(c))
    return rows.withColumns({"page": page, "section": text("section"), "breadcrumb": text("breadcrumb")}).drop("of", "e")


def supplemented(passages: DataFrame, chunks: DataFrame, most: int, run: str = "run_id", key: str = "chunk_id", order: str = "nth") -> DataFrame:
    """Passages, then a run's other chunks in order, up to ``most`` rows a run; all columns of ``passages``."""
    rest = chunks.join(passages.select(run, key).distinct(), [run, key], "left_anti")
    both = passages.withColumn("_late", F.lit(0)).unionByName(rest.select(*passages.columns).withColumn("_late", F.lit(1)))
    place = F.row_number().over(Window.partitionBy(run).orderBy("_late", order))
    return both.withColumn("_place", place).filter(F.col("_place") <= most).drop("_late", "_place")


def cited_texts(sources: DataFrame, passages: DataFrame, chunks: DataFrame, run: str = "run_id", order: str = "nth") -> DataFrame:
    """(run, item_idx, chunk_id, text): what a repair is shown of each cited passage; a run's passages go before its chunks."""
    both = passages.select(run, "chunk_id", "content", F.lit(0).alias("late"), order).union(chunks.select(run, "chunk_id", "content", F.lit(1), order))
    known = both.filter("chunk_id <> ''").groupBy(run, "chunk_id").agg(F.min_by("content", F.struct("late", order)).alias("text"))
    return sources.select(run, "item_idx", "chunk_id").join(known, [run, "chunk_id"], "left").withColumn("text", F.coalesce("text", F.lit("")))
