"""De-duplication of generated items: greedy fuzzy, exact, ordered unique; output similarity; set operations."""

from __future__ import annotations

from difflib import SequenceMatcher

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RATIO = 0.88


def ratio(new: str, old: str) -> float:
    return SequenceMatcher(None, new, old).ratio()


def ratio_bound(a: int, b: int) -> float:
    """No two texts of these lengths have a higher ratio."""
    return 1.0 if a + b == 0 else 2 * min(a, b) / (a + b)


def greedy_unique(texts: list[str], limit: float = RATIO) -> list[bool]:
    """First wins: a text stays if it is unlike all that stayed before it."""
    kept: list[str] = []
    out = []
    for t in texts:
        low = t.lower()
        twin = any(ratio_bound(len(low), len(k)) >= limit and ratio(low, k) >= limit for k in kept)
        out.append(not twin)
        if not twin:
            kept.append(low)
    return out


def short_runs_dedup(items: DataFrame, run: str = "run_id", order: str = "item_idx", text: str = "text", limit: float = RATIO) -> DataFrame:
    """Items of each run that the greedy rule keeps, for runs of one request (a hundred items at most): each is one group. Runs of
    any size: :func:`quillstone.operators.similar.greedy_dedup`."""
    names = items.columns

    def one(frame):
        frame = frame.sort_values(order, kind="stable")
        return frame[greedy_unique(frame[text].fillna("").tolist(), limit)][names]

    return items.groupBy(run).applyInPandas(one, items.schema)


def exact_first(items: DataFrame, key: Column, run: str = "run_id", order: str = "item_idx") -> DataFrame:
    """The first item of each key in a run."""
    first = items.withColumn("_key", key).groupBy(run, "_key").agg(F.min(order).alias(order)).drop("_key")
    return items.join(first, [run, order], "left_semi")


def point_key(text: Column) -> Column:
    return F.substring(F.lower(F.btrim(text)), 1, 160)


def unique_in_order(rows: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """(group, value, nth from 1): distinct values by first appearance."""
    first = rows.groupBy(group, value).agg(F.min(order).alias("first"))
    nth = F.row_number().over(Window.partitionBy(group).orderBy("first", value))
    return first.select(group, value, nth.alias("nth"))


def prune(points: DataFrame, target: int, run: str = "run_id", section: str = "section", order: str = "item_idx") -> DataFrame:
    """At most ``target`` points: the first of each section, then others, in their old order."""
    first = F.row_number().over(Window.partitionBy(run, section).orderBy(order)) > 1
    ranked = points.withColumn("_later", first)
    place = F.row_number().over(Window.partitionBy(run).orderBy("_later", order))
    return ranked.withColumn("_place", place).filter(F.col("_place") <= target).drop("_later", "_place")


def new_objects(local: DataFrame, stored: DataFrame, key: str = "object_key", digest: str = "sha256") -> DataFrame:
    """Objects whose key and hash the store doesn't hold."""
    return local.join(stored.select(key, digest).distinct(), [key, digest], "left_anti")


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new``, and those of ``old`` that it doesn't replace."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def insert_ignored(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``old``, and those of ``new`` whose keys it lacks."""
    return old.unionByName(new.join(old.select(*keys).distinct(), keys, "left_anti"))


def _ratios(a, b):
    import pandas as pd

    return pd.Series([ratio(x or "", y or "") for x, y in zip(a, b)], dtype=float)


def output_similarity(outputs: DataFrame, run: str = "run_id", order: str = "item_idx", text: str = "text", limit: float = 0.7) -> DataFrame:
    """(run_id, average, maximum, over_limit) of the ratios of all pairs of each run's outputs; a run of one has no average."""
    first = outputs.select(F.col(run).alias("run_id"), F.col(order).alias("a"), F.col(text).alias("ta"))
    second = outputs.select(F.col(run).alias("run"), F.col(order).alias("b"), F.col(text).alias("tb"))
    pairs = first.join(second, F.col("run_id").eqNullSafe(F.col("run")) & (F.col("a") < F.col("b")), "left")

    similar = F.pandas_udf(_ratios, "double")
    ratios = pairs.select("run_id", F.when(F.col("b").isNotNull(), similar("ta", "tb")).alias("r"))
    return ratios.groupBy("run_id").agg(F.avg("r").alias("average"), F.max("r").alias("maximum"), F.count_if(F.col("r") > limit).alias("over_limit"))
