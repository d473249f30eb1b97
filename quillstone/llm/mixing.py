"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Every source has a target number of words. A document of a source is expected ``target / source_size`` times; the
expected copies are prefix-summed within the source, one offset per source is added, and a document is emitted once for
each integer boundary that its stretch crosses. All documents of a source expect the same, so the prefix sum is the
document's rank times that ratio; documents stand in order of size classes, so that words, not only documents, come near
the target.

The rank is built in two levels: a source is dealt into blocks by size class, and a class of many rows by a hash of id and text into
parts of about ``PART_ROWS`` rows; a block's rows are ranked inside it, and the numbers of rows of the blocks before it are added. No
task holds a source or a class.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; a source without words
has target 0 and takes nothing; null ids rank first; equal rows are interchangeable, so that reruns agree; an
empty table gives an empty result; other columns pass through inside ``row``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_of, unpacked

WORD = r"[^\x20\x09-\x0D]+"
PART_ROWS = 10_000
WEIGHTS = (1, 2, 3)
MOST = 3


def size_class(size: Column) -> Column:
    """A number that grows with the size, from its eight highest bits: 128 classes for each doubling."""
    bits = F.length(F.bin(size))
    low = F.greatest(bits - 8, F.lit(0))
    return (bits * 256 + F.floor(size / F.pow(F.lit(2.0), low))).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, n_docs, nth, weight, target) from rows (source, size).

    Targets share all words by weight; none exceeds ``most`` times its source's size, and what it leaves is shared
    among the others by weight. Ordered by ``most * size / weight``, the capped sources are a prefix: a source is
    capped if the share of those from it on exceeds its own cap.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("nth", F.row_number().over(order))
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") - 1) % len(weights) + 1).cast("long"))
    caps = Window.orderBy(F.col("source_size") / F.col("weight"), "nth")
    before = caps.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumns(
        {
            "all_size": F.sum("source_size").over(whole),
            "capped_before": F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most,
            "weight_from": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        }
    )
    per = per.withColumn("share", (F.col("all_size") - F.col("capped_before")).cast("double") / F.col("weight_from"))
    per = per.withColumn("fits", F.col("share") * F.col("weight") <= F.col("source_size") * most)
    # once a source fits, so do all after it, at the same share but for rounding: the first one's counts
    per = per.withColumn("first_fit", F.min(F.when(F.col("fits"), F.struct(F.col("source_size") / F.col("weight"), "nth", "share"))).over(whole))
    target = F.least(F.col("first_fit.share") * F.col("weight"), (F.col("source_size") * most).cast("double"))
    return per.select("source", "source_size", "n_docs", "nth", "weight", F.coalesce(target, (F.col("source_size") * most).cast("double")).alias("target"))


def offset(source: Column, seed: str) -> Column:
    """The source's offset in [0, 1), from a hash of its name."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source.cast("string"), F.lit("\x00null"))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix(
    docs: DataFrame, text: str = "text", source: str = "source", id_col: str = "doc_id", keep: list[str] | None = None, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS
) -> DataFrame:
    """``row`` (the columns in ``keep``; all if None), size, source_size, target and ``copies`` of every document."""
    keep = docs.columns if keep is None else keep
    t = text_of(docs, text)
    sized = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"),
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.col(f"`{source}`").cast("string").alias("source"),
        F.regexp_count(t, F.lit(WORD)).cast("long").alias("size"),
        F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col(f"`{id_col}`").cast("long").cast("string"), F.lit("")), F.lit(":"), t)), 1, 15), 16, 10).cast("long").alias("digest"),
    )
    # the source as keys that are never null: join and window below then deal the rows out once, alike
    sized = sized.withColumns({"class": size_class(F.col("size")), "key": F.coalesce("source", F.lit("")), "none": F.col("source").isNull()})
    sized = materialize(sized, "mix-sizes")
    sources = source_targets(sized.select("source", "size"), weights)
    # counted again where it is joined: a written table would cost more files than these rows are worth
    parts = sized.groupBy("key", "none", "class").agg(F.ceil(F.count("*") / F.lit(PART_ROWS)).alias("parts"))
    few = parts.count() <= 1_000_000  # a source has some hundreds of size classes
    sized = sized.join(F.broadcast(parts) if few else parts, ["key", "none", "class"]).withColumn("part", F.pmod("digest", "parts"))
    place = ["key", "none", "class", "part"]
    blocks = sized.groupBy("source", *place).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("source").orderBy("class", "part").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("source", *place, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    blocks = blocks.join(sources, blocks["source"].eqNullSafe(sources["source"])).select(
        *place, "before", "source_size", "target"
    )
    inside = Window.partitionBy(*place).orderBy("size", F.col("id").asc_nulls_first(), "digest")
    ranked = sized.join(blocks, place).withColumn("nth", F.row_number().over(inside))
    ranked = ranked.select("row", "source", "size", "source_size", "target", (F.col("before") + F.col("nth")).alias("rank"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    ranked = ranked.withColumns({"ratio": ratio, "offset": offset(F.col("source"), seed)})
    copies = F.floor(F.col("rank") * F.col("ratio") + F.col("offset")) - F.floor((F.col("rank") - 1) * F.col("ratio") + F.col("offset"))
    return ranked.select("row", "source", "size", "source_size", "target", copies.cast("long").alias("copies"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the columns of ``docs``, each document as often as it was emitted."""
    mixed = mix(docs, **options).filter("copies > 0")
    return unpacked(mixed.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("copies")))), docs.columns)


def oracle_sql(seed: str = "mix") -> str:
    """The same mix as DuckDB SQL."""
    return rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS digest FROM documents
), sorted AS (
  SELECT *, (length(bin(size)) * 256 + floor(size / pow(2.0, greatest(length(bin(size)) - 8, 0))))::BIGINT AS class FROM sized
), classed AS (
  SELECT *, digest % ceil(count(*) OVER (PARTITION BY source, class) / {PART_ROWS})::BIGINT AS part FROM sorted
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM classed GROUP BY source
), numbered AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS nth FROM per
), weighed AS (
  SELECT *, ((nth - 1) % 3 + 1)::BIGINT AS weight FROM numbered
), shared AS (
  SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER o, 0))::DOUBLE
            / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS share
  FROM weighed WINDOW o AS (ORDER BY source_size / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), fit AS (
  SELECT arg_min(share, (source_size / weight, nth)) AS share FROM shared WHERE share * weight <= 3 * source_size
), targets AS (
  SELECT w.source, w.source_size, coalesce(least(f.share * w.weight, (3 * w.source_size)::DOUBLE), (3 * w.source_size)::DOUBLE) AS target
  FROM weighed w CROSS JOIN fit f
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY class, part, size, doc_id NULLS FIRST, digest) AS rank FROM classed
), offsets AS (
  SELECT source AS s, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS ratio,
         (('0x' || substr(md5('{seed}:' || coalesce(source, chr(0) || 'null')), 1, 8))::BIGINT)::DOUBLE / 4294967296.0::DOUBLE AS o
  FROM targets
)
SELECT doc_id, size, source_size, target, ((floor(rank * ratio + o) - floor((rank - 1) * ratio + o))::BIGINT * size)::BIGINT AS taken
FROM ranked JOIN offsets ON source IS NOT DISTINCT FROM s
"""
