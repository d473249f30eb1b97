"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Test items are short and documents may be long, so the similarity of an item and a whole document says nothing. Items
are partitioned by their number of shingles, classes of a factor two; against a class of at most ``u`` shingles a
document is seen as overlapping windows of ``2 u`` shingles in steps of ``u``, so that a passage of up to ``u`` shingles
lies wholly in one window. In a class the containment threshold ``t`` becomes a similarity of at least
``t n / (2 u + (1 - t) n)``, and ``K`` MinHash coordinates are looked up one by one (bands of one row, as these
similarities are low): a window that agrees with an item in any coordinate is a candidate. With K = 64 an
item that is wholly in a document is missed with a probability under 1e-8, one at the threshold under 1e-5.
Every candidate is verified: the share of the item's distinct shingles that occur in the whole document.

A document's windows of all classes come from one table of block minima; windows of larger classes are minima of
smaller ones. Items are taken in blocks of bounded size, each broadcast for one pass over the documents.

Defined cases: null and empty texts match nothing; items of one to four words are one run of all their words, and match where it stands whole;
equal items and equal documents are each reported; a null id is reported as null; empty tables give an empty result;
other columns do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta
from .common import bounded_batches, text_of, trimmed

WIDTH, THRESHOLD, K = 5, 0.8, 64
SMALLEST = 4
#: Words of items in one broadcast block: about 8 bytes each for shingles and 256 for an item's minima.
BLOCK_WORDS = 2_000_000
_MULTIPLIERS = (ta.mix64(np.arange(1, K + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def _runs_of(words: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of fewer words than a shingle has, and their bounds."""
    h, at = ta.shingle_hashes(words, bounds, width)
    return ta.mix64(h ^ np.uint64(width)), at


class ItemIndex:
    """The items of one block: shingle sets, and per size class and coordinate the sorted minima.

    Items of fewer words than a shingle has are kept apart, by their number of words, as one run each.
    """

    def __init__(self, ids: list, texts: pa.Array):
        words, bounds = ta.word_hashes(*ta.flat_bytes(texts, lower=True))
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for width in range(1, WIDTH):
            items = np.flatnonzero(np.diff(bounds) == width)
            if len(items):
                h, at = _runs_of(words, bounds, width)
                order = np.argsort(h[at[items]], kind="stable")
                self.short[width] = h[at[items]][order], items[order]
        sets, at = ta.distinct(*ta.shingle_hashes(words, bounds, WIDTH))
        self.ids, self.sets, self.at = ids, sets, at
        n = np.diff(at)
        size = np.maximum(SMALLEST, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(int))
        self.classes: dict[int, list] = {}
        high = (sets >> np.uint64(32)).astype(np.uint32)
        for u in np.unique(size[n > 0]):
            items = np.flatnonzero((size == u) & (n > 0))
            tables = []
            for a in _MULTIPLIERS:
                low = np.array([(high[at[i] : at[i + 1]] * a).min() for i in items], np.uint32)
                order = np.argsort(low, kind="stable")
                seen = np.zeros(1 << 16, bool)
                seen[low >> 16] = True
                tables.append((low[order], items[order], seen))
            self.classes[int(u)] = tables
        # for verification: each shingle with the items that hold it
        owner = ta.owners(at)
        order = np.argsort(sets, kind="stable")
        self.shingle, self.holder = sets[order], owner[order]


def _expand(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges [first, last): the number of the range and the position, for every position."""
    n = last - first
    who = np.repeat(np.arange(len(n)), n)
    return who, np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def _candidates(index: ItemIndex, sh: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Distinct (document, item) pairs, as document * items + item, that agree in a coordinate."""
    n = np.diff(bounds)
    unit = min(index.classes)
    blocks = -(-n // unit)
    starts = np.concatenate([[0], np.cumsum(blocks)])
    doc = np.repeat(np.arange(len(n)), blocks)
    nth = np.arange(starts[-1]) - starts[:-1][doc]
    # a last short block repeats the document's last shingle, which changes no minimum
    at = np.minimum((bounds[:-1][doc] + nth * unit)[:, None] + np.arange(unit), bounds[1:][doc][:, None] - 1)
    x = (sh[at] >> np.uint64(32)).astype(np.uint32)
    end = starts[1:][doc] - 1
    here = np.arange(len(doc))
    found = []
    for k, a in enumerate(_MULTIPLIERS):
        low = (x * a).min(axis=1)
        span = 1
        for u in sorted(index.classes):
            while span < 2 * u // unit:  # low[j]: minimum over the blocks j .. j + span - 1 of the document
                low = np.minimum(low, low[np.minimum(here + span, end)])
                span *= 2
            minima, items, seen = index.classes[u][k]
            some = np.flatnonzero(seen[low >> 16] & (nth % (u // unit) == 0))
            if len(some):
                value = low[some]
                w, p = _expand(np.searchsorted(minima, value), np.searchsorted(minima, value, side="right"))
                found.append(doc[some[w]] * len(index.ids) + items[p])
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def _short_pairs(index: ItemIndex, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Distinct (document, item) pairs, as document * items + item, of short items that stand in a document whole."""
    found = [np.zeros(0, np.int64)]
    for width, (keys, items) in index.short.items():
        h, at = _runs_of(words, bounds, width)
        first, last = np.searchsorted(keys, h), np.searchsorted(keys, h, side="right")
        some = np.flatnonzero(first < last)
        w, p = _expand(first[some], last[some])
        found.append(np.unique(ta.owners(at)[some[w]] * len(index.ids) + items[p]))
    return np.concatenate(found)


def contained(index: ItemIndex, texts: pa.Array, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, item, shared distinct shingles) of the verified pairs of one batch."""
    words, bounds = ta.word_hashes(*ta.flat_bytes(texts, lower=True))
    short = _short_pairs(index, words, bounds)
    doc, item, n = _long_pairs(index, *ta.shingle_hashes(words, bounds, WIDTH), threshold)
    return np.append(short // max(1, len(index.ids)), doc), np.append(short % max(1, len(index.ids)), item), np.append(np.ones(len(short), np.int64), n)


def _long_pairs(index: ItemIndex, sh: np.ndarray, bounds: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    none = np.zeros(0, np.int64)
    if not index.classes or not len(sh):
        return none, none, none
    pairs = _candidates(index, sh, bounds)
    if not len(pairs):
        return none, none, none
    docs = np.unique(pairs // len(index.ids))
    who, at = _expand(bounds[docs], bounds[docs + 1])
    mine, own = ta.distinct(sh[at], np.searchsorted(who, np.arange(len(docs) + 1)))
    w, p = _expand(np.searchsorted(index.shingle, mine), np.searchsorted(index.shingle, mine, side="right"))
    hit, n = np.unique(docs[ta.owners(own)[w]] * len(index.ids) + index.holder[p], return_counts=True)
    good = np.isin(hit, pairs, assume_unique=True)
    hit, n = hit[good], n[good]
    item = hit % len(index.ids)
    ok = n >= threshold * np.diff(index.at)[item] - 1e-9
    return (hit // len(index.ids))[ok], item[ok], n[ok]


def _index(items: DataFrame) -> ItemIndex:
    table = items.toArrow()
    texts = table.column("text").combine_chunks()
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    return ItemIndex(table.column("item_id").to_pylist(), texts)


def _search_task(index, threshold):
    def task(batches):
        idx = index.value
        sizes = np.maximum(np.diff(idx.at), 1)  # a short item is one run
        for batch in batches:
            text = batch.column("text")
            for a, b in ta.slices(text, 1_000_000):
                doc, item, n = contained(idx, text.slice(a, b - a), threshold)
                if len(doc):
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("row").slice(a, b - a).take(pa.array(doc)),
                            pa.array([idx.ids[i] for i in item], pa.int64()),
                            pa.array(n.astype(np.int64)),
                            pa.array(sizes[item].astype(np.int64)),
                        ],
                        ["row", "item_id", "n_shared", "n_item"],
                    )

    return task


def _clean_task(index, threshold):
    def task(batches):
        for batch in batches:
            text = batch.column("text")
            for a, b in ta.slices(text, 1_000_000):
                clean = np.ones(b - a, bool)
                clean[contained(index.value, text.slice(a, b - a), threshold)[0]] = False
                yield batch.slice(a, b - a).filter(pa.array(clean))

    return task


def _blocks(items: DataFrame, id_col: str, text: str):
    """The items in blocks of about BLOCK_WORDS words each."""
    rows = items.select(F.col(f"`{id_col}`").cast("long").alias("item_id"), text_of(items, text).alias("text"))
    words = rows.agg(F.sum(F.length("text"))).collect()[0][0] or 0
    n = -(-words // (4 * BLOCK_WORDS)) or 1
    for i in range(n):
        yield rows if n == 1 else rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)


def _rows(docs: DataFrame, text: str, keep: list[str] | None) -> DataFrame:
    keep = docs.columns if keep is None else keep
    bounded_batches(docs.sparkSession)
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), text_of(docs, text).alias("text"))


def matches(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, text: str = "text", item_id: str = "item_id", item_text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row`` of each contaminated document (columns in ``keep``), item_id, n_shared, n_item: one row a pair."""
    rows = _rows(docs, text, keep)
    schema = rows.select("row").schema.add("item_id", "long").add("n_shared", "long").add("n_item", "long")
    out = None
    for block in _blocks(items, item_id, item_text):
        part = rows.mapInArrow(trimmed(_search_task(docs.sparkSession.sparkContext.broadcast(_index(block)), threshold)), schema)
        out = part if out is None else out.union(part)
    return out


def clean_documents(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that contain no item, with their columns."""
    rows = _rows(docs, text, None)
    for block in _blocks(items, item_id, item_text):
        rows = rows.mapInArrow(trimmed(_clean_task(docs.sparkSession.sparkContext.broadcast(_index(block)), threshold)), rows.schema)
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def oracle_sql(threshold: float = THRESHOLD) -> str:
    """The same matches as DuckDB SQL, by a join of all shingles."""
    words = r"regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{80}-\x{10ffff}]+')"
    whole = "' ' || array_to_string(w, ' ') || ' '"
    grams = f"unnest(list_transform(range(0, greatest(len(w) - {WIDTH - 1}, 0)), lambda i: array_to_string(w[i + 1 : i + {WIDTH}], ' ')))"
    return f"""
WITH d AS (SELECT DISTINCT doc_id, {grams} AS g FROM (SELECT doc_id, {words} AS w FROM documents)),
b AS (SELECT DISTINCT item_id, {grams} AS g FROM (SELECT item_id, {words} AS w FROM benchmark)),
n AS (SELECT item_id, count(*)::BIGINT AS n_item FROM b GROUP BY item_id)
SELECT doc_id, item_id, count(*)::BIGINT AS n_shared, n_item FROM d JOIN b USING (g) JOIN n USING (item_id)
GROUP BY ALL HAVING count(*) >= {threshold} * n_item - 1e-9
UNION ALL
SELECT doc_id, item_id, 1::BIGINT, 1::BIGINT
FROM (SELECT doc_id, {whole} AS t FROM (SELECT doc_id, {words} AS w FROM documents))
JOIN (SELECT item_id, {whole} AS s FROM (SELECT item_id, {words} AS w FROM benchmark) WHERE len(w) BETWEEN 1 AND {WIDTH - 1}) ON contains(t, s)
"""
