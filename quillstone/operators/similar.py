"""Greedy de-duplication by similarity of runs of any size: an item stays if it is unlike every item that stayed before it.

Likeness is ``difflib``'s ratio of the lower-cased texts, not symmetric and not a set measure. The sequential rule is rebuilt as joins.

Short runs (``FEW`` items and ``SIGNS`` signs at most) have so few pairs that filters cost more than they save: a run's texts meet once, pairs of fitting
lengths are streamed through the ratio, and the like pairs of a run, in order, tell what goes. Of longer runs:

1. Copies. Of equal texts only the first can stay (but for texts that are unlike themselves, which ``difflib`` knows: longer than 199 signs, each of
   them frequent; their copies all go on).
2. Candidates by a q-gram count filter. If two texts of ``a`` and ``b`` signs have a ratio of at least ``r``, then M = r (a + b) / 2 signs match, in at
   most 1 + (a + b - 2 M) blocks, as blocks are parted by unmatched signs, and each block of n signs has n - q + 1 q-grams. So they share at
   least c (a + b) - (q - 1) q-grams, with c = r (2 q - 1) / 2 - (q - 1); repeated grams count as often as both have them. A text's rarest grams, all but
   so many that it must share a few (its prefix), are its keys, and lengths must be within a factor. Short texts, for which this promises
   nothing, have their signs as keys (q = 1).
3. Leaders. In each round, every undecided item meets only the first undecided item of each of its keys: one pair a key, however many copies
   a group has. Items that are first for all their keys stay; what is like an item that stays goes. Rounds end when few go.
4. The others meet each other by their keys, and the ratio is computed for pairs that share enough of them.
5. What is left is the lexicographically first independent set: in each round, items without an undecided earlier neighbour stay,
   and their neighbours go.

Each round writes its tables. No group is collected, and a large group of near copies costs a pair a key and copy.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import dropped, shared_folder, written
from .dedup import RATIO, ratio

#: Keys that two prefixes must share at most, and the part of the undecided that a round of leaders must decide to be worth another.
SHARED, WORTH = 6, 8
#: From this length on a text may be unlike itself.
POPULAR = 200
#: Bounds of a short run, in items and signs, and the keys that a batch may have.
FEW, SIGNS, BATCH = 512, 500_000, 500_000


class Filter:
    """What a ratio of at least ``limit`` promises about lengths and q-grams."""

    def __init__(self, limit: float):
        promise = lambda q: limit * (2 * q - 1) / 2 - (q - 1)
        self.limit = limit
        self.q = next(q for q in (3, 2, 1) if q == 1 or promise(q) >= 0.1)
        self.c = promise(self.q)
        self.shorter = limit / (2 - limit)  # least ratio of lengths
        # texts below this length need keys of single signs, and so do those that may be like one of them
        self.least = 0 if self.q == 1 else math.ceil(self.q / (self.c * (1 + self.shorter)))

    def needed(self, q: int, size: int) -> int:
        """q-grams that a text of ``size`` signs shares at least with any text it is like."""
        c = self.limit * (2 * q - 1) / 2 - (q - 1)
        return max(1, math.ceil(c * size * (1 + self.shorter) - (q - 1) - 1e-9))

    def key_sets(self, text: str) -> list[tuple[int, "np.ndarray"]]:  # noqa: F821
        """(q, keys) of all grams of a text, the n-th of equal ones apart."""
        import numpy as np

        kinds = ([1] if len(text) < self.least / self.shorter or self.q == 1 else []) + ([self.q] if len(text) >= self.least and self.q > 1 else [])
        signs = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        out = []
        for q in kinds:
            if len(signs) < q:
                continue
            gram = np.zeros(len(signs) - q + 1, np.uint64)  # 21 bits a sign
            for i in range(q):
                gram = (gram << np.uint64(21)) | signs[i : len(signs) - q + 1 + i]
            gram.sort()
            begins = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
            nth = np.arange(len(gram)) - np.repeat(begins, np.diff(np.r_[begins, len(gram)]))
            mixed = (gram ^ np.uint64(q << 61)) * np.uint64(0x9E3779B97F4A7C15) + nth.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            out.append((q, np.unique((mixed ^ (mixed >> np.uint64(32))).view(np.int64))))
        return out

    def keys(self, text: str) -> list[tuple[int, int]]:
        """(key, q) of the same."""
        return [(int(k), q) for q, ks in self.key_sets(text) for k in ks]

    def close(self, a: Column, b: Column) -> Column:
        """Whether texts of these lengths can be alike."""
        return 2 * F.least(a, b) >= self.limit * (a + b) - 1e-9

    def close_sizes(self, a: int, b: int) -> bool:
        """The same of numbers."""
        return 2 * min(a, b) >= self.limit * (a + b) - 1e-9


def _keys_of(limit: float):
    def keys(batches):
        import numpy as np
        import pyarrow as pa

        def rows(ids, qs, sets):
            ends = np.cumsum([0, *map(len, sets)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets)))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(qs, pa.int32()), lists], ["id", "q", "ks"])

        told = Filter(limit)
        for batch in batches:
            ids, qs, sets, n = [], [], [], 0
            for i, text in zip(batch.column("id").to_pylist(), batch.column("low")):
                for q, ks in told.key_sets(text.as_py()):
                    ids.append(i)
                    qs.append(q)
                    sets.append(ks)
                    n += len(ks)
                if n >= BATCH:
                    yield rows(ids, qs, sets)
                    ids, qs, sets, n = [], [], [], 0
            if ids:
                yield rows(ids, qs, sets)

    return keys


def _places(text: str) -> dict[str, int]:
    """Of each sign of a text a number whose bits are its places."""
    out: dict[str, int] = {}
    for i, c in enumerate(text):
        out[c] = out.get(c, 0) | 1 << i
    return out


def _common(places: dict[str, int], size: int, text: str) -> int:
    """The length of the longest common subsequence of a text and one of ``size`` signs, a row of its table as the bits of a number."""
    full = (1 << size) - 1
    row = full
    for c in text:
        if c in places:
            met = row & places[c]
            row = (row + met | row - met) & full
    return size - row.bit_count()


def _alike(limit: float):
    def alike(new, old):
        import pandas as pd
        from collections import Counter

        out, last = [], None
        for a, b in zip(new, old):
            if a != last:
                last, signs, places = a, Counter(a), _places(a)
            # what difflib matches is a common subsequence, and no more than the signs in common: bounds by its own formula
            bound = lambda n: (2.0 * n / size if size else 1.0) >= limit
            size = len(a) + len(b)
            out.append(bound((signs & Counter(b)).total()) and bound(_common(places, len(a), b)) and ratio(a, b) >= limit)
        return pd.Series(out, dtype=bool)

    return F.pandas_udf(alike, "boolean")


def _like_itself(texts):
    import pandas as pd

    return pd.Series([ratio(t, t) for t in texts], dtype=float)


def _prefixes(nodes: DataFrame, told: Filter) -> DataFrame:
    """(run, k, id, at, size, need): the keys of each item that it must share ``need`` of with any item it is like."""
    rows = nodes.select("id", "low").mapInArrow(_keys_of(told.limit), "id long, q int, ks array<long>")
    rows = rows.join(nodes.select("run", "id", "at", "size"), "id").select("run", "id", "at", "size", "q", F.explode("ks").alias("k"))
    often = rows.groupBy("run", "k").agg(F.count("*").alias("df"))
    per = rows.join(often, ["run", "k"]).groupBy("run", "id", "at", "size", "q").agg(F.sort_array(F.collect_list(F.struct("df", "k"))).alias("ks"))  # a text's own grams
    c = lambda q: told.limit * (2 * q - 1) / 2 - (q - 1)
    needed = lambda q: F.greatest(F.lit(1), F.ceil(c(q) * F.col("size") * (1 + told.shorter) - (q - 1) - 1e-9))
    need = F.when(F.col("q") == 1, needed(1)).otherwise(needed(told.q)).cast("int")
    per = per.withColumn("whole", need).withColumn("need", F.least(F.lit(SHARED), F.col("whole")))
    length = F.greatest(F.lit(0), F.size("ks") - F.col("whole") + F.col("need"))
    return per.select("run", "id", "at", "size", "q", "need", F.explode(F.slice("ks", 1, length)).alias("s")).select("run", "q", F.col("s.k").alias("k"), "id", "at", "size", "need")


def _pairs(keys: DataFrame, told: Filter) -> DataFrame:
    """(new, old) of items and earlier ones that share enough keys."""
    old = keys.select("run", "q", "k", *[F.col(c).alias(f"old_{c}") for c in ("id", "at", "size", "need")])
    met = keys.join(old, ["run", "q", "k"]).filter((F.col("old_at") < F.col("at")) & told.close(F.col("size"), F.col("old_size")))
    shared = met.groupBy(F.col("id").alias("new"), F.col("old_id").alias("old"), "q").agg(F.count("*").alias("n"), F.min(F.least("need", "old_need")).alias("need"))
    return shared.filter("n >= need").select("new", "old").distinct()


def _edges(pairs: DataFrame, nodes: DataFrame, limit: float) -> DataFrame:
    """The pairs (new, old) that are alike."""
    texts = nodes.select("id", "low")
    both = pairs.join(texts.select(F.col("id").alias("new"), F.col("low").alias("a")), "new").join(texts.select(F.col("id").alias("old"), F.col("low").alias("b")), "old")
    return both.filter(_alike(limit)("a", "b")).select("new", "old")


def _lost_of_short(rows: DataFrame, told: Filter) -> DataFrame:
    """(id) of the items of short runs that go. The pairs of a run are rows that stream; of the like ones, sorted, an item goes by an earlier one that stays."""
    runs = rows.groupBy("run").agg(F.sort_array(F.collect_list(F.struct("at", "size", "low"))).alias("own"))
    each = runs.select("run", "own", F.posexplode("own").alias("i", "new"))
    met = each.select("run", "new", F.explode(F.filter(F.slice("own", F.lit(1), F.col("i")), lambda old: told.close(old["size"], F.col("new.size")))).alias("old"))
    like = met.filter(_alike(told.limit)("new.low", "old.low")).select("run", F.col("new.at").alias("new"), F.col("old.at").alias("old"))
    pairs = like.groupBy("run").agg(F.sort_array(F.collect_list(F.struct("new", "old"))).alias("ps"))
    gone = F.aggregate("ps", F.array().cast("array<bigint>"), lambda gone, p: F.when(F.array_contains(gone, p["old"]["id"]), gone).otherwise(F.array_union(gone, F.array(p["new"]["id"]))))
    return pairs.select(F.explode(gone).alias("id"))


def _kept_of_long(rows: DataFrame, told: Filter, folder: str) -> DataFrame:
    """(id) of the items of long runs that stay."""
    limit = told.limit
    first = rows.groupBy("run", "low").agg(F.min("at").alias("first"))
    itself = F.when(F.length("low") < POPULAR, F.lit(1.0)).otherwise(F.pandas_udf(_like_itself, "double")("low"))
    first = first.select("run", "low", F.col("first.id").alias("first"), (itself >= limit).alias("once"))
    nodes = rows.join(first, ["run", "low"]).filter(~F.col("once") | (F.col("id") == F.col("first")))
    nodes = written(nodes.select("run", "low", "id", "at", "size"), f"{folder}/nodes")
    keys = written(_prefixes(nodes, told), f"{folder}/keys")
    open_ids, stayed, n = nodes.select("id"), [], 0
    while True:
        own = keys.join(open_ids, "id", "left_semi")
        mins = own.groupBy("run", "q", "k").agg(F.min(F.struct("at", "id", "size")).alias("m"))
        met = own.join(mins, ["run", "q", "k"]).filter(F.col("id") != F.col("m.id"))
        # first for all its keys: every earlier item that it could be like has gone, or has stayed and been compared when it was first itself
        free = written(open_ids.join(met.select("id"), "id", "left_anti"), f"{folder}/free/{n}")
        stayed.append(free)
        pairs = met.filter(told.close(F.col("size"), F.col("m.size"))).select(F.col("id").alias("new"), F.col("m.id").alias("old")).distinct()
        pairs = pairs.join(free.select(F.col("id").alias("old")), "old", "left_semi")
        out = written(_edges(pairs, nodes, limit).select(F.col("new").alias("id")).distinct(), f"{folder}/out/{n}")
        open_ids = written(open_ids.join(free, "id", "left_anti").join(out, "id", "left_anti"), f"{folder}/open/{n}")
        n += 1
        lost, left = out.count(), open_ids.count()
        if not left or lost * WORTH < left:
            break
    kept = stayed[0]
    for s in stayed[1:]:
        kept = kept.unionByName(s)
    if left:
        rest = keys.join(open_ids, "id", "left_semi")
        edges = written(_edges(_pairs(rest, told), nodes, limit), f"{folder}/edges")
        n = 0
        while open_ids.head(1):
            mine = edges.join(open_ids.select(F.col("id").alias("new")), "new", "left_semi").join(open_ids.select(F.col("id").alias("old")), "old", "left_semi")
            free = written(open_ids.join(mine.select(F.col("new").alias("id")), "id", "left_anti"), f"{folder}/first/{n}")
            kept = kept.unionByName(free)
            out = mine.join(free.select(F.col("id").alias("old")), "old", "left_semi").select(F.col("new").alias("id"))
            open_ids = written(open_ids.join(free, "id", "left_anti").join(out, "id", "left_anti"), f"{folder}/undecided/{n}")
            n += 1
    return kept


def greedy_dedup(items: DataFrame, run: str = "run_id", order: str = "item_idx", text: str = "text", limit: float = RATIO) -> DataFrame:
    """The items that the greedy rule keeps, in each run, in the order of ``order``.

    A null text counts as empty; null runs are one run; of items of equal order the one whose text has the lesser hash is first. Works for limits above 0.5.
    """
    spark, told = items.sparkSession, Filter(limit)
    folder = shared_folder(spark, "greedy-dedup")
    low = F.lower(F.coalesce(F.col(text).cast("string"), F.lit("")))
    key = F.coalesce(F.to_json(F.struct(F.col(run).alias("r"))), F.lit(""))
    rows = items.select(F.struct(*[F.col(f"`{c}`") for c in items.columns]).alias("row"), key.alias("run"), F.struct(F.col(order).alias("order"), F.xxhash64(low).alias("tie"), F.monotonically_increasing_id().alias("id")).alias("at"), F.length(low).alias("size"))
    # places in the order are numbers, so that joins carry no texts
    rows = written(rows.withColumn("id", F.col("at.id")), f"{folder}/rows")
    told_rows = rows.withColumn("low", F.lower(F.coalesce(F.col("row").getField(text).cast("string"), F.lit(""))))
    sizes = rows.groupBy("run").agg(F.count("*").alias("n"), F.sum("size").alias("signs"))
    long = written(sizes.filter((F.col("n") > FEW) | (F.col("signs") > SIGNS) & (F.col("n") > 1)).select("run"), f"{folder}/long")
    gone = _lost_of_short(told_rows.join(long, "run", "left_anti"), told)
    if long.head(1):
        mine = told_rows.join(long, "run", "left_semi").drop("row")
        gone = gone.union(mine.select("id").join(_kept_of_long(mine, told, folder), "id", "left_anti"))
    gone = written(gone, f"{folder}/gone")
    for part in ("long", "nodes", "keys", "free", "out", "open", "edges", "undecided", "first"):
        dropped(spark, f"{folder}/{part}")
    return rows.join(gone, "id", "left_anti").select(*[F.col("row").getField(c).alias(c) for c in items.columns])
