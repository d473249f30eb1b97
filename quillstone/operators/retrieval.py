"""Dense, lexical and fused retrieval."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import dropped, shared_folder, written

RRF_K = 60
K1, B, EPSILON = 1.5, 0.75, 0.25


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, summed from left to right."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalized(v: Column) -> Column:
    """To length one; a zero vector stays. The length is bound once, not computed for each element."""
    size = F.array(F.when(norm(v) == 0, F.lit(1.0)).otherwise(norm(v)))
    return F.get(F.transform(size, lambda n: F.transform(v, lambda x: x.cast("double") / n)), F.lit(0))


def cosine(a: Column, b: Column) -> Column:
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def adjusted(v: Column, dimension: int) -> Column:
    """Cut or filled with zeros to ``dimension``."""
    return F.slice(F.concat(v.cast("array<double>"), F.array_repeat(F.lit(0.0), dimension)), 1, dimension)


def index_faults(vectors: DataFrame, model: str = "model_name", vector: str = "embedding") -> DataFrame:
    """(model, dimension, n) of every model and dimension; an index is sound if that is one row."""
    return vectors.groupBy(F.col(model).alias("model_name"), F.size(vector).alias("dimension")).agg(F.count("*").alias("n"))


def top_k(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` rows of highest cosine with one query: one scan, a heap of k rows a task."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.withColumn("score", F.round(cosine(F.col(vector), q), 6))
    return scored.orderBy(F.desc("score"), id_col).limit(k)


def _matrix(column, dimension: int):
    """(mask, matrix) of the rows of a list column that are vectors of this dimension."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    fits = pc.fill_null(pc.equal(pc.list_value_length(column), dimension), False)
    if column.flatten().null_count:
        fits = pa.array([bool(f) and None not in v for f, v in zip(fits.to_pylist(), column.to_pylist())])
    values = column.filter(fits).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    mask = fits.to_numpy(zero_copy_only=False)
    return mask, values.reshape(int(mask.sum()), max(dimension, 0))


def _left_sum(products):
    """Sums of rows, from left to right."""
    total = 0.0
    for column in products.T:
        total = total + column
    return total


def _rounded(x):
    """To six places, halves away from zero."""
    import numpy as np

    y = x * 1e6
    whole = np.trunc(y)
    return (whole + np.where(np.abs(y - whole) >= 0.5, np.sign(y), 0.0)) / 1e6 + 0.0


def _best_of_task(block, k: int, rows: int = 2000, pairs: int = 50_000):
    """A step over batches of (id, v): the k best rows a query of the block, by matrix products; what a product can't rule out is summed as a single cosine is."""

    def step(batches):
        import numpy as np
        import pandas as pd
        import pyarrow as pa

        ids, dimension, q = block.value
        size = np.sqrt(_left_sum(q * q)) if dimension > 0 else None
        unit = q / np.where(size == 0, 1.0, size)[:, None] if dimension > 0 else None
        best = pd.DataFrame({"q": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64"), "id": pd.Series(dtype="object")})
        unfit, kind, least = [], None, np.full(len(ids), -np.inf)
        for batch in batches:
            kind = batch.column("id").type
            mask, v = _matrix(batch.column("v"), dimension)
            names = batch.column("id").to_numpy(zero_copy_only=False)
            unfit = sorted([*unfit, *names[~mask].tolist()])[:k]
            names = names[mask]
            for i in range(0, len(names) if dimension > 0 else 0, rows):
                part, own = v[i : i + rows], names[i : i + rows]
                length = np.sqrt(_left_sum(part * part))
                near = unit @ (part / np.where(length == 0, 1.0, length)[:, None]).T
                bound = least
                if len(own) >= k and np.isneginf(least).any():
                    bound = np.maximum(least, np.partition(near, len(own) - k, axis=1)[:, len(own) - k])
                at, to = np.nonzero(near >= bound[:, None] - 2e-6)  # rounding moves a score by half of 1e-6 at most
                if not len(at):
                    continue
                found = [best]
                for j in range(0, len(at), pairs):
                    x, y = at[j : j + pairs], to[j : j + pairs]
                    whole = size[x] * length[y]
                    score = _rounded(np.where(whole == 0, 0.0, _left_sum(q[x] * part[y]) / np.where(whole == 0, 1.0, whole)))
                    found.append(pd.DataFrame({"q": x, "score": score, "id": own[y]}))
                    if sum(map(len, found)) > 10 * pairs + k * len(ids):
                        found = [_first(pd.concat(found[1 if found[0].empty else 0 :]), k)]
                best = _first(pd.concat(found[1 if best.empty else 0 :]), k)
                full = best.groupby("q").score.agg(["size", "min"])
                full = full[full["size"] == k]
                least[full.index.to_numpy()] = full["min"].to_numpy()
        if kind is None:
            return
        # rows without a score come last, the first ids first
        short = [(n, None, x) for n in range(len(ids)) for x in unfit] if unfit else []
        columns = list(zip(*[*zip(best.q.tolist(), best.score.tolist(), best.id.tolist()), *short])) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(columns[0], pa.int64())), pa.array(columns[2], kind), pa.array(columns[1], pa.float64())], ["query_id", "hit_id", "score"])

    return step


def _first(frame, k: int):
    return frame.sort_values(["q", "score", "id"], ascending=[True, False, True]).groupby("q").head(k)


def top_k_many(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", query_id: str = "query_id", vector: str = "embedding", most_queries: int = 2000) -> DataFrame:
    """(query_id, id, score, rank from 0) of the ``k`` best rows for each of a stated set of queries.

    The queries are taken in blocks of ``most_queries``, each broadcast against one scan. Each task of a scan keeps its k
    best rows a query before anything is shuffled.
    """
    import numpy as np

    spark = vectors.sparkSession
    n = queries.count()
    blocks = max(1, -(-n // most_queries))
    schema = f"query_id {queries.schema[query_id].dataType.simpleString()}, hit_id {vectors.schema[id_col].dataType.simpleString()}, score double"
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector).alias("v"))
    out = None
    for i in range(blocks):
        part = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64(query_id), F.lit(blocks)) == i)
        asked = part.select(F.col(query_id).alias("id"), F.col(vector).alias("v")).toArrow().combine_chunks()
        ids, column = asked.column("id").combine_chunks(), asked.column("v").combine_chunks()
        lengths = np.array([-1 if x is None else x for x in column.value_lengths().to_pylist()], np.int64)
        for dimension in sorted(set(lengths.tolist())) or []:
            own = np.flatnonzero(lengths == dimension)
            mask, matrix = _matrix(column.take(own), dimension)
            for chosen, of, q in ((own[mask], dimension, matrix), (own[~mask], -1, matrix[:0])):
                if len(chosen):
                    block = spark.sparkContext.broadcast((ids.take(chosen), of, q))
                    best = rows.mapInArrow(_best_of_task(block, k), schema)
                    out = best if out is None else out.union(best)
    if out is None:
        out = spark.createDataFrame([], schema)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "hit_id"))
    best = out.withColumn("rank", place - 1).filter(F.col("rank") < k)
    return best.select(F.col("query_id").alias(query_id), F.col("hit_id").alias(id_col), "score", "rank")


def tokens(text: Column) -> Column:
    """Lower-cased words between white space."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")


def bm25(docs: DataFrame, query: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score) of every document for one query, Okapi weights; documents without a query word score 0.

    One aggregation counts documents, their lengths and those that hold each of the query's words, a row for the driver; the scores are
    then a projection. Negative IDFs become ``EPSILON`` times the mean IDF of the vocabulary, which is only then counted, by word.
    """
    terms = query.lower().split()
    wanted = sorted(set(terms))
    rows = docs.select(F.col(id_col), tokens(F.col(text)).alias("w"))
    held = [F.count_if(F.array_contains("w", t)).alias(f"df{i}") for i, t in enumerate(wanted)]
    told = rows.agg(F.count("*").alias("n"), F.avg(F.size("w")).alias("mean_size"), *held).first()
    idf = lambda n, df: math.log(n - df + 0.5) - math.log(df + 0.5)
    weights = {t: idf(told["n"], told[f"df{i}"]) for i, t in enumerate(wanted) if told[f"df{i}"]}
    if any(w < 0 for w in weights.values()):
        df = rows.select(F.explode(F.array_distinct("w")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        mean = df.agg(F.avg(F.log(told["n"] - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))).first()[0]
        weights = {t: EPSILON * mean if w < 0 else w for t, w in weights.items()}
    parts = F.lit(0.0)
    for t in sorted(t for t in terms if t in weights):
        f = F.size(F.filter("w", _equals(t))).cast("double")
        parts = parts + F.when(f > 0, weights[t] * (f * (K1 + 1)) / (f + K1 * (1 - B + B * F.size("w") / told["mean_size"]))).otherwise(0.0)
    return rows.select(id_col, F.round(parts, 6).alias("score"))


def _equals(term: str):
    return lambda w: w == term


def _beaten(score: Column, row_id: Column, wanted: list[tuple[float, int]]) -> Column:
    """How many of ``wanted``, in order of rank, a row does not stand ahead of: a binary search as nested conditions."""

    def between(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        s, i = wanted[mid]
        return F.when((score > s) | ((score == s) & (row_id < i)), between(low, mid)).otherwise(between(mid + 1, high))

    return between(0, len(wanted))


def _places(scores: DataFrame, id_col: str, wanted: list[tuple[float, int]]) -> dict[int, int]:
    """Ranks from 0 of a few rows (score, id) among all: one aggregation to as many counts."""
    wanted = sorted(wanted, key=lambda w: (-w[0], w[1]))
    counts = dict(scores.groupBy(_beaten(F.col("score"), F.col(id_col), wanted).alias("b")).agg(F.count("*").alias("n")).collect())
    out, ahead = {}, 0
    for j, (_, i) in enumerate(wanted):
        ahead += counts.get(j, 0)
        out[i] = ahead
    return out


def fused_top(dense: DataFrame, lexical: DataFrame, top: int, id_col: str = "doc_id", k: int = RRF_K) -> DataFrame:
    """(id, rrf, rank from 0): the first ``top`` rows by reciprocal-rank fusion of two score tables (id, score), exactly, without ranking them.

    A row of rank R or more in both lists has at most 2 / (k + R), and ``top`` rows of either list have 1 / (k + top - 1) or more, so the ``R`` first
    rows of each list, R > k + 2 (top - 1), hold the result. They come by a heap of R rows a task; where they stand in the other list is
    counted, in one pass over it. A rank that is missing counts as the number of all rows. Ids are unique; ties go to smaller ids.
    """
    spark, folder = dense.sparkSession, shared_folder(dense.sparkSession, "fused")
    lists = [written(scores.select(id_col, "score"), f"{folder}/{nth}") for nth, scores in enumerate((dense, lexical))]
    total = lists[0].select(id_col).union(lists[1].select(id_col)).distinct().count()
    far = k + 2 * (top - 1) + 1
    first = [scores.orderBy(F.desc("score"), id_col).limit(far) for scores in lists]
    ids = sorted({r[0] for rows in first for r in rows.select(id_col).collect()})  # 2 R at most
    places = []
    for scores in lists:
        own = scores.filter(F.col(id_col).isin(ids)).collect() if ids else []
        places.append(_places(scores, id_col, [(r["score"], r[id_col]) for r in own]) if own else {})
    rrf = {i: 1.0 / (k + places[0].get(i, total)) + 1.0 / (k + places[1].get(i, total)) for i in ids}
    best = sorted(rrf, key=lambda i: (-rrf[i], i))[:top]
    dropped(spark, folder)
    return spark.createDataFrame([(i, rrf[i], n) for n, i in enumerate(best)], f"{id_col} long, rrf double, rank long")


def unique_parents(ranked: DataFrame, children: DataFrame, parents: DataFrame, pool: int = 10, child: str = "child_id", parent: str = "parent_id") -> DataFrame:
    """The first ``pool`` parents in order of their best child; parents that don't exist are passed over."""
    best = ranked.join(children.select(child, parent), child).groupBy(parent).agg(F.min("rank").alias("best_rank"))
    return parents.join(best, parent).orderBy("best_rank", parent).limit(pool)


def best_parents(hits: DataFrame, parent: str = "parent_id", k: int = 5) -> DataFrame:
    """(parent, score): the ``k`` parents of the best children, each with its best child's score."""
    return hits.groupBy(parent).agg(F.max("score").alias("score")).orderBy(F.desc("score"), parent).limit(k)


def reranked(pool: DataFrame, scorers: list, top: int = 5, rank: str = "best_rank") -> DataFrame:
    """The first scorer that works orders the pool; without any the fused order stays."""
    for scorer in scorers:
        try:
            return scorer(pool).orderBy(F.desc("relevance_score"), rank).limit(top)
        except NotImplementedError:
            continue
    return pool.withColumn("relevance_score", F.bround(1.0 / (RRF_K + F.col(rank)), 4)).orderBy(rank).limit(top)


def query_text(title: Column, profile: Column, fmt: Column, niche: Column) -> Column:
    return F.concat_ws(" ", title, profile, fmt, niche)


def hashed_embeddings(docs: DataFrame, id_col: str = "doc_id", text: str = "text", dimension: int = 64) -> DataFrame:
    """(id, embedding): a stand-in for a model. Words are hashed to signed coordinates and summed, one map-side combined
    aggregation; vectors have length one, those of texts without words are zero. Place and sign come from a word's MD5."""
    words = docs.select(F.col(id_col), F.explode_outer(tokens(F.col(text))).alias("w"))
    h = F.conv(F.substring(F.md5("w"), 1, 8), 16, 10).cast("long")
    spots = words.select(id_col, F.pmod(F.floor(h / 2), F.lit(dimension)).alias("i"), F.when(F.col("w").isNull(), 0.0).when(h % 2 == 1, 1.0).otherwise(-1.0).alias("s"))
    sums = spots.groupBy(id_col).agg(*[F.sum(F.when(F.col("i") == k, F.col("s")).otherwise(0.0)).alias(f"x{k}") for k in range(dimension)])
    return sums.select(id_col, F.array(*[f"x{k}" for k in range(dimension)]).alias("v")).select(id_col, normalized(F.col("v")).alias("embedding"))
