"""Target-distribution importance resampling over hashed word n-grams, counted and scored in partition-local word tries.

Features of a text are its words and its pairs of consecutive words, joined by one space; a feature's bucket is its CRC-32 modulo
``BUCKETS``. The gain of a bucket says how much commoner its features are in the target than in the documents, a document's weight is
the mean gain of its features, and documents are drawn by weight and Gumbel noise, so that no normalisation over all is needed.

Each task keeps a :class:`WordTrie`: a node of depth one for each word, a node of depth two for each word behind it. A node holds its
CRC state, from which the state of a child follows by the word's bytes alone (a linear map for each number of bytes), so
that no pair is ever spelled out. When counting, nodes hold counts, which end as one total a bucket and task; the sums of these are at most
``BUCKETS`` rows for the driver. When scoring, the tries are walked again with the buckets' gains attached to the nodes. A trie
of more than ``MOST_NODES`` nodes gives its totals away and begins anew, so its memory has a bound and no count is lost.

Ranks need no global sort: scores are integers in a range that the gains bound, so their histogram is small; a row's rank is the number of
rows of higher scores, and its place by id among those of its own.

Defined cases: a null or empty text has no features, weight 0, and is never drawn; a null id has noise of its own (that of an empty
id), and comes first in ties; repeated rows are counted, scored and drawn as often as they come, their order among themselves is open; ties go to smaller ids;
an empty target has T = 0, empty documents give an empty result; other columns pass through inside ``row``.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textarrays as ta
from .common import bounded_batches, materialize, text_of, trimmed

BUCKETS, SEED, SHARE, LEAST_WORDS = 10_000, 7, 25, 20
#: Nodes of one trie, and bytes of texts that walk it at once.
MOST_NODES, SLICE = 2_000_000, 2_000_000
#: Words of up to so many bytes extend a CRC state by table; longer ones, byte by byte.
LONGEST = 64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _shifts() -> np.ndarray:
    """By number of bytes n, place k and value v: the CRC state v << 8 k after n zero bytes."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, np.uint32(0xEDB88320), np.uint32(0)) ^ (one >> np.uint32(1))
    out = np.zeros((LONGEST + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, LONGEST + 1):
        out[n] = one[out[n - 1] & 255] ^ (out[n - 1] >> np.uint32(8))
    return out.ravel()


_SHIFTS = _shifts()


def extended(states: np.ndarray, tails: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32 of strings with CRC ``states`` followed by strings of ``sizes`` bytes with CRC ``tails``."""
    base = sizes.astype(np.int64) * 1024
    out = tails.copy()
    for k in range(4):
        out ^= _SHIFTS[base + 256 * k + ((states >> np.uint32(8 * k)) & np.uint32(255))]
    return out


def words_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All words of the texts, A-Z in lower case, as codes of distinct words, and the bounds of each text's words."""
    raw, bounds = ta.flat_bytes(texts)
    raw = _LOWER[raw]
    inside = ta.ALNUM[raw]
    starts, ends = ta.stretches(raw, bounds, inside)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])])
    return words.dictionary_encode(), np.searchsorted(starts, bounds)


class WordTrie:
    """Words and pairs met by one task. ``value`` maps buckets to what nodes hold when scoring."""

    def __init__(self, buckets: int = BUCKETS, value: np.ndarray | None = None, most: int = MOST_NODES):
        self.buckets, self.value, self.most = buckets, value, most
        self.totals = np.zeros(buckets, np.int64)
        self._plant()

    def _plant(self) -> None:
        self.node: dict[bytes, int] = {}
        self.words: list[bytes] = []
        self.state = np.zeros(0, np.uint32)  # of the word alone
        self.tail = np.zeros(0, np.uint32)  # of a space and the word
        self.size = np.zeros(0, np.int64)
        self.seen = np.zeros(0, np.int64)
        self.pairs = np.zeros(0, np.int64)  # first node << 32 | second node, sorted
        self.held = np.zeros(0, np.int64)  # their counts, or values

    def _nodes(self, words: list[bytes]) -> np.ndarray:
        """Nodes of distinct words, planted where they are missing."""
        found = [self.node.setdefault(w, len(self.node)) for w in words]
        fresh = [w for w, i in zip(words, found) if i >= len(self.words)]
        if fresh:
            self.words += fresh
            self.state = np.append(self.state, np.array([zlib.crc32(w) for w in fresh], np.uint32))
            self.tail = np.append(self.tail, np.array([zlib.crc32(b" " + w) for w in fresh], np.uint32))
            self.size = np.append(self.size, np.array([len(w) + 1 for w in fresh], np.int64))
            self.seen = np.append(self.seen, np.zeros(len(fresh), np.int64))
        return np.array(found, np.int64)

    def _bucket(self, states: np.ndarray) -> np.ndarray:
        return (states % np.uint32(self.buckets)).astype(np.int64)

    def _pair_buckets(self, pairs: np.ndarray) -> np.ndarray:
        first, second = pairs >> 32, pairs & 0xFFFFFFFF
        size = self.size[second]
        out = extended(self.state[first], self.tail[second], np.minimum(size, LONGEST))
        for i in np.flatnonzero(size > LONGEST):
            out[i] = zlib.crc32(b" " + self.words[second[i]], int(self.state[first[i]]))
        return self._bucket(out)

    def _walk(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Nodes of all words, the texts' bounds in them, pairs that stand in one text, and the number of the first word of each."""
        if len(self.words) + len(self.pairs) > self.most:
            self.flush()
        words, bounds = words_of(texts)
        nodes = self._nodes(words.dictionary.to_pylist())[np.asarray(words.indices)] if len(words) else np.zeros(0, np.int64)
        inner = np.ones(len(nodes) + 1, bool)
        inner[bounds] = False
        first = np.flatnonzero(inner[1 : len(nodes)]) if len(nodes) else np.zeros(0, np.int64)
        return nodes, bounds, nodes[first] << 32 | nodes[first + 1] if len(first) else first, first

    def _graft(self, pairs: np.ndarray, held: np.ndarray, at: np.ndarray) -> None:
        self.pairs, self.held = np.insert(self.pairs, at, pairs), np.insert(self.held, at, held)

    def _have(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.pairs, pairs)
        return at, (self.pairs[np.minimum(at, len(self.pairs) - 1)] == pairs) if len(self.pairs) else np.zeros(len(pairs), bool)

    def count(self, texts: pa.Array) -> None:
        """Count all features of the texts."""
        nodes, _, pairs, _ = self._walk(texts)
        self.seen += np.bincount(nodes, minlength=len(self.seen))
        pairs, n = np.unique(pairs, return_counts=True)
        at, have = self._have(pairs)
        self.held[at[have]] += n[have]
        self._graft(pairs[~have], n[~have], at[~have])

    def flush(self) -> None:
        """Move all counts to the totals of the buckets, and begin anew."""
        if self.value is None:
            for bucket, n in ((self._bucket(self.state), self.seen), (self._pair_buckets(self.pairs), self.held)):
                np.add.at(self.totals, bucket, n)
        self._plant()

    def sums(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of words and features, and the sum of the features' values, for each text."""
        nodes, bounds, pairs, first = self._walk(texts)
        own, where = np.unique(pairs, return_inverse=True)
        at, have = self._have(own)
        value = np.zeros(len(own), np.int64)
        value[have] = self.held[at[have]]
        value[~have] = self.value[self._pair_buckets(own[~have])]
        self._graft(own[~have], value[~have], at[~have])
        gained = self.value[self._bucket(self.state)][nodes] if len(nodes) else np.zeros(0, np.int64)
        np.add.at(gained, first, value[where])
        n_words = np.diff(bounds)
        return n_words, n_words + np.maximum(n_words - 1, 0), ta.per_text(gained, bounds)


def _count_task(buckets: int, most: int):
    def task(batches):
        trie = WordTrie(buckets, most=most)
        for batch in batches:
            text = batch.column("text")
            for a, b in ta.slices(text, SLICE):
                trie.count(text.slice(a, b - a))
        trie.flush()
        some = np.flatnonzero(trie.totals)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(trie.totals[some])], ["bucket", "n"])

    return trimmed(task)


def bucket_totals(docs: DataFrame, text: str = "text", buckets: int = BUCKETS, most: int = MOST_NODES) -> np.ndarray:
    """How many features of all texts fall into each bucket."""
    bounded_batches(docs.sparkSession)
    counts = docs.select(text_of(docs, text).alias("text")).mapInArrow(_count_task(buckets, most), "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for bucket, n in counts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # ``buckets`` rows at most
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of each bucket, in thousandths of a natural logarithm, rounded down."""
    n, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    ratio = [(t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)) for s, t in zip(source.tolist(), target.tolist())]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Gumbel noise of a document, in thousandths, rounded down."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _score_task(value: np.ndarray, seed: int, most: int):
    def task(batches):
        trie = WordTrie(len(value), value, most)
        for batch in batches:
            text, ids = batch.column("text"), batch.column("id")
            for a, b in ta.slices(text, SLICE):
                words, features, total = trie.sums(text.slice(a, b - a))
                weight = np.where(features > 0, total // np.maximum(features, 1), 0)
                own = ids.slice(a, b - a)
                score = weight + np.array([noise(i, seed) for i in own.to_pylist()], np.int64)
                columns = [batch.column("row").slice(a, b - a), own, *(pa.array(x.astype(np.int64)) for x in (words, features, weight, score))]
                yield pa.RecordBatch.from_arrays(columns, ["row", "id", "n_words", "n_features", "weight", "score"])

    return trimmed(task)


def score(docs: DataFrame, value: np.ndarray, text: str = "text", id_col: str = "doc_id", keep: list[str] | None = None, seed: int = SEED, most: int = MOST_NODES) -> DataFrame:
    """``row`` (the columns in ``keep``; all if None), id, n_words, n_features, weight and score of every document."""
    keep = docs.columns if keep is None else keep
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), text_of(docs, text).alias("text"))
    schema = rows.select("row", "id").schema
    for name in ("n_words", "n_features", "weight", "score"):
        schema = schema.add(name, "long")
    return rows.mapInArrow(_score_task(value, seed, most), schema)


def draw(scored: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """``scored`` with ``rank`` 1, 2, 3 ... of the ``share`` percent drawn, null for the others. ``scored`` must be a written table."""
    fit = F.col("n_words") >= least_words
    higher = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    # one row a score: as many as the gains and the noise span at most
    levels = scored.filter(fit).groupBy("score").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(higher), F.lit(0)))
    levels = materialize(levels.coalesce(1), "score-levels")
    drawn = share * (levels.agg(F.sum("n")).first()[0] or 0) // 100
    levels = levels.filter(F.col("before") < drawn).select("score", "before")
    lowest = levels.agg(F.min("score")).first()[0]
    if lowest is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    high = fit & (F.col("score") >= lowest)
    place = F.row_number().over(Window.partitionBy("score").orderBy(F.col("id").asc_nulls_first())) + F.col("before")
    ranked = scored.filter(high).join(F.broadcast(levels), "score").withColumn("rank", F.when(place <= drawn, place).cast("long"))
    rest = scored.filter(~high).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*rest.columns).unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", keep: list[str] | None = None, share: int = SHARE, seed: int = SEED, **options) -> DataFrame:
    """``row``, n_words, n_features, weight, score and rank of every document, drawn towards the texts of ``target``."""
    value = gains(bucket_totals(docs, text), bucket_totals(target, target_text))
    return draw(materialize(score(docs, value, text, keep=keep, seed=seed, **options), "resample-scores"), share)


def oracle_sql() -> str:
    """The same as DuckDB SQL; CRC-32 bit by bit over each distinct feature."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    features = "list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return rf"""
WITH docs AS (
  SELECT row_number() OVER () AS nth, doc_id, w, {features} AS f FROM (SELECT doc_id, {words} AS w FROM documents)
), target AS (
  SELECT unnest({features}) AS f FROM (SELECT {words} AS w FROM benchmark)
), held AS (
  SELECT nth, unnest(f) AS f FROM docs
), spelled AS (
  SELECT f, hex(encode(f)) AS x FROM (SELECT f FROM held UNION SELECT f FROM target)
), coded AS (
  SELECT f, xor(list_reduce(
    list_transform(range(4 * length(x)), lambda j: (('0x' || substr(x, 2 * (j // 8)::INT + 1, 2))::BIGINT >> (j % 8)::BIGINT) & 1),
    lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1)), 4294967295), 4294967295) % {BUCKETS} AS bucket FROM spelled
), s AS (
  SELECT bucket, count(*) AS n FROM held JOIN coded USING (f) GROUP BY bucket
), t AS (
  SELECT bucket, count(*) AS n FROM target JOIN coded USING (f) GROUP BY bucket
), gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM s), 0) + {BUCKETS})::DOUBLE
    / ((coalesce(s.n, 0) + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM t), 0) + {BUCKETS})::DOUBLE)))::BIGINT AS gain FROM s FULL JOIN t USING (bucket)
), weighed AS (
  SELECT nth, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM held JOIN coded USING (f) JOIN gain USING (bucket) GROUP BY nth
), scored AS (
  SELECT doc_id, len(w) AS n_words, len(f)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM docs LEFT JOIN weighed USING (nth)
), ranked AS (
  SELECT *, CASE WHEN n_words >= {LEAST_WORDS} THEN row_number() OVER (PARTITION BY n_words >= {LEAST_WORDS} ORDER BY score DESC, doc_id NULLS FIRST) END AS r FROM scored
)
SELECT doc_id, n_features, weight, score,
  CASE WHEN r <= ({SHARE} * (SELECT count(*) FROM scored WHERE n_words >= {LEAST_WORDS})) // 100 THEN r END::BIGINT AS rank FROM ranked
"""
