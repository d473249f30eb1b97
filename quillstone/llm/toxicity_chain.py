"""Toxicity by a classifier chain of linear models over words.

Categories are predicted one after the other; the model of a category also sees the probabilities of those before it.
In training these are out-of-fold predictions, so that a later model meets them as imprecise as they will be. The
categories come from the two labels of a row alone, not from its words: ``toxic``; ``toxic_spam``, toxic and of low quality; and
``toxic_prose``, toxic and of good quality.

The last two are parts of the first and exclude each other. Their probabilities are therefore cut to what is left of that of ``toxic``, in
training as in scoring, and a document gets one of them at most, the first in the chain that reaches its threshold, and only if it is toxic itself.

A category is decided at the threshold of best F1 among those at which at least ``LEAST_PRECISION`` of the out-of-fold decisions are right, even if the
right ones were fewer by their square root; one with fewer
than ``LEAST_POSITIVES`` examples, or without such a threshold, is not decided: its probability is given, and no document gets it.

The models are trained on the driver from a sample of labelled rows of at most ``most_rows`` ids, the lowest by a hash of the
id, and of at most ``most_text_words`` distinct words a row, the lowest by hash: documented bounds. Words are chosen by a chi-square test, at most ``most_words``. Every
document's whole text is scored, in numpy over Arrow batches.

Defined cases: a null text counts as empty and gets the models' base rate; rows are judged one by one, so repeated
rows are judged alike; of several rows of one labelled id one is trained on; labels without a document, or null labels, do not count; with no labelled rows of both
kinds a category's probability is its rate (0 without labels); an empty table gives an empty result; other
columns pass through inside ``row``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta
from .common import bounded_batches, text_of, trimmed

CATEGORIES = ("toxic", "toxic_spam", "toxic_prose")
MOST_ROWS, MOST_WORDS, FOLDS = 5_000, 400, 5
LEAST_CHI2, LEAST_DOCS = 30.0, 5
LEAST_PRECISION, LEAST_POSITIVES = 0.5, 10
MOST_TEXT_WORDS = 20_000
#: The threshold of a category that is not decided.
NEVER = 2.0


@dataclass
class Chain:
    """Sorted word hashes, per category a weight for each word, for each earlier category and a bias; thresholds."""

    words: np.ndarray
    weights: list[np.ndarray] = field(default_factory=list)
    earlier: list[np.ndarray] = field(default_factory=list)
    bias: list[float] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)

    def logits(self, j: int, x: np.ndarray, before: np.ndarray) -> np.ndarray:
        return x @ self.weights[j] + before @ self.earlier[j] + self.bias[j]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 2.0, rounds: int = 25) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last weight is the bias and is not shrunk."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    rate = min(max(y.mean(), 1e-4), 1 - 1e-4) if len(y) else 1e-4
    w[-1] = np.log(rate / (1 - rate))
    if not len(y) or y.min() == y.max():
        return w
    shrink = np.full(len(w), ridge)
    shrink[-1] = 1e-6
    for _ in range(rounds):
        p = _sigmoid(x @ w)
        grad = x.T @ (p - y) + shrink * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink), grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _best_threshold(p: np.ndarray, y: np.ndarray, able: np.ndarray | None = None) -> float:
    """The threshold of best F1 on out-of-fold probabilities, of those with a precision of at least ``LEAST_PRECISION``, chance taken off.

    ``able`` marks the rows that can get the category at all; ties of probabilities are decided alike.
    """
    able = np.ones(len(p), bool) if able is None else able
    if y.sum() < LEAST_POSITIVES or not able.any():
        return NEVER
    order = np.flatnonzero(able)
    order = order[np.argsort(-p[order], kind="stable")]
    q, hit = p[order], np.cumsum(y[order])
    n = np.arange(1, len(order) + 1)
    last = np.append(q[1:] != q[:-1], True)
    good = last & (hit - np.sqrt(hit) >= LEAST_PRECISION * n) & (hit > 0)
    if not good.any():
        return NEVER
    i = int(np.argmax(np.where(good, 2 * hit / (n + y.sum()), -1)))
    low = q[i + 1] if i + 1 < len(q) else 0.0
    return float((q[i] + low) / 2)


def _cut(j: int, p: np.ndarray, before: np.ndarray) -> np.ndarray:
    """A part's probability within what earlier parts leave of the first category's."""
    return p if j == 0 else np.minimum(p, np.maximum(before[:, 0] - before[:, 1:j].sum(1), 0))


def decided(p: np.ndarray, threshold: list[float]) -> np.ndarray:
    """(rows, categories) verdicts from probabilities: parts only of what is toxic, the first in the chain that reaches its threshold."""
    out = p >= np.array(threshold)
    for j in range(1, p.shape[1]):
        out[:, j] &= out[:, 0] & ~out[:, 1:j].any(1)
    return out


def _choose(word_of: np.ndarray, row_of: np.ndarray, targets: list[np.ndarray], n: int, most: int) -> np.ndarray:
    """Hashes of the words that a chi-square test ties to a target."""
    words, at, df = np.unique(word_of, return_inverse=True, return_counts=True)
    best = np.zeros(len(words))
    for y in targets:
        pos = y.sum()
        if not 0 < pos < n:
            continue
        a = np.bincount(at, y[row_of], len(words))
        expect = df * pos / n
        chi2 = (a - expect) ** 2 / np.maximum(expect * (1 - pos / n) * (1 - df / n), 1e-9)
        best = np.maximum(best, np.where(a >= 1, chi2, 0))
    good = np.flatnonzero((best >= LEAST_CHI2) & (df >= LEAST_DOCS))
    good = good[np.lexsort((words[good], -best[good]))][:most]
    return np.sort(words[good])


def _distinct_rows(hashes: list[np.ndarray]) -> list[int]:
    """Rows of which no earlier one is a near copy: two of three minima over the words agree in near copies."""
    seen, out = set(), []
    for i, h in enumerate(hashes):
        if not len(h):
            continue
        low = [int(ta.mix64(h + np.uint64(c)).min()) for c in (1, 2, 3)]
        keys = {(0, low[0], low[1]), (1, low[0], low[2]), (2, low[1], low[2])}
        if not keys & seen:
            out.append(i)
        seen |= keys
    return out


def train_chain(hashes: list[np.ndarray], labels: dict[str, np.ndarray], most_words: int = MOST_WORDS, folds: int = FOLDS) -> Chain:
    """Fit the chain on rows given by their distinct word hashes; near copies of a row count once."""
    alone = _distinct_rows(hashes)
    hashes, n = [hashes[i] for i in alone], len(alone)
    low, toxic = (labels[c][alone].astype(float) for c in ("low_quality", "toxic"))
    word_of = np.concatenate(hashes) if n else np.zeros(0, np.uint64)
    row_of = np.repeat(np.arange(n), [len(h) for h in hashes])
    words = _choose(word_of, row_of, [toxic, low], n, most_words)
    x = np.zeros((n, len(words)))
    if len(words):
        i = np.minimum(np.searchsorted(words, word_of), len(words) - 1)
        hit = words[i] == word_of
        x[row_of[hit], i[hit]] = 1
    targets = [toxic, toxic * low, toxic * (1 - low)]
    chain = Chain(words)
    before = np.zeros((n, 0))
    fold = np.arange(n) % folds
    for y in targets:
        full = np.column_stack([x, before])
        w = _fit(full, y)
        chain.weights.append(w[: len(words)])
        chain.earlier.append(w[len(words) : -1])
        chain.bias.append(float(w[-1]))
        out = np.zeros(n)
        for k in range(folds):
            rest, mine = fold != k, fold == k
            if mine.any():
                v = _fit(full[rest], y[rest])
                out[mine] = _sigmoid(full[mine] @ v[:-1] + v[-1])
        before = np.column_stack([before, _cut(len(chain.bias) - 1, out, before)])
    for j, y in enumerate(targets):
        so_far = decided(before[:, :j], chain.threshold)
        able = so_far[:, 0] & ~so_far[:, 1:].any(1) if j else None
        chain.threshold.append(_best_threshold(before[:, j], y, able))
    return chain


def predict(chain: Chain, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(texts, categories) probabilities from all word hashes of the texts."""
    n = len(bounds) - 1
    at, doc = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(chain.words) and len(words):
        seen = np.zeros(1 << 16, bool)
        seen[chain.words >> np.uint64(48)] = True
        some = np.flatnonzero(seen[words >> np.uint64(48)])
        i = np.minimum(np.searchsorted(chain.words, words[some]), len(chain.words) - 1)
        hit = chain.words[i] == words[some]
        pair = np.unique(ta.owners(bounds)[some[hit]] * len(chain.words) + i[hit])
        doc, at = pair // len(chain.words), pair % len(chain.words)
    out = np.zeros((n, len(chain.weights)))
    for j, w in enumerate(chain.weights):
        z = np.bincount(doc, w[at], n) + out[:, :j] @ chain.earlier[j] + chain.bias[j]
        out[:, j] = _cut(j, _sigmoid(z), out)
    return out


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return ta.word_hashes(*ta.flat_bytes(column, lower=True))


def _train_task(most: int):
    names = ["id", "low_quality", "toxic", "place"]

    def task(batches):
        for batch in batches:
            text = batch.column("text")
            for a, b in ta.slices(text):
                h, at = ta.distinct(*_words(text.slice(a, b - a)))  # sorted in each text
                words = pa.array([h[i : min(j, i + most)].tobytes() for i, j in zip(at, at[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in names), words], [*names, "words"])

    return task


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", most_rows: int = MOST_ROWS, most_text_words: int = MOST_TEXT_WORDS) -> Chain:
    """Draw the sample of labelled rows and fit the chain on it."""
    named = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col("quality").cast("int").alias("q"), F.col("toxic").cast("int").alias("x"))
    place = F.xxhash64("id", F.lit("sample"))
    sample = named.filter("id is not null and q is not null and x is not null").groupBy("id").agg(F.min("q").alias("q"), F.max("x").alias("x"))
    sample = sample.withColumn("place", place).orderBy("place", "id").limit(most_rows)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_of(docs, text).alias("text"))
    joined = rows.join(F.broadcast(sample), "id").select("id", (F.col("q") == 0).alias("low_quality"), (F.col("x") == 1).alias("toxic"), "place", "text")  # most_rows rows in the sample
    found = joined.mapInArrow(trimmed(_train_task(most_text_words)), "id long, low_quality boolean, toxic boolean, place long, words binary")
    table = found.groupBy("place", "id", "low_quality", "toxic").agg(F.min("words").alias("words")).toArrow()  # a row an id
    order = np.argsort(np.asarray(table.column("place")), kind="stable") if table.num_rows else []
    words = table.column("words").to_pylist()
    hashes = [np.frombuffer(words[i], np.uint64) for i in order]
    pick = lambda c: np.array(table.column(c).to_pylist(), bool)[order] if table.num_rows else np.zeros(0, bool)
    return train_chain(hashes, {c: pick(c) for c in ("low_quality", "toxic")})


def _score_task(chain):
    def task(batches):
        for batch in batches:
            text = batch.column("text")
            for a, b in ta.slices(text):
                p = predict(chain.value, *_words(text.slice(a, b - a)))
                verdicts = decided(p, chain.value.threshold)
                columns = [pa.array(m[:, j]) for m in (p, verdicts) for j in range(len(CATEGORIES))]
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(a, b - a), *columns], ["row", *[f"{k}_{c}" for k in ("p", "is") for c in CATEGORIES]])

    return task


def score(docs: DataFrame, chain: Chain, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row`` (the columns in ``keep``; all if None), p_<category> and is_<category> of every document."""
    keep = docs.columns if keep is None else keep
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), text_of(docs, text).alias("text"))
    bounded_batches(docs.sparkSession)
    schema = rows.select("row").schema
    for c in CATEGORIES:
        schema = schema.add(f"p_{c}", "double")
    for c in CATEGORIES:
        schema = schema.add(f"is_{c}", "boolean")
    return rows.mapInArrow(trimmed(_score_task(docs.sparkSession.sparkContext.broadcast(chain))), schema)
