"""Token-ID / binary output: documents as Simple-8b coded token ids.

Format. A store is a folder of Parquet files whose rows are blocks. A block holds whole documents in ascending
(doc_id, text) order and has these columns:

``shard``, ``block``  place of the block: shards in order of doc_id, blocks in order within the shard
``doc_ids``           the ids of its documents
``lengths``           the numbers of token ids of its documents
``n_ids``             the number of token ids in the block
``words``             the coded ids: little-endian 64-bit words
``offsets``           little-endian 32-bit: for every ``STEP``-th id the number of the word that begins at or before
                      it, and the number of ids coded before that word, so that any id is found without decoding all
``crc32``             of the block's ids as little-endian unsigned 32-bit integers

A word has a selector in its four high bits and 60 bits of payload, the first id in the lowest bits. Selectors 1 to 14
pack 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2 or 1 ids of 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30 or 60 bits.
Selector 15 is the escape: the whole next word is one id of more than 60 bits. Selector 0 with payload n stands for
n zeros in a row.

Ordering. Shard bounds are quantiles of doc_id over all rows, merged to shards of about equal bytes of text; documents are tokenised
where they are read, and only ids move to the shards. Positions of documents over the whole store need one number per shard.

Defined cases: a null text counts as empty and yields the end id alone; null ids come first and come back as null;
repeated rows are stored as often as they come; special-token strings in a text are left to the tokenizer;
an empty table gives an empty store; other columns are not stored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, shared_root, text_of, trimmed
from .textarrays import slices

WIDTHS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
COUNTS = 60 // WIDTHS
STEP, BLOCK_IDS = 4096, 1 << 18
END_ID = 2
ZERO_RUN, ESCAPE = 0, 15
LEAST_RUN = 61
#: Bytes of text encoded at a time, and of the texts whose ids a task sorts.
SLICE, SHARD_BYTES = 2_000_000, 32_000_000


_small: list[np.ndarray] = []


def _narrowest() -> np.ndarray:
    """The narrowest selector of every id below 65536."""
    if not _small:
        _small.append(np.searchsorted(1 << WIDTHS[:-1].astype(np.int64), np.arange(1 << 16), side="right").astype(np.int8))
    return _small[0]


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of the coded ids, and the offsets (pairs word, ids before) of every STEP-th id."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros((0, 2), np.uint32)
    big = (ids >> np.uint64(60)) > 0
    # for each id the narrowest selector that holds it; then the greatest count whose next ids all fit
    if ids.max() < 1 << 16:
        bits = _narrowest()[ids]
    else:
        bits = np.full(n, 99, np.int8)
        for s in range(len(WIDTHS) - 1, -1, -1):
            bits[(ids >> np.uint64(WIDTHS[s])) == 0] = s
    best = np.full(n, len(WIDTHS) - 1, np.int8)
    done = big.copy()
    high = bits.copy()
    span = {1: high}
    width = 1
    while width * 2 <= 60:  # span[w][i]: the widest selector among ids i .. i + w - 1
        prior = span[width]
        wider = prior.copy()
        wider[:-width] = np.maximum(prior[:-width], prior[width:]) if n > width else wider[:-width]
        span[width * 2] = wider
        width *= 2
    for s, count in enumerate(COUNTS):
        if count > n:
            continue
        w = 1 << (int(count).bit_length() - 1)
        level = span[w]
        if level.min() > s:
            continue
        last = n - count
        widest = np.maximum(level[: last + 1], level[count - w : count - w + last + 1])
        fits = np.zeros(n, bool)
        fits[: last + 1] = widest <= s
        take = fits & ~done
        best[take] = s
        done |= take
    counts = COUNTS[best]
    # runs of zeros worth a word of their own
    zero = ids == 0
    run = np.zeros(n, np.int64)
    if zero.any():
        edge = np.flatnonzero(np.diff(np.concatenate([[0], zero.view(np.int8), [0]])))
        starts, ends = edge[::2], edge[1::2]
        at = np.flatnonzero(zero)
        run[at] = np.repeat(ends, ends - starts) - at
    long_run = run >= LEAST_RUN
    step = np.where(long_run, run, counts)
    hop = step.tolist()
    at, i = [], 0
    push = at.append
    while i < n:
        push(i)
        i += hop[i]
    first = np.array(at)
    sel = best[first].astype(np.int64)
    esc, zrun = big[first], long_run[first]
    size = 1 + esc.astype(np.int64)
    place = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    plain = ~esc & ~zrun
    for s in range(len(WIDTHS)):
        mine = np.flatnonzero(plain & (sel == s))
        if not len(mine):
            continue
        begin, count = first[mine], int(COUNTS[s])
        value = np.full(len(mine), np.uint64((s + 1) << 60), np.uint64)
        for j in range(count):
            value |= ids[begin + j] << np.uint64(j * WIDTHS[s])
        words[place[mine]] = value
    words[place[zrun]] = run[first[zrun]].astype(np.uint64)
    words[place[esc]] = np.uint64(ESCAPE << 60)
    words[place[esc] + 1] = ids[first[esc]]
    marks = np.arange(0, n, STEP)
    holder = np.searchsorted(first, marks, side="right") - 1
    return words, np.stack([place[holder], first[holder]], 1).astype(np.uint32)


def decode(words: np.ndarray) -> np.ndarray:
    """All ids of coded words, without a loop over them (but one over escapes that follow escapes)."""
    words = np.ascontiguousarray(words, np.uint64)
    if not len(words):
        return np.zeros(0, np.uint64)
    sel = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    for i in np.flatnonzero(sel == ESCAPE):
        if not raw[i] and i + 1 < len(words):
            raw[i + 1] = True
    counts = np.zeros(len(words), np.int64)
    packed = ~raw & (sel > 0) & (sel < ESCAPE)
    counts[packed] = COUNTS[sel[packed] - 1]
    runs = ~raw & (sel == ZERO_RUN)
    counts[runs] = (words[runs] & np.uint64((1 << 60) - 1)).astype(np.int64)
    counts[raw] = 1
    start = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for s in range(len(WIDTHS)):
        mine = np.flatnonzero(packed & (sel == s + 1))
        mask = np.uint64((1 << int(WIDTHS[s])) - 1)
        for j in range(int(COUNTS[s]) if len(mine) else 0):
            out[start[mine] + j] = (words[mine] >> np.uint64(j * WIDTHS[s])) & mask
    out[start[raw]] = words[raw]
    return out


def decode_range(words: np.ndarray, offsets: np.ndarray, begin: int, end: int) -> np.ndarray:
    """Ids begin .. end - 1 of a block, from the nearest offset."""
    word, before = (int(x) for x in offsets[begin // STEP])
    last = -(-end // STEP)
    # words up to the one after the next offset hold all ids wanted
    stop = int(offsets[last][0]) + 2 if last < len(offsets) else len(words)
    return decode(words[word:stop])[begin - before : end - before]


_encoders: dict[str, Encoder] = {}
#: Signs that end a stretch and form a token run of their own behind a word.
TAILS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
WORD = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$"


class Encoder:
    """Token ids of texts by the tokenizers library.

    White space only separates for these tokenizers, so a text's ids are those of its stretches between ASCII white space,
    one after the other. A batch's distinct stretches are found by Arrow and each is encoded once. Most are a word of Latin
    letters and some signs behind it; for these tokenizers the two are encoded apart, and case does not count, so such
    words are looked up in lower case without their signs. What was encoded is remembered, in two generations of ``most`` words:
    what is met again moves to the young one, and when that is full the old one is forgotten.

    The constructor looks for these properties (normalizer, pre-tokenizer, word ends) in the tokenizer's own description; a tokenizer
    without them gets whole texts.
    """

    def __init__(self, path: str, most: int = 150_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.most = most
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        vocabulary = self.tok.get_vocab()
        self.wide = max(vocabulary.values(), default=0) >= 1 << 16
        self.apart = _words_apart(self.tok)
        # words alone need neither the normalizer nor the expressions of the whole tokenizer
        self.plain = Tokenizer(self.tok.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.last = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _one_by_one(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint32).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of lower-case words of Latin letters: encoded in one go, cut at the tokens that end a word."""
        ids = np.array(self.plain.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(words) or (len(ids) and ends[-1] != len(ids)):
            return self._one_by_one(words)
        raw, at = ids.tobytes(), [0, *(4 * ends).tolist()]
        return [raw[a:b] for a, b in zip(at, at[1:])]

    def _known(self, pieces: list[str], encode) -> list[bytes]:
        found = list(map(self.young.get, pieces))
        lack = [i for i, v in enumerate(found) if v is None]
        fresh = []
        for i in lack:
            value = self.old.get(pieces[i])
            if value is None:
                fresh.append(i)
            else:
                found[i] = self.young[pieces[i]] = value
        for a in range(0, len(fresh), 20_000):
            part = fresh[a : a + 20_000]
            for i, value in zip(part, encode([pieces[i] for i in part])):
                found[i] = self.young[pieces[i]] = value
        return found

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """uint32 ids of all texts, end to end, and the bounds of each text's ids."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self.apart:
            coded = self._one_by_one(texts.to_pylist())
            return np.frombuffer(b"".join(coded), np.uint32), np.concatenate([[0], np.cumsum([len(c) // 4 for c in coded])]).astype(np.int64)
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        # leading and trailing white space gives empty stretches, which have no ids
        stretches = pc.ascii_split_whitespace(texts)
        words = np.asarray(stretches.offsets) - stretches.offsets[0].as_py()
        coded = stretches.flatten().dictionary_encode()
        index, whole = np.asarray(coded.indices), coded.dictionary
        stem = pc.ascii_rtrim(whole, TAILS)
        is_word = pc.match_substring_regex(stem, WORD)
        stems = pc.utf8_lower(stem.filter(is_word)).dictionary_encode()
        tails = _behind(whole.filter(is_word), stem.filter(is_word)).dictionary_encode()
        rest = whole.filter(pc.invert(is_word))
        pieces = [*self._known(stems.dictionary.to_pylist(), self._words), *self._known(tails.dictionary.to_pylist(), self._one_by_one), *self._known(rest.to_pylist(), self._one_by_one)]
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
        flat = np.frombuffer(b"".join(pieces), np.uint32)
        starts = np.cumsum(sizes) - sizes
        # each distinct stretch is one piece, or a word and the signs behind it
        n, n_stems, n_tails = len(whole), len(stems.dictionary), len(tails.dictionary)
        first, second = np.zeros(n, np.int64), np.full(n, -1, np.int64)
        mask = np.asarray(is_word)
        first[mask], second[mask] = np.asarray(stems.indices), n_stems + np.asarray(tails.indices)
        first[~mask] = n_stems + n_tails + np.arange(len(rest))
        both = np.stack([first, second], 1).ravel()
        both = both[both >= 0]
        entry = sizes[first] + np.where(second >= 0, sizes[second], 0)
        flat = flat[_runs(starts[both], sizes[both])]
        entry_start = np.cumsum(entry) - entry
        lengths = entry[index]
        bounds = np.concatenate([[0], np.cumsum(lengths)])[words]
        return flat[_runs(entry_start[index], lengths)], bounds


def _behind(whole: pa.Array, stem: pa.Array) -> pa.Array:
    """What follows each stem, a prefix in bytes of its stretch."""
    w, s = (np.frombuffer(x.cast(pa.large_binary()).buffers()[1], np.int64)[x.offset : x.offset + len(x) + 1] for x in (whole, stem))
    size = np.diff(w) - np.diff(s)
    data = whole.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    out = raw[_runs(w[1:] - size, size)]
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start .. start + size - 1 of each run, end to end."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _words_apart(tok) -> bool:
    """Whether white space only separates, case does not count, and letters, digits and signs are encoded apart."""
    import json

    told = json.loads(tok.to_str())
    steps = ((told.get("normalizer") or {}).get("normalizers")) or []
    splits = ((told.get("pre_tokenizer") or {}).get("pretokenizers")) or []
    kinds = [s["type"] for s in steps], [s["type"] for s in splits]
    if kinds != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]):
        return False
    split, level = splits
    own = split["pattern"].get("Regex", "").split("|")
    known = {"'s", "'t", "'re", "'ve", "'m", "'ll", "'d", r"[\p{L}]+", r"[\p{N}]", r"[^\s\p{L}\p{N}]+"}
    parts = split["invert"] and split["behavior"] == "Removed" and set(own) == known and not level["use_regex"] and not level["add_prefix_space"]
    blank = steps[1]["pattern"] == {"Regex": r"\s+"} and steps[1]["content"] == " "
    return parts and blank and told["model"].get("end_of_word_suffix") == "</w>" and not any(t["lstrip"] or t["rstrip"] or t["normalized"] for t in told["added_tokens"])


def encoder(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _tokens_task(path: str, end_id: int, bounds, parts):
    """Shard, id and ids of each document; ids are little-endian, of 16 bits if the tokenizer's all fit."""

    def task(batches):
        enc = encoder(path)
        kind, width = ("<u4", 4) if enc.wide or end_id >= 1 << 16 else ("<u2", 2)
        limits, dealt, first = bounds.value, *parts.value
        for batch in batches:
            text, doc_id, key = (batch.column(c) for c in ("text", "doc_id", "key"))
            shard = np.searchsorted(limits, np.asarray(pc.fill_null(doc_id, -(1 << 63))))
            shard = (first[shard] + np.asarray(key).view(np.uint64) % dealt[shard].astype(np.uint64)).astype(np.int32)
            for a, b in slices(text, SLICE):
                ids, at = enc(text.slice(a, b - a))
                out = np.full(len(ids) + b - a, end_id, np.uint32)
                out[np.arange(len(ids)) + np.repeat(np.arange(b - a), np.diff(at))] = ids
                ends = np.concatenate([[0], at[1:] + np.arange(1, b - a + 1)]) * width
                coded = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(out.astype(kind))])
                yield pa.record_batch({"shard": pa.array(shard[a:b]), "doc_id": doc_id.slice(a, b - a), "ids": coded.cast(pa.binary())})

    return trimmed(task)


_BLOCK = "shard int, block int, doc_ids array<bigint>, lengths array<bigint>, n_ids long, words binary, offsets binary, crc32 long"


def _write_task(kind: str):
    return trimmed(lambda batches: _write_blocks(batches, kind))


def _write_blocks(batches, kind: str):
    shard, block, ids, docs, n = None, 0, [], [], 0

    def out():
        flat = np.concatenate(ids).astype(np.uint64)
        words, offsets = encode(flat)
        return pa.record_batch(
            {
                "shard": pa.array([shard], pa.int32()),
                "block": pa.array([block], pa.int32()),
                "doc_ids": pa.array([docs], pa.list_(pa.int64())),
                "lengths": pa.array([[len(x) for x in ids]], pa.list_(pa.int64())),
                "n_ids": pa.array([len(flat)], pa.int64()),
                "words": pa.array([words.astype("<u8").tobytes()], pa.binary()),
                "offsets": pa.array([offsets.astype("<u4").tobytes()], pa.binary()),
                "crc32": pa.array([zlib.crc32(flat.astype("<u4").tobytes())], pa.int64()),
            }
        )

    for batch in batches:
        for s, d, v in zip(batch.column("shard").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
            if ids and (s != shard or n >= BLOCK_IDS):
                yield out()
                block = block + 1 if s == shard else 0
                ids, docs, n = [], [], 0
            shard = s
            ids.append(np.frombuffer(v, kind))
            docs.append(d)
            n += len(ids[-1])
    if ids:
        yield out()


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> None:
    """Tokenise ``docs`` and write the store; a task sorts the ids of about ``shard_bytes`` bytes of texts."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_of(docs, text).alias("text"))
    rows = rows.withColumn("key", F.xxhash64("text"))
    bounded_batches(spark)
    bounds, parts = _shards(rows, shard_bytes)
    share = spark.sparkContext.broadcast
    first = np.concatenate([[0], np.cumsum(parts)])
    enc = encoder(tokenizer)
    kind = "<u4" if enc.wide or end_id >= 1 << 16 else "<u2"
    told = [share(bounds), share((parts, first[:-1]))]
    found = rows.mapInArrow(_tokens_task(tokenizer, end_id, *told), "shard int, doc_id long, ids binary")
    dealt = found.repartitionById(int(first[-1]), "shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "ids")
    dealt.mapInArrow(_write_task(kind), _BLOCK).write.parquet(path)
    for b in told:
        b.destroy()


def _shards(rows: DataFrame, shard_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """Upper bounds of the ids of all shards but the last, and into how many parts each shard is dealt.

    The bounds are quantiles of doc_id over all rows, eight for each shard wanted, of which those are kept that end about
    ``shard_bytes`` of text; only sizes are read. A shard of one id alone is dealt by hash of the text if it is larger.
    """
    size = rows.select("doc_id", (F.octet_length("text") + 16).alias("b"))
    n, total = size.agg(F.count("*"), F.sum("b")).collect()[0]
    wanted = min(n, 8 * (-(-(total or 0) // shard_bytes)))
    if wanted <= 1:
        return np.zeros(0, np.int64), np.ones(1, np.int64)
    cuts = size.agg(F.percentile_approx("doc_id", [i / wanted for i in range(1, wanted)], max(10_000, 10 * wanted))).collect()[0][0]
    cuts = np.unique(np.array([-(1 << 63), *(cuts or [])], np.int64))  # null ids come first, as a span of their own
    spans = rows.sparkSession.sparkContext.broadcast(cuts)

    @F.pandas_udf("int")
    def span(i: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(spans.value, i.fillna(-(1 << 63)).to_numpy(np.int64)))

    found = size.groupBy(span("doc_id").alias("s")).agg(
        F.sum("b").alias("b"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n"), F.count("doc_id").alias("with_id")
    )
    held = {r["s"]: r for r in found.collect()}  # eight rows a shard at most
    spans.destroy()
    bounds, parts, rows_in, bytes_in = [], [], 0, 0
    for s in sorted(held):
        r = held[s]
        alone = r["with_id"] == 0 or r["with_id"] == r["n"] and r["low"] == r["high"]
        large = alone and r["b"] > shard_bytes
        if rows_in and (large or bytes_in + r["b"] > shard_bytes):
            bounds.append(cuts[s - 1])
            parts.append(1)
            rows_in = bytes_in = 0
        if large:
            parts.append(-(-r["b"] // shard_bytes))
            if s == len(cuts):
                break
            bounds.append(cuts[s])
        else:
            rows_in, bytes_in = rows_in + r["n"], bytes_in + r["b"]
    if len(parts) == len(bounds):
        parts.append(1)
    return np.array(bounds, np.int64), np.array(parts, np.int64)


def _read_task(with_ids: bool):
    return trimmed(lambda batches: _read_blocks(batches, with_ids))


def _read_blocks(batches, with_ids: bool):
    for batch in batches:
        for r in batch.to_pylist():
            ids = decode(np.frombuffer(r["words"], "<u8")).astype("<u4")
            if len(ids) != r["n_ids"] or zlib.crc32(ids.tobytes()) != r["crc32"]:
                raise ValueError(f"damaged block {r['shard']}/{r['block']}")
            ends = np.cumsum(np.array(r["lengths"], np.int64))
            starts = ends - np.array(r["lengths"], np.int64)
            cols = {
                "shard": pa.array(np.full(len(ends), r["shard"], np.int32)),
                "block": pa.array(np.full(len(ends), r["block"], np.int32)),
                "doc_id": pa.array(r["doc_ids"], pa.int64()),
                "at": pa.array(starts),
                "n_tokens": pa.array(ends - starts),
                "ids_crc32": pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends)], pa.int64()),
            }
            if with_ids:
                cols["ids"] = pa.array([ids[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary())
            yield pa.record_batch(cols)


def read_store(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every stored document; ``ids`` are little-endian unsigned 32-bit
    integers, decoded in any case and left out of the result on demand."""
    blocks = spark.read.parquet(path)
    size = blocks.groupBy("shard", "block").agg(F.sum("n_ids").alias("n"))
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    per_shard = size.groupBy("shard").agg(F.sum("n").alias("n"))
    over = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    first = per_shard.select("shard", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("first"))
    at = size.select("shard", "block", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("before")).join(first, "shard")
    schema = "shard int, block int, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    docs = blocks.mapInArrow(_read_task(with_ids), schema)
    return docs.join(at, ["shard", "block"]).select("doc_id", (F.col("first") + F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def store_digest(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Write a store in the shared folder, read it back: (doc_id, start, n_tokens, ids_crc32)."""
    import uuid

    spark = docs.sparkSession
    path = f"{shared_root(spark)}/quillstone/tokens-{uuid.uuid4().hex}"
    write_store(docs, path, tokenizer, end_id)
    return read_store(spark, path, with_ids=False)
