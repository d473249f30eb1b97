"""Cross-tokenizer alignment: which token of one vocabulary ends where one of another does, and how often across all documents.

Both tokenizers see a space and the text. Byte offsets where tokens of both end cut them into groups; a link is a pair of tokens that end
at the same offset. A pair's count is the number of its links in all documents, and a link is best if no other pair of its B id has
a greater count.

1. Encoding. A text is cut into chunks before each single space between visible signs; both tokenizers begin a token there, whatever
   stands around it (:class:`PairEncoder` looks for the properties of the two that this needs). Each distinct chunk of a batch is encoded once,
   with its groups and links. A slice of the documents gives one row of its documents and, for each B id, one row of postings:
   the A ids, documents and multiplicities of its links, as packed arrays. They are written once, as a table.
2. Counts. Multiplicities are summed by task, then by pair, and gathered by B id, of which there are as many as the vocabulary has.
3. Postings cogroup. Postings are shuffled by B id and sorted, the counts of a B id ahead of its postings; a task reads this as a
   stream, holds the counts of one B id at a time, and emits what each document of a slice gains, summed over what it has
   read. Spark spills the sort. A B id of many postings is dealt into parts by slice, each of which gets the counts.
4. Sum by document. The gains of a slice meet its documents, again as a sorted stream.

Defined cases: null and empty texts have no tokens, nor have texts whose tokens' bytes are not those of a space and the text (a text that
holds U+2581, as one tokenizer cannot tell it from a space): their numbers are 0 and their checksum is ''; special-token strings are plain
text; null and repeated ids and repeated rows stay as they are; an empty table gives an empty result; other columns are not kept.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta
from .common import bounded_batches, materialize, text_of, trimmed

#: Bytes of texts that make one slice; a slice has at most as many documents as 16 bits can number.
SLICE = 4_000_000
#: Links of a B id, beyond which its postings are dealt into parts, and gains that a task sums before it emits them.
PART_LINKS, MOST_GAINS = 2_000_000, 1_000_000
_MARK = "▁".encode()


def _byte_alphabet() -> dict[str, int]:
    """The sign that a byte-level vocabulary writes for each byte: visible Latin-1 signs stand for themselves."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(rest)}


def _edges() -> tuple[np.ndarray, np.ndarray]:
    """Bytes that may stand before a cut, and behind its space, for sure no white space nor part of it."""
    before, behind = np.zeros(256, bool), np.zeros(256, bool)
    before[33:127] = behind[33:127] = True
    # first bytes of signs that are white space for some tokenizer: C2, E1, E2, E3
    behind[0xC3:0xE1] = behind[0xE4:0xF5] = True
    return before, behind


_BEFORE, _BEHIND = _edges()


def _cuts(raw: np.ndarray) -> np.ndarray:
    """Places of spaces at which a chunk may begin."""
    at = np.flatnonzero(raw == 32)
    at = at[(at > 1) & (at < len(raw) - 1)]
    two = (raw[at - 1] >= 0x80) & (raw[at - 1] < 0xC0) & (raw[at - 2] >= 0xC3) & (raw[at - 2] < 0xE0)
    return at[(_BEFORE[raw[at - 1]] | two) & _BEHIND[raw[at + 1]]]


class PairEncoder:
    """Tokens of texts by a byte-level tokenizer (A) and a piece tokenizer (B), chunk by chunk, with groups and links.

    What was encoded is remembered in two generations of ``most`` chunks: what is met again moves to the young one, and when that is
    full the old one is forgotten.
    """

    def __init__(self, a_path: str, b_path: str, most: int = 300_000):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.no_truncation()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters, words = _byte_alphabet(), self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(words.values()) + 1)
        for token, i in words.items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        pieces = [(i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in pieces]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.cut = self._can_cut([p for _, p in pieces])
        self.most = most
        self.young: dict[bytes, tuple] = {}
        self.old: dict[bytes, tuple] = {}

    def _can_cut(self, pieces: list[str]) -> bool:
        """Whether A splits before a single space by its expression, and no piece of B has a space behind another sign."""
        told = json.loads(self.a.to_str())
        level = told.get("pre_tokenizer") or {}
        plain = told.get("normalizer") is None and level.get("type") == "ByteLevel" and level.get("use_regex") and not level.get("add_prefix_space")
        return bool(plain) and self._spelled(self.b.encode("x y")) == b" x y" and not any("▁" in p.lstrip("▁") for p in pieces)

    def _spelled(self, ids_b: list[int]) -> bytes:
        return b"".join(map(self.b_bytes.__getitem__, ids_b))

    def _aligned(self, ids_a: list[int], ids_b: list[int], ends: np.ndarray) -> list[tuple] | None:
        """For chunks ending at ``ends`` in a stretch of bytes: (groups, links, numbers of A, B tokens and groups); None if a chunk ends inside a token."""
        a, b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        at_a, at_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        common, in_a, in_b = np.intersect1d(at_a, at_b, assume_unique=True, return_indices=True)
        stop = np.searchsorted(common, ends)
        if len(stop) and (stop[-1] >= len(common) or (common[stop] != ends).any()):
            return None
        told_a, told_b = list(map(str, ids_a)), list(map(str, ids_b))
        to_a, to_b = (in_a + 1).tolist(), (in_b + 1).tolist()
        groups, i, j = [], 0, 0
        for k, m in zip(to_a, to_b):
            one = told_a[i] if k == i + 1 else ",".join(told_a[i:k])
            groups.append(f"{one}|{told_b[j]}" if m == j + 1 else f"{one}|{','.join(told_b[j:m])}")
            i, j = k, m
        links = np.stack([b[in_b], a[in_a]], 1).astype(np.uint32)
        out, g = [], 0
        for h in (stop + 1).tolist():
            n_a, n_b = to_a[h - 1] - (to_a[g - 1] if g else 0), to_b[h - 1] - (to_b[g - 1] if g else 0)
            out.append((";".join(groups[g:h]), links[g:h].tobytes(), n_a, n_b, h - g))
            g = h
        return out

    def _encode(self, text: bytes, ends: list[int]) -> list[tuple] | None:
        """Chunks of a stretch that begins with a space; None if they do not align or the bytes are not those of the text."""
        whole = text.decode()
        ids_a = self.a.encode(whole, add_special_tokens=False).ids
        ids_b = self.b.encode(whole[1:])
        if b"".join(map(self.a_bytes.__getitem__, ids_a)) != text or self._spelled(ids_b) != text:
            return None
        return self._aligned(ids_a, ids_b, np.array(ends, np.int64))

    def _fresh(self, chunks: list[bytes]) -> list[tuple | None]:
        """Chunks met for the first time. Those with plain edges are encoded end to end; the others, and stretches in doubt, one by one."""
        out: list[tuple | None] = [None] * len(chunks)
        behind, before = _BEHIND.tolist(), _BEFORE.tolist()
        two = lambda c: 0x80 <= c[-1] < 0xC0 and 0xC3 <= c[-2] < 0xE0
        plain = [i for i, c in enumerate(chunks) if len(c) > 1 and behind[c[1]] and (before[c[-1]] or two(c)) and _MARK not in c]
        single = set(range(len(chunks))) - set(plain)
        for s in range(0, len(plain), 2000):
            part = plain[s : s + 2000]
            ends = np.cumsum([len(chunks[i]) for i in part]).tolist()
            found = self._encode(b"".join(chunks[i] for i in part), ends)
            if found is None:
                single.update(part)
            else:
                for i, value in zip(part, found):
                    out[i] = value
        for i in single:
            found = self._encode(chunks[i], [len(chunks[i])])
            out[i] = found[0] if found else None
        return out

    def known(self, chunks: list[bytes]) -> list[tuple | None]:
        """What is known of distinct chunks; None for those whose tokens' bytes are not theirs."""
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        missing = object()
        found = [self.young.get(c, missing) for c in chunks]
        lack = []
        for i, v in enumerate(found):
            if v is missing:
                v = self.old.get(chunks[i], missing)
                if v is missing:
                    lack.append(i)
                else:
                    found[i] = self.young[chunks[i]] = v
        for i, value in zip(lack, self._fresh([chunks[i] for i in lack])):
            found[i] = self.young[chunks[i]] = value
        return found

    def __call__(self, texts: pa.Array) -> tuple[list[dict], np.ndarray, np.ndarray]:
        """A record of each text, all links as (B << 32 | A), and for each link the number of its text."""
        nothing, space = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
        spaced = pc.binary_join_element_wise(space, pc.fill_null(texts.cast(pa.large_string()), ""), nothing)
        raw, bounds = ta.flat_bytes(spaced)
        begins = np.zeros(len(raw), bool)
        begins[bounds[:-1]] = True
        if self.cut:
            begins[_cuts(raw)] = True
        starts = np.flatnonzero(begins)
        offsets = np.append(starts, len(raw)).astype(np.int64)
        column = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))])
        coded = column.dictionary_encode()
        found = self.known(coded.dictionary.to_pylist())
        good = np.array([v is not None for v in found], bool)
        found = [v or ("", b"", 0, 0, 0) for v in found]
        index, first = np.asarray(coded.indices).astype(np.int64), np.searchsorted(starts, bounds)
        numbers = np.array([v[2:] for v in found], np.int64).reshape(-1, 3)
        full = (np.diff(bounds) > 1) & (ta.per_text(~good[index], first) == 0)
        per = np.stack([ta.per_text(numbers[index, k], first) for k in range(3)], 1) * full[:, None]
        told, at = list(map([v[0] for v in found].__getitem__, index.tolist())), first.tolist()
        sums = [hashlib.sha256(";".join(told[a:b]).encode()).hexdigest() if f else "" for a, b, f in zip(at, at[1:], full.tolist())]
        records = [{"n_a": a, "n_b": b, "n_groups": g, "n_links": g, "groups_sha256": s} for (a, b, g), s in zip(per.tolist(), sums)]
        flat = np.frombuffer(b"".join(v[1] for v in found), np.uint32).reshape(-1, 2).astype(np.int64)
        size = numbers[:, 2]
        owner = ta.owners(first)
        index, owner = index[full[owner]], owner[full[owner]]
        begin, n = (np.cumsum(size) - size)[index], size[index]
        ends = np.cumsum(n)
        link = np.repeat(begin - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
        return records, (flat[:, 0] << 32 | flat[:, 1])[link], np.repeat(owner, n)


_encoders: dict[tuple[str, str], PairEncoder] = {}


def encoder(a_path: str, b_path: str) -> PairEncoder:
    """The process's encoder of the two tokenizers."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if (a_path, b_path) not in _encoders:
        _encoders[a_path, b_path] = PairEncoder(a_path, b_path)
    return _encoders[a_path, b_path]


_RECORD = pa.struct([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string())])
_TABLE = "slice long, b int, a binary, doc binary, times binary, docs array<struct<doc_id:bigint,n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,groups_sha256:string>>"


def _stretches(flat: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """A binary value for each stretch of an array."""
    return pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * flat.itemsize).astype(np.int64)), pa.py_buffer(flat)]).cast(pa.binary())


def _runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Bounds of runs of equal keys."""
    return np.concatenate([np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1])), [len(sorted_keys)]]) if len(sorted_keys) else np.zeros(1, np.int64)


def _postings(link: np.ndarray, owner: np.ndarray) -> pa.RecordBatch:
    """Rows (b, a, doc, times) of one slice."""
    order = np.lexsort((owner, link))
    link, owner = link[order], owner[order]
    new = np.append(True, (link[1:] != link[:-1]) | (owner[1:] != owner[:-1])) if len(link) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(link)))
    link, owner = link[first], owner[first]
    b = link >> 32
    cuts = _runs(b)
    width = np.min_scalar_type(int(times.max())) if len(times) else np.uint8
    columns = [_stretches((link & 0xFFFFFFFF).astype("<u4"), cuts), _stretches(owner.astype("<u2"), cuts), _stretches(times.astype(width), cuts)]
    return pa.RecordBatch.from_arrays([pa.array(b[cuts[:-1]].astype(np.int32)), *columns], ["b", "a", "doc", "times"])


def _align_task(a_path: str, b_path: str):
    def task(batches):
        from pyspark import TaskContext

        enc, number = encoder(a_path, b_path), TaskContext.get().partitionId() << 32
        for batch in batches:
            text, ids = batch.column("text"), batch.column("doc_id")
            for a, b in ta.slices(text, SLICE):
                records, link, owner = enc(text.slice(a, b - a))
                docs = [r | {"doc_id": i} for r, i in zip(records, ids.slice(a, b - a).to_pylist())]
                none = pa.nulls(1, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.nulls(1, pa.int32()), none, none, none, pa.array([docs], pa.list_(_RECORD))], _names)
                posts = _postings(link, owner)
                n = len(posts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, number)), *posts.columns, pa.nulls(n, pa.list_(_RECORD))], _names)
                number += 1

    return trimmed(task)


_names = ["slice", "b", "a", "doc", "times", "docs"]


def _summed(keys: list[np.ndarray], *values: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of the values of each."""
    key = np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[first], *(np.add.reduceat(np.concatenate(v)[order], first) for v in values)


def _times(raw: bytes, n: int) -> np.ndarray:
    """Multiplicities of ``n`` postings, written in as many bytes each as they need."""
    return np.frombuffer(raw, f"<u{len(raw) // n}").astype(np.int64)


def _count_task(most: int):
    """(b, a, n): links of each pair, summed over what a task has read, ``most`` pairs at a time."""

    def rows(key, n):
        return pa.RecordBatch.from_arrays([pa.array((key >> 32).astype(np.int32)), pa.array((key & 0xFFFFFFFF).astype(np.int32)), pa.array(n)], ["b", "a", "n"])

    def task(batches):
        keys, times, held = [], [], 0
        for batch in batches:
            for b, a, t in zip(batch.column("b").to_pylist(), batch.column("a").to_pylist(), batch.column("times").to_pylist()):
                a = np.frombuffer(a, "<u4").astype(np.int64)
                keys.append(a | b << 32)
                times.append(_times(t, len(a)))
                held += len(a)
            if held > most:
                key, n = _summed(keys, times)
                keys, times, held = [key], [n], len(key)
                if held > most // 2:
                    yield rows(key, n)
                    keys, times, held = [], [], 0
        if keys:
            yield rows(*_summed(keys, times))

    return trimmed(task)


def pair_counts(aligned: DataFrame, most: int = 4_000_000) -> DataFrame:
    """(b, a, n) of all pairs, a row a pair."""
    posts = aligned.filter("b IS NOT NULL").select("b", "a", "times")
    return posts.mapInArrow(_count_task(most), "b int, a int, n long").groupBy("b", "a").agg(F.sum("n").alias("n"))


def _gains_of(slices: list[int], keys: list[np.ndarray], best: list[np.ndarray], total: list[np.ndarray]):
    """Rows (slice, doc, best, total) of gains summed by document; keys are the slice's number in ``slices`` << 16 | document."""
    key, *sums = _summed(keys, best, total)
    cuts = _runs(key >> 16)
    columns = [_stretches((key & 0xFFFF).astype("<u2"), cuts), *(_stretches(s.astype("<i8"), cuts) for s in sums)]
    return pa.RecordBatch.from_arrays([pa.array([slices[k] for k in (key >> 16)[cuts[:-1]].tolist()], pa.int64()), *columns], ["slice", "doc", "best", "total"])


def _cogroup_task(most: int):
    """From a stream sorted by B id, counts ahead of postings: what the documents of slices gain."""

    def task(batches):
        a = n = top = None
        number: dict[int, int] = {}
        keys, best, total, held = [], [], [], 0
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("head", "pairs", "slice", "a", "doc", "times")]
            for head, pairs, s, ids, doc, times in zip(*cols):
                if head == 0:
                    a = np.array([p["a"] for p in pairs], np.int64)
                    n = np.array([p["n"] for p in pairs], np.int64)
                    top = n.max()
                    continue
                count = n[np.searchsorted(a, np.frombuffer(ids, "<u4"))]
                t = _times(times, len(count))
                keys.append(np.frombuffer(doc, "<u2").astype(np.int64) | number.setdefault(s, len(number)) << 16)
                best.append(t * (count == top))
                total.append(t * count)
                held += len(t)
            if held > most:
                yield _gains_of(list(number), keys, best, total)
                number, keys, best, total, held = {}, [], [], [], 0
        if keys:
            yield _gains_of(list(number), keys, best, total)

    return trimmed(task)


def _sum_task():
    """From a stream sorted by slice, documents ahead of gains: a row of each document."""

    def rows(docs, best, total):
        columns = {k: [d[k] for d in docs] for k in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
        arrays = {k: pa.array(v, pa.int64()) for k, v in columns.items()} | {"n_best": pa.array(best), "count_sum": pa.array(total)}
        return pa.record_batch(arrays | {"groups_sha256": pa.array([d["groups_sha256"] for d in docs], pa.string())})

    def task(batches):
        docs = best = total = None
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("head", "docs", "doc", "best", "total")]
            for head, records, doc, b, t in zip(*cols):
                if head == 0:
                    if docs is not None:
                        yield rows(docs, best, total)
                    docs, best, total = records, np.zeros(len(records), np.int64), np.zeros(len(records), np.int64)
                    continue
                at = np.frombuffer(doc, "<u2")  # distinct
                best[at] += np.frombuffer(b, "<i8")
                total[at] += np.frombuffer(t, "<i8")
        if docs is not None:
            yield rows(docs, best, total)

    return trimmed(task)


def align(docs: DataFrame, a_path: str, b_path: str, text: str = "text", id_col: str = "doc_id", part_links: int = PART_LINKS, most_gains: int = MOST_GAINS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_of(docs, text).alias("text"))
    aligned = materialize(rows.mapInArrow(_align_task(a_path, b_path), _TABLE), "aligned")
    counts = pair_counts(aligned).groupBy("b").agg(F.sort_array(F.collect_list(F.struct("a", "n"))).alias("pairs"), F.sum("n").alias("links"))
    counts = materialize(counts.withColumn("parts", F.ceil(F.col("links") / part_links).cast("int")), "pair-counts")
    # one row a B id of many links: fewer than the vocabulary has
    parts = counts.filter("parts > 1").select("b", "parts")
    posts = aligned.filter("b IS NOT NULL").join(F.broadcast(parts), "b", "left")
    posts = posts.select("b", F.pmod(F.xxhash64("slice"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"), F.lit(1).alias("head"), "slice", "a", "doc", "times")
    heads = counts.select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("head"), "pairs")
    both = posts.unionByName(heads, allowMissingColumns=True).repartition("b", "part").sortWithinPartitions("b", "part", "head", "slice")
    gains = both.mapInArrow(_cogroup_task(most_gains), "slice long, doc binary, best binary, total binary")
    records = aligned.filter("b IS NULL").select("slice", F.lit(0).alias("head"), "docs")
    met = gains.withColumn("head", F.lit(1)).unionByName(records, allowMissingColumns=True).repartition("slice").sortWithinPartitions("slice", "head")
    return met.mapInArrow(_sum_task(), "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
