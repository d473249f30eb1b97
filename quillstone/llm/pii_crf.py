"""PII: a linear-chain conditional random field over word-shape features, beside exact patterns.

Base spans come from patterns with checks (parts of an address, Luhn, numbers of digits). The field finds what the
patterns don't: telephone numbers without ``+``, spelled-out mail addresses, numbers broken in other ways. Its words are
stretches between white space; each is described by counts of digits, dots and hyphens, its first character, ``@``,
letters, whether its digits pass Luhn, and a small lexical class; the words before and after count too. It is trained by
gradient ascent on the likelihood of a small labelled table (:func:`labelled_sentences`), on the driver, and decoded by
Viterbi over many sequences at once. A constraint of the field: words with nothing of interest (digits, ``@``, ``+``,
``(``, a lexical class) in them or in a neighbour are ``O``, so only the runs of other words are decoded.
Found spans must pass the checks of their kind
and touch no base span.

Defined cases: a null text counts as empty: no spans; rows are judged one by one, so repeated rows and ids are judged
alike; of spans of one start, kinds come as listed; texts of any length are read whole; an empty table gives an
empty result; other columns pass through inside ``row``.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta
from .common import bounded_batches, text_of, trimmed

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *KINDS)

# --- base spans -------------------------------------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str):
    """Leftmost matches, from each ``@`` back over its local part; linear in the text."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) in order."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def spell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


# --- features ---------------------------------------------------------------------------------------------------

WORD_CLASSES = {
    1: "phone tel telephone call fax mobile cell dial telefon".split(),
    2: ["at"],
    3: ["dot"],
    4: "card visa mastercard credit karte carte tarjeta".split(),
    5: "ip host server address".split(),
    6: "version section figure page isbn order invoice build id number no ref total".split(),
    7: "com org net example mail".split(),
}
_CLASS_OF = sorted((int(ta.stretch_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w)]))[0]), c) for c, ws in WORD_CLASSES.items() for w in ws)
_CLASS_HASH, _CLASS_ID = np.array([h for h, _ in _CLASS_OF], np.uint64), np.array([c for _, c in _CLASS_OF], np.int8)
#: Attribute sizes: digits, dots, hyphens, first character, letters and @, Luhn, lexical class, digits with first character.
SIZES = (9, 5, 4, 7, 4, 2, 8, 63)
_DIGIT_BUCKET = np.array([0, 1, 2, 3, 4, *[5] * 5, *[6] * 4, *[7] * 6, 8])
_FIRST = np.full(256, 6, np.int8)
for _i, _chars in enumerate((b"+", b"(", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")):
    _FIRST[list(_chars)] = _i
_FIRST[128:] = 5
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
for _a, _b in ((65, 91), (97, 123), (128, 256)):
    _LETTER[_a:_b] = True


@dataclass
class Words:
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    attrs: np.ndarray  # (words, attributes)
    plain: np.ndarray


def describe(raw: np.ndarray, bounds: np.ndarray) -> Words:
    """Words between white space, their attributes, and which have nothing of interest."""
    starts, ends = ta.stretches(raw, bounds, ta.SPACE[raw])
    if not len(starts):
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(len(bounds), np.int64), np.zeros((0, len(SIZES)), np.int8), np.zeros(0, bool))

    def count(mask):
        sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int32)])
        return sums[ends] - sums[starts]

    digit = (raw >= 48) & (raw <= 57)
    n_digits, first = count(digit), _FIRST[raw[starts]]
    at_sign = count(raw == 64) > 0
    low = _LOWER[raw]
    a_starts, a_ends = ta.stretches(raw, bounds, ta.ALNUM[raw])
    i = np.minimum(np.searchsorted(a_starts, starts), max(len(a_starts) - 1, 0))
    word_class = np.zeros(len(starts), np.int8)
    if len(a_starts):
        short = np.flatnonzero((a_starts[i] < ends) & (a_ends[i] <= ends) & (a_ends[i] - a_starts[i] <= 10) & (n_digits == 0))
        h = ta.stretch_hashes(low, a_starts[i[short]], a_ends[i[short]])
        j = np.minimum(np.searchsorted(_CLASS_HASH, h), len(_CLASS_HASH) - 1)
        word_class[short] = np.where(_CLASS_HASH[j] == h, _CLASS_ID[j], 0)
    bucket = _DIGIT_BUCKET[np.minimum(n_digits, 20)]
    plain = (n_digits == 0) & ~at_sign & (word_class == 0) & (first > 1)
    attrs = np.zeros((len(starts), len(SIZES)), np.int8)
    some = np.flatnonzero(~plain)
    attrs[:, 0], attrs[:, 3], attrs[:, 6] = bucket, first, word_class
    attrs[:, 1] = np.minimum(count(raw == 46) - (raw[ends - 1] == 46), 4)
    attrs[:, 2] = np.minimum(count(raw == 45), 3)
    attrs[:, 4] = 2 * at_sign + (count(_LETTER[raw]) > 0)
    attrs[:, 7] = bucket * 7 + first
    for w in some[(n_digits[some] >= 14) & (n_digits[some] <= 19)]:
        part = raw[starts[w] : ends[w]]
        attrs[w, 5] = luhn(part[(part >= 48) & (part <= 57)].tobytes().decode())
    return Words(starts, ends, np.searchsorted(starts, bounds), attrs, plain)


# --- the field --------------------------------------------------------------------------------------------------


class Field:
    """Weights: for each of the words before, at and after, and each attribute value, one per label; transitions."""

    def __init__(self):
        self.offset = np.concatenate([[0], np.cumsum(SIZES)])
        n = int(self.offset[-1]) + 1  # the last stands for a text's edge
        self.w = np.zeros((3, n, len(LABELS)))
        self.t = np.zeros((len(LABELS), len(LABELS)))

    def rows(self, words: Words, which: np.ndarray, side: int) -> np.ndarray:
        """(words, attributes) weight rows of the neighbour at ``side``; beyond the text all are the edge row."""
        doc = np.searchsorted(words.bounds, which, side="right") - 1
        at = which + side
        inside = (at >= words.bounds[doc]) & (at < words.bounds[doc + 1])
        rows = words.attrs[np.where(inside, at, 0)].astype(np.int64) + self.offset[:-1]
        rows[~inside] = self.offset[-1]
        return rows

    def emissions(self, words: Words, which: np.ndarray) -> np.ndarray:
        return sum(self.w[side + 1][self.rows(words, which, side)].sum(1) for side in (-1, 0, 1))

    @staticmethod
    def open_words(words: Words) -> np.ndarray:
        """Words that may be anything but ``O``: with something of interest in them or in the word before or after."""
        near = ~words.plain
        near[1:] |= ~words.plain[:-1]
        near[:-1] |= ~words.plain[1:]
        return near

    def fit(self, sequences: list[tuple[Words, np.ndarray]], rounds: int = 200, rate: float = 0.08, ridge: float = 2e-4) -> None:
        """Adam on the mean log-likelihood; sequences are padded to one length."""
        n, longest, k = len(sequences), max(len(y) for _, y in sequences), len(LABELS)
        rows = np.full((3, n, longest, len(SIZES)), self.offset[-1])
        gold, mask = np.zeros((n, longest), int), np.zeros((n, longest), bool)
        for i, (words, y) in enumerate(sequences):
            for side in (-1, 0, 1):
                rows[side + 1, i, : len(y)] = self.rows(words, np.arange(len(y)), side)
            gold[i, : len(y)], mask[i, : len(y)] = y, True
        one = np.eye(k)[gold] * mask[..., None]
        pairs = (mask[:, 1:] & mask[:, :-1])[..., None, None]
        gold_t = (one[:, :-1, :, None] * one[:, 1:, None, :] * pairs).sum((0, 1))
        moments = [np.zeros_like(self.w), np.zeros_like(self.w), np.zeros_like(self.t), np.zeros_like(self.t)]
        for step in range(1, rounds + 1):
            e = sum(self.w[s][rows[s]].sum(2) for s in range(3))
            fwd, bwd = np.zeros((n, longest, k)), np.zeros((n, longest, k))
            fwd[:, 0] = e[:, 0]
            lse = lambda v, axis: (m := v.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(v - m).sum(axis))
            for i in range(1, longest):
                fwd[:, i] = np.where(mask[:, i, None], lse(fwd[:, i - 1, :, None] + self.t, 1) + e[:, i], fwd[:, i - 1])
            for i in range(longest - 2, -1, -1):
                go = mask[:, i + 1, None]
                bwd[:, i] = np.where(go, lse(self.t + (e[:, i + 1] + bwd[:, i + 1])[:, None, :], 2), bwd[:, i + 1])
            z = lse(fwd[:, -1], 1)
            marginal = np.exp(fwd + bwd - z[:, None, None]) * mask[..., None]
            both = np.exp(fwd[:, :-1, :, None] + self.t + (e[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None]) * pairs
            off = (one - marginal) / n
            gw = np.zeros_like(self.w)
            for s in range(3):
                np.add.at(gw[s], rows[s].reshape(-1), np.repeat(off.reshape(-1, k), len(SIZES), 0))
            for x, g, m, v in ((self.w, gw, *moments[:2]), (self.t, (gold_t - both.sum((0, 1))) / n, *moments[2:])):
                g = g - ridge * x
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                x += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def decode(self, words: Words) -> np.ndarray:
        """The best label of every word."""
        out = np.zeros(len(words.starts), np.int8)
        if not len(out):
            return out
        which = np.flatnonzero(self.open_words(words))
        if not len(which):
            return out
        doc = np.searchsorted(words.bounds, which, side="right") - 1
        new = np.ones(len(which), bool)
        new[1:] = (which[1:] != which[:-1] + 1) | (doc[1:] != doc[:-1])
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(which)))
        e = self.emissions(words, which)
        # beside a run stand certain O words, or the text's edge
        left_o = which[begin] > words.bounds[doc[begin]]
        last = begin + size - 1
        right_o = which[last] + 1 < words.bounds[doc[last] + 1]
        order = np.argsort(-size, kind="stable")  # longest first, so that the open runs are a prefix
        begin, size, left_o, right_o = begin[order], size[order], left_o[order], right_o[order]
        open_at = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")
        back = np.zeros((len(which), len(LABELS)), np.int8)
        score = e[begin] + np.where(left_o[:, None], self.t[0], 0)
        for i in range(1, size[0]):
            k = open_at[i]
            step = score[:k, :, None] + self.t
            at = begin[:k] + i
            back[at] = step.argmax(1)
            score[:k] = step.max(1) + e[at]
        label = (score + np.where(right_o[:, None], self.t[:, 0], 0)).argmax(1)
        for i in range(size[0] - 1, -1, -1):
            k = open_at[i]
            at = begin[:k] + i
            out[which[at]] = label[:k]
            if i:
                label[:k] = back[at, label[:k]]
        return out


def labelled_sentences(n: int = 420, seed: int = 3) -> list[tuple[str, list[str]]]:
    """The labelled table: sentences and a label for each of their words, from a few frames and drawn values."""
    rng = random.Random(seed)
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("aeioulnrstdmhg") for _ in range(rng.randrange(2, 9)))

    def card():
        d = rng.choice("3456") + num(rng.choice([13, 14, 14, 15]) - 1 + 1)
        return d + next(c for c in "0123456789" if luhn(d + c))

    def not_card():
        d = card()
        return d[:-1] + str((int(d[-1]) + rng.randrange(1, 10)) % 10)

    makers = {
        "phone": [
            lambda: f"({num(3)}) {num(3)}-{num(4)}", lambda: f"{num(3)}-{num(3)}-{num(4)}", lambda: f"+{num(1)} ({num(3)}) {num(3)}-{num(4)}", lambda: f"+{num(2)} {num(3)} {num(4)} {num(3)}", lambda: f"{num(3)} {num(3)} {num(4)}",
        ],
        "email": [
            lambda: f"{word()}@{word()}.com", lambda: f"{word()}.{word()}@{word()}.org", lambda: f"{word()} at {word()} dot com", lambda: f"{word()} (at) {word()} (dot) org", lambda: f"{word()} [at] {word()} [dot] net",
        ],
        "ip": [lambda: ".".join(str(rng.randrange(256)) for _ in range(4))],
        "card": [card, lambda: (lambda c: f"{c[:4]} {c[4:8]} {c[8:12]} {c[12:]}")(card())],
    }
    outside = [
        not_card, lambda: num(rng.randrange(1, 13)), lambda: f"{rng.randrange(1, 29)}.{rng.randrange(1, 13)}.20{num(2)}", lambda: f"20{num(2)}-{num(2)}-{num(2)}", lambda: f"{num(2)}:{num(2)}", lambda: f"v{num(1)}.{num(1)}.{num(1)}",
        lambda: f"{num(3)},{num(2)}", lambda: num(rng.randrange(20, 30)), lambda: f"{word()}-{word()}", lambda: word() + num(2), lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40)), lambda: f"at {word()}", lambda: f"({word()})", lambda: "+", lambda: f"version {num(1)}.{num(1)}", lambda: f"{word()} dot {word()}", lambda: f"page {num(2)}", lambda: f"call {word()}", lambda: f"{num(3)} {num(2)}", lambda: f"card {word()}",
    ]
    out = []
    for i in range(n):
        words, labels = [], []

        def put(text, label="O"):
            for w in text.split():
                words.append(w)
                labels.append(label)

        for _ in range(rng.randrange(0, 6)):
            w = word()
            put(rng.choice([w, w, w.capitalize(), w + ",", w + ".", w.upper(), "|", "é" + w, w + "$$$"]))
        if i % 2:
            kind = KINDS[rng.randrange(4)]
            if rng.random() < 0.5:
                put({"phone": "call", "email": "mail", "ip": "host", "card": "card"}[kind])
            put(rng.choice(makers[kind])() + rng.choice(["", "", ".", ","]), kind)
        else:
            put(rng.choice(outside)())
        for _ in range(rng.randrange(0, 6)):
            w = word()
            put(rng.choice([w, w, w.capitalize(), w + ",", w + "."]))
        if words:
            out.append((" ".join(words), labels))
    return out


_trained: list[Field] = []


def train(table: list[tuple[str, list[str]]] | None = None) -> Field:
    """A field fitted to the labelled table."""
    if table is None and _trained:
        return _trained[0]
    sequences = []
    for text, labels in table or labelled_sentences():
        raw = np.frombuffer(text.encode(), np.uint8)
        sequences.append((describe(raw, np.array([0, len(raw)])), np.array([LABELS.index(x) for x in labels])))
    out = Field()
    out.fit(sequences)
    if table is None:
        _trained.append(out)
    return out


_CHECKS = {
    0: lambda s: bool(re.fullmatch(r"[\w.%+-]+(?:@|\s*[(\[]?at[)\]]?\s*)[\w-]+(?:(?:\.|\s*[(\[]?dot[)\]]?\s*)[\w-]+)+", s, re.IGNORECASE)),
    1: lambda s: len(p := re.findall(r"[0-9]+", s)) == 4 and all(len(x) < 4 and int(x) <= 255 for x in p),
    2: lambda s: 14 <= len(d := _NOT_DIGIT.sub("", s)) <= 19 and luhn(d) and not re.search(r"[^\W0-9_]", s),
    3: lambda s: 10 <= len(_NOT_DIGIT.sub("", s)) <= 15 and not re.search(r"[^\W0-9_]", s) and bool(re.search(r"[-() .]", s)),
}


def added_spans(field: Field, raw: np.ndarray, bounds: np.ndarray, texts: list[str]) -> dict[int, list[tuple[int, int, int]]]:
    """text number -> spans (start, kind, end) in code points that the field finds and the checks let pass."""
    words = describe(raw, bounds)
    labels = field.decode(words)
    at = np.flatnonzero(labels)
    out: dict[int, list[tuple[int, int, int]]] = {}
    if not len(at):
        return out
    doc = np.searchsorted(words.bounds, at, side="right") - 1
    cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(labels[at]) != 0) | (np.diff(doc) != 0)) + 1
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    for part in np.split(np.arange(len(at)), cut):
        first, last, d = at[part[0]], at[part[-1]], int(doc[part[0]])
        a, b = (int(chars[x] - chars[bounds[d]]) for x in (words.starts[first], words.ends[last]))
        text, kind = texts[d], int(labels[first]) - 1
        while a < b and not (text[a].isalnum() or text[a] in "(+"):
            a += 1
        while a < b and not text[b - 1].isalnum():
            b -= 1
        if a < b and _CHECKS[kind](text[a:b]):
            out.setdefault(d, []).append((a, kind, b))
    return out


def free_of(base: list[tuple[int, int, int]], more: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Those of ``more`` that overlap no span of ``base``, both (start, kind, end) in order of start."""
    starts, reach, out = [s[0] for s in base], list(itertools.accumulate((s[2] for s in base), max)), []
    for s in more:
        before = bisect.bisect_left(starts, s[2])  # spans that begin before this one ends
        if not before or reach[before - 1] <= s[0]:
            out.append(s)
    return out


def _find_task(field):
    def task(batches):
        for batch in batches:
            column = batch.column("text")
            for a, b in ta.slices(column):
                part = column.slice(a, b - a)
                texts = part.to_pylist()
                more = added_spans(field.value, *ta.flat_bytes(part), texts)
                counts, shas, spans = [[] for _ in KINDS], [], []
                for i, text in enumerate(texts):
                    base = base_spans(text)
                    for k in range(len(KINDS)):
                        counts[k].append(sum(s[1] == k for s in base))
                    shas.append(hashlib.sha256(spell(base).encode()).hexdigest())
                    spans.append(spell(sorted(base + free_of(base, more.get(i, [])))))
                cols = {"row": batch.column("row").slice(a, b - a)} | {f"n_{k}": pa.array(c, pa.int64()) for k, c in zip(KINDS, counts)}
                cols |= {"base_sha256": pa.array(shas, pa.string()), "spans": pa.array(spans, pa.string())}
                yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return task


def find(docs: DataFrame, text: str = "text", keep: list[str] | None = None, field: Field | None = None) -> DataFrame:
    """``row`` (the columns in ``keep``; all if None), n_<kind> of base spans, base_sha256 and all ``spans``."""
    keep = docs.columns if keep is None else keep
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), text_of(docs, text).alias("text"))
    bounded_batches(docs.sparkSession)
    schema = rows.select("row").schema
    for k in KINDS:
        schema = schema.add(f"n_{k}", "long")
    schema = schema.add("base_sha256", "string").add("spans", "string")
    return rows.mapInArrow(trimmed(_find_task(docs.sparkSession.sparkContext.broadcast(field or train()))), schema)
