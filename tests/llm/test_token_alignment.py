"""Cross-tokenizer alignment against a brute-force version with the plain libraries."""

import collections
import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest

from quillstone.llm import queries, token_alignment

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    """Ids and bytes of both tokenizers' tokens, whole texts at a time."""
    import sentencepiece
    from tokenizers import Tokenizer, decoders

    a, b = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    a.encode_special_tokens = True
    level = decoders.ByteLevel()
    signs = {}
    for i in range(256):  # each sign of the byte alphabet, from single-byte tokens: ids 0 to 255
        signs[a.id_to_token(i)] = None
    visible = [c for c in signs if ord(c) < 256]
    hidden = sorted(c for c in signs if ord(c) >= 256)
    signs |= {c: ord(c) for c in visible} | dict(zip(hidden, sorted(set(range(256)) - set(map(ord, visible)))))
    assert level.decode(["Ġ", "x"]) == " x" and signs["Ġ"] == 32

    def spell(text):
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        pieces = [b.id_to_piece(i) for i in ids_b]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, pieces)]
        return ids_a, [bytes(signs[c] for c in a.id_to_token(i)) for i in ids_a], ids_b, bytes_b

    return spell


def brute(plain, texts):
    count, docs = collections.Counter(), []
    for t in texts:
        a, bytes_a, b, bytes_b = plain(t) if t else ([], [], [], [])
        whole = (" " + (t or "")).encode()
        if not t or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            docs.append((0, 0, 0, "", []))
            continue
        ends, at = {}, 0
        for i, x in enumerate(bytes_a):
            at += len(x)
            ends[at] = i
        groups, links, at, i0, j0 = [], [], 0, 0, 0
        for j, x in enumerate(bytes_b):
            at += len(x)
            if at in ends:
                i = ends[at]
                groups.append(",".join(map(str, a[i0 : i + 1])) + "|" + ",".join(map(str, b[j0 : j + 1])))
                links.append((a[i], b[j]))
                i0, j0 = i + 1, j + 1
        count.update(links)
        docs.append((len(a), len(b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest(), links))
    top = collections.Counter()
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    return [(na, nb, g, len(x), sum(count[p] == top[p[1]] for p in x), sum(count[p] for p in x), h) for na, nb, g, h, x in docs]


def odd_texts():
    rng = random.Random(8)
    signs = ["a", "the", "É", "é", " ", " ", " ", "  ", "\n", "\t", " ", "　", " ", " ", "\x1c", "\x00", "▁", "<s>", "<|endoftext|>", "</s>", "<0x41>", "'s", "12", "9", "中文", "語", "😀", "ß", ".", "...", "-", "Ж", "\u0085", "﻿", "\r"]
    fixed = [None, "", " ", "  ", " a", "a ", "  a  b  ", "a\n b", "a \nb", "x  y", "x  y", "x　 y", "▁", "a▁b", "<|endoftext|> <s> </s> <unk>", "é é é", "ñ" * 50, "word " * 3000, "a" * 5000, "don't 's x"]
    return fixed + ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 25))) for _ in range(1500)]


def test_equals_brute_force_on_odd_texts(spark, plain):
    texts = odd_texts()
    texts += texts[-20:]  # repeated rows
    docs = spark.createDataFrame([(i % 1500 or None, t, "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, slice string, b int").repartition(3)
    got = token_alignment.align(docs, A_PATH, B_PATH, part_links=50, most_gains=100)
    want = collections.Counter((i % 1500 or None, *w) for i, w in enumerate(brute(plain, texts)))
    assert collections.Counter(tuple(r) for r in got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()) == want
    assert sum(n for w, n in want.items() if w[1]) > 800 and sum(n for w, n in want.items() if not w[1]) > 3


def test_chunks_are_remembered_and_forgotten(plain):
    small, texts = token_alignment.PairEncoder(A_PATH, B_PATH, most=3), [t for t in odd_texts() if t][:300]
    records = [r for t in texts for r in small(pa.array([t]))[0]]
    assert small.cut and len(small.young) < 100
    assert [(r["n_a"], r["n_b"], r["groups_sha256"]) for r in records] == [(w[0], w[1], w[6]) for w in brute(plain, texts)]


def test_empty_table(spark):
    assert token_alignment.align(spark.createDataFrame([], "doc_id long, text string"), A_PATH, B_PATH).count() == 0


def test_query_on_given_documents(spark, plain):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[1:] for r in queries.op13_token_alignment(spark, folder).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()}
    assert got == {r.doc_id: w for r, w in zip(docs, brute(plain, [r.text for r in docs]))}
