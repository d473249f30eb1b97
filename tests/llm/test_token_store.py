"""Token store: ids equal to the library's for odd texts, shards by bytes, a hot id, what a filter does to the result."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from quillstone.llm import token_store

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "İ", "ß", "Å", "Å", "H̱", "é", "ﬁ", "Σ", "ΣΑΣ", "ͅ", "µ", "ª", "K", ";", " ", "\x1c", "\x85", "\xa0", "　", "‍", "😀", "中", "É", "ÿ", "×", "ſ",
    "'s", "'S", "'ll", "'Re", "!", "?!", "...", "$$$", "1", "23", "½", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "a", "B", "cd", "The", "\n", "\t", "\x0b", " ", " ", "\x00", "|", "가", "̧",
]


def test_ids_of_odd_texts_are_those_of_the_library():
    rng = random.Random(7)
    sign = lambda: rng.choice(ODD) if rng.random() < 0.8 else chr(rng.choice([rng.randrange(1, 0x250), rng.randrange(0x250, 0xD7FF), rng.randrange(0xE000, 0x1FFFF)]))
    coder = token_store.Encoder(PATH, most=300)
    assert coder.apart
    for _ in range(20):
        texts = ["".join(sign() for _ in range(rng.randrange(14))) for _ in range(1000)]
        ids, at = coder(pa.array(texts))
        for i, e in enumerate(coder.tok.encode_batch(texts, add_special_tokens=False)):
            assert ids[at[i] : at[i + 1]].tolist() == e.ids, texts[i]


def test_a_tokenizer_that_keeps_white_space_gets_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    coder, texts = token_store.Encoder(path), ["a  b\n c", None, " x", ""]
    ids, at = coder(pa.array(texts))
    assert not coder.apart and [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [coder.tok.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_shards_hold_about_equal_bytes_and_split_a_hot_id(spark, tmp_path):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["alpha", "Beta,", "gamma"]) for _ in range(rng.randrange(300))) for _ in range(400)]
    ids = [None if i % 4 == 0 else 77 if i % 4 == 1 else i for i in range(400)]
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    path = str(tmp_path / "store")
    token_store.write_store(docs, path, PATH, shard_bytes=20_000)
    rows = token_store.read_store(spark, path).collect()
    tok = Tokenizer.from_file(PATH)
    want = sorted((-1 if i is None else i, np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, t in zip(ids, texts))
    assert sorted((-1 if r.doc_id is None else r.doc_id, bytes(r.ids)) for r in rows) == want
    rows.sort(key=lambda r: r.start)
    place, order = 0, []
    for r in rows:
        assert r.start == place and r.ids_crc32 == zlib.crc32(bytes(r.ids)) and r.n_tokens == len(r.ids) // 4
        place += r.n_tokens
        order.append(-1 if r.doc_id is None else r.doc_id)
    assert order == sorted(order)
    held = spark.read.parquet(path).groupBy("shard").sum("n_ids").collect()
    assert len(held) >= 20 and max(r[1] for r in held) < 15_000
