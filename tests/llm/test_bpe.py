"""Byte-level BPE against the public tokenizer library."""

import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from llm_fixtures import docs_frame
from sigfolio.llm import bpe
from sigfolio.llm.queries import bpe_digests, tokenizer_file


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(tokenizer_file())


@pytest.fixture(scope="module")
def codec():
    with open(tokenizer_file(), "rb") as f:
        return bpe.TextCodec(f.read())


def odd_texts():
    rng = random.Random(4)
    letters = "abcdeilnorstuABC 0123.,'!?\n\t\r\x0b\x0c\x1c\x85  ​　éñßü中文😀́٣²Ⅷ_-<|>\x00"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(1500)]
    return texts + ["", " " * 300, "a" * 4000, "\n" * 70, "ab" * 400, "<|endoftext|>", "x<|endoftext|> y<|endoftext|>", "don't we'll I'VE", "<|endoftext"]


def test_ids_and_texts_match_the_library(codec, reference):
    texts = odd_texts()
    for text, packed in zip(texts, codec.encode_batch(texts)):
        want = reference.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(packed, "<u4").tolist() == want
        assert codec.decode(packed) == reference.decode(want, skip_special_tokens=False)


def test_ids_that_are_no_utf8_decode_like_the_library(codec, reference):
    rng = random.Random(9)
    for _ in range(300):
        ids = [rng.randrange(50257) for _ in range(rng.randint(1, 12))]
        assert codec.decode(np.array(ids, "<u4").tobytes()) == reference.decode(ids, skip_special_tokens=False)


def test_pairs_follow_as_merging_says(codec):
    trie, vocab, rng = codec.trie, codec.vocab, random.Random(1)
    short = [i for b, i in vocab.ids.items() if len(b) <= 2]
    for k in range(20_000):
        a, b = rng.choice(short), rng.choice(short if k % 2 else list(vocab.ids.values())[:5000])
        assert trie.follows(a, b) == (vocab.merge(vocab.bytes[a] + vocab.bytes[b]) == [a, b])


def test_small_tables_start_afresh_with_equal_results(codec):
    with open(tokenizer_file(), "rb") as f:
        small = bpe.TextCodec(f.read(), max_words=20)
    small.trie.max_pairs = 50
    texts = odd_texts()[:200]
    assert [small.encode_batch([t])[0] for t in texts] == codec.encode_batch(texts)


def test_long_texts_in_parts_give_equal_ids(codec):
    with open(tokenizer_file(), "rb") as f:
        other = bpe.TextCodec(f.read())
    other.part_chars = 40
    texts = odd_texts() + ["don't we'll  do a\tthing <|endoftext|> and\n\nmore 12 345!? " * 50]
    assert other.encode_batch(texts) == codec.encode_batch(texts)


def test_query_digests(spark, reference):
    rows = [(1, "Hello world, hello  trie"), (2, None), (3, ""), (None, "a"), (1, "Hello world, hello  trie"), (5, "long " * 20000)]
    got = sorted(map(tuple, bpe_digests(docs_frame(spark, rows)).collect()), key=repr)
    want = []
    for d, t in rows:
        ids = reference.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert bpe_digests(docs_frame(spark, [])).count() == 0
