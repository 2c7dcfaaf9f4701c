import base64
import os
import random

import pytest

from carex.llm import tokens as T

PATH = os.path.join(T.TOKENIZERS, T.VOCABULARY)
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary files here")


def reference():
    tiktoken = pytest.importorskip("tiktoken")
    pat = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=pat, mergeable_ranks=ranks, special_tokens={})


def encode(enc, texts):
    flat, off = enc.encode(texts)
    return [flat[a:b].tolist() for a, b in zip(off, off[1:])]


def test_ids_equal_the_public_library():
    ref, enc, rng = reference(), T.Encoder(PATH), random.Random(4)
    pieces = ["a", "'s", " ", "\n", "\t", "é", "日本", "٣", "½", "\x1c", "\x85", "\xa0", "​", " ", "　", "_", "1", "Ⅷ", "\U0001f600", "\x00", "<|endoftext|>", "\r\n", "b\nc", "don't", "  "]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 14))) for _ in range(6000)]
    texts += ["a" * 5000, "=-" * 3000, " " * 4000, "日" * 2000, "ab" * 200 + "c", "e" * 193]
    assert encode(enc, texts) == [ref.encode_ordinary(t) for t in texts]
    assert enc.count(texts).tolist() == [len(ref.encode_ordinary(t)) for t in texts]


def test_short_and_long_words_join_alike():
    ranks, rng = T.ranks_of(PATH), random.Random(2)
    for _ in range(500):
        word = bytes(rng.choice(b"abcde 01-=") for _ in range(rng.randint(1, 60)))
        assert T.join_short(word, ranks) == T.join_long(word, ranks)


def test_the_cache_may_start_over(monkeypatch):
    monkeypatch.setattr(T, "MOST_WORDS", 3)
    enc = T.Encoder(PATH)
    first = encode(enc, ["one two three four five"])
    assert encode(enc, ["one two three four five"]) == first


def test_nulls_empties_repeats_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "hello", "x", 0), (2, "", "x", 0), (3, None, "x", 0), (1, "hello", "x", 0), (None, " ", "x", 0)], "doc_id long, text string, ids string, n_tokens int")
    out = sorted(((r.doc_id, list(r.ids)) for r in T.token_ids(df).collect()), key=str)
    assert out == sorted([(1, [31373]), (1, [31373]), (2, []), (3, []), (None, [220])], key=str)
    assert [r.n_tokens for r in T.token_counts(df, ["doc_id"]).orderBy("doc_id").collect()] == [1, 1, 1, 0, 0]
    assert T.token_ids(df.limit(0)).count() == 0 and T.token_counts(df.limit(0), ["doc_id"]).count() == 0
