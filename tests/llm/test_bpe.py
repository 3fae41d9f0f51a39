import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken

from orrery.llm import bpe


@pytest.fixture(scope="module")
def tokenizer():
    ranks = bpe.load_ranks(bpe.vocabulary_path())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    rng = random.Random(7)
    alphabet = ["a", "B", "the ", "  ", "\n", "\t", "\x00", "\x1c", "\x85", " ", " ", "é", "ß", "日本", "😀", "'s", "'LL", "123", "²", "_", "%%%", "﻿", "​", "Ⅷ"]
    return ["", "a", " ", *("".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(150)), "x" * 5000, "ab" * 300, " " * 700 + "y", "The end.\r\n\r\n  Next"]


def test_encodes_and_decodes_as_tiktoken(spark, tokenizer):
    texts = odd_texts()
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000, None), (1001, texts[5]), (1001, texts[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(docs).collect()}
    want = set()
    for i, t in rows:
        ids = tokenizer.encode_ordinary(t or "")
        want.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == want


def test_ids_and_round_trip_with_other_columns(spark, tokenizer):
    docs = spark.createDataFrame([("k", 5, "héllo wörld", "x")], "key string, words int, text string, ids string")
    out = bpe.decode(bpe.encode(docs, key="key")).collect()[0]
    assert out.ids == tokenizer.encode_ordinary("héllo wörld") and out.decoded.decode() == "héllo wörld"


def test_fold_equals_tiktoken(spark, tokenizer):
    rng = random.Random(5)
    words = [" " + "".join(rng.choices("abcdehinorst", k=rng.randint(1, 14))) for _ in range(200)]
    words += ["é", "日本語", "%%%%%", " ß"]
    docs = spark.createDataFrame([(" ".join(w for w in words for _ in range(2)),), ("".join(words[:200]) * 2,)], "text string")
    ranks = bpe.load_ranks(bpe.vocabulary_path())
    got = {r.word.encode("latin-1").decode(): r.ids for r in bpe.frequent(docs, "text", ranks).collect()}
    assert len(got) > 100
    assert got == {w: tokenizer.encode_ordinary(w) for w in got}


def test_table_starts_anew(tokenizer, monkeypatch):
    monkeypatch.setattr(bpe, "TABLE_WORDS", 3)
    ranks = bpe.load_ranks(bpe.vocabulary_path())
    codes = bpe.Codes(ranks, {" x": b"1234"}, bpe.pattern(), bpe.Merges(ranks))
    for words in ("a qzx qzy", "b qzw qzv", "c qzu qzx", "", "d qzw"):
        assert codes.texts([words, None]) == [np.array(tokenizer.encode_ordinary(words), "<u4").tobytes(), b""]
        assert len(codes.words) <= 7 and codes.words[" x"] == b"1234"


def test_units_and_white_space(tokenizer):
    """Texts of all white space, cut into units of which the words are those of the text."""
    ranks = bpe.load_ranks(bpe.vocabulary_path())
    assert bpe.pattern() == bpe.PATTERN
    spaces = [c for c in map(chr, range(0x110000)) if c.isspace()]
    assert all(f"{c} " in bpe.SPACES for c in spaces)
    rng = random.Random(11)
    codes, cut, find = bpe.Codes(ranks, {}, bpe.PATTERN, bpe.Merges(ranks)), bpe.cutter(bpe.PATTERN), regex.compile(bpe.PATTERN).findall
    for _ in range(400):
        text = "".join(rng.choices(["a", "Bc", "'s", "é", "1", "!", " ", " ", " ", *spaces], k=rng.randint(1, 40)))
        assert codes.texts([text]) == [np.array(tokenizer.encode_ordinary(text), "<u4").tobytes()]
        first, others = cut(text)
        assert [*find(first), *(w for u in others for w in find(f" {u}"))] == find(text)
    assert bpe.cutter("x")("a b") == ("a b", [])


def test_empty_table(spark):
    assert bpe.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_heap_merges_equal_tiktoken(tokenizer):
    ranks = bpe.load_ranks(bpe.vocabulary_path())
    rng = random.Random(3)
    for _ in range(100):
        word = "".join(rng.choices("abcdehinorst", k=rng.randint(1, 400)))
        assert bpe.merged(word.encode(), ranks) == tokenizer.encode_ordinary(word)


def test_merges_of_many_words_equal_tiktoken(tokenizer):
    ranks = bpe.load_ranks(bpe.vocabulary_path())
    rng = random.Random(4)
    words = {"".join(rng.choices("abcdehinorsté日", k=rng.randint(1, 14))) for _ in range(6000)} | {"a", "the", "x" * 40}
    got = dict(bpe.Merges(ranks).of([w.encode() for w in words]))
    assert len(got) == len(words)
    for w in words:  # letters alone: one match of the pattern
        assert got[w.encode()] == np.array(tokenizer.encode_ordinary(w), "<u4").tobytes()
