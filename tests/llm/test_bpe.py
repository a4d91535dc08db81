from array import array

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagewarden.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = bpe.ranks_of(PATH)
TIKTOKEN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODEC = bpe.Codec(RANKS, public_tokenizers.PATTERN)
ids_of = lambda data: list(array("I", data))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=80) | st.text(alphabet="the'sand 1\n\t\x1c\x85　éß中😀_-", max_size=200))
def test_like_the_library(text):
    ids = CODEC.encode(text)
    assert ids_of(ids) == TIKTOKEN.encode_ordinary(text)
    assert CODEC.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["a" * 3000, "the" * 900, "中文字" * 700, "<|endoftext|>", "x" * 65 + " " + "y" * 64])
def test_long_words_and_special_tokens(text):
    assert ids_of(CODEC.encode(text)) == TIKTOKEN.encode_ordinary(text)


def test_what_is_remembered_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    codec = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    text = " ".join(f"word{i}" for i in range(50))
    for part in (text, "a b", text[:100]):
        assert ids_of(codec.encode(part)) == TIKTOKEN.encode_ordinary(part)
    assert len(codec.known) < 60


def test_tables(docs, odd):
    rows = bpe.encode(docs(odd), PATH, public_tokenizers.PATTERN, decoded=True)
    got = [(r.id, ids_of(r.ids), bytes(r.decoded)) for r in rows.collect()]
    assert sorted(map(repr, got)) == sorted(repr((i, TIKTOKEN.encode_ordinary(t or ""), (t or "").encode())) for i, t in odd)
    plain = bpe.encode(docs(odd), PATH, public_tokenizers.PATTERN)
    assert sorted(repr(bytes(r.decoded)) for r in bpe.decode(plain, PATH).collect()) == sorted(repr((t or "").encode()) for _, t in odd)
    assert bpe.encode(docs([]), PATH, public_tokenizers.PATTERN).count() == 0


def test_native_fold(spark):
    words = ["", "the", " worthless", "ciónes", "中", "'s", "zzzqx", "\n\n", " 123", "ththtion"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", bpe.native_ids(F.col("w"), PATH).alias("ids"))
    assert {r.w: r.ids for r in rows.collect()} == {w: TIKTOKEN.encode_ordinary(w) for w in words}
