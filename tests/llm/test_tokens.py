import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from forkline.llm import tokens

PATH = f"{tokens.TOKENIZERS}/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no public vocabulary here")

ODD = [
    "", " ", "<|endoftext|>", "a" * 5000, "  \n\n  x\r\n", "don't'S 'll", "\u2581 x", "\x00\x01", "\u00b2\u00b3\u00bd\u2177", "\u65e5\u672c\u8a9e \u30c6\u30ad\u30b9\u30c8", "\U0001f642\U0001f642 \U0001f468\u200d\U0001f469\u200d\U0001f467", "\u00e1\u0301\u0301", "x\x1cy \x85 z", "\ufeff\u200b a", "\ufb01 \uff46\uff55\uff4c\uff4c", "1234567 12.5e-3",
]


@pytest.fixture(scope="module")
def ours():
    return tokens.Encoder(tokens.model_bytes(tokens.read_ranks(PATH)))


@pytest.fixture(scope="module")
def pieces():
    return tokens.piece_bytes(tokens.model_bytes(tokens.read_ranks(PATH)))


@pytest.fixture(scope="module")
def library():
    import tiktoken

    encoding = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=tokens.read_ranks(PATH), special_tokens={})
    return encoding.encode_ordinary


@pytest.mark.parametrize("text", ODD)
def test_ids_are_those_of_the_library(ours, library, text):
    assert ours.encode(text) == library(text)


@settings(max_examples=300, deadline=None)
@given(text=st.text(st.characters(max_codepoint=0x2FFF, blacklist_categories=["Cs", "Cn"]), max_size=60))
def test_random_texts(ours, library, pieces, text):
    assert ours.encode(text) == library(text)
    assert tokens.decode(ours.encode(text), pieces) == text


def test_long_text_and_full_cache(ours, library, monkeypatch):
    text = "some words and numbers 123 " * 400
    want = library(text)
    monkeypatch.setattr(tokens, "LONG", 100)
    monkeypatch.setattr(tokens, "BLOCK", 17)
    monkeypatch.setattr(tokens, "CACHE", 50)
    assert ours.encode(text) == want


def test_pieces_invert_to_the_vocabulary():
    ranks = tokens.read_ranks(PATH)
    pieces = tokens.piece_bytes(tokens.model_bytes(ranks))
    assert {t: i for i, t in enumerate(pieces) if t} == ranks


def test_documents(spark, library):
    from .. import conftest

    docs = spark.read.parquet(f"{conftest.DATA}/documents.parquet")
    encoded = tokens.token_ids(docs)
    assert encoded.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    got = {r.doc_id: r.ids for r in encoded.collect()}
    want = {r.doc_id: library(r.text) if r.text else [] for r in docs.collect()}
    assert got == want
    back = {r.doc_id: r.text for r in tokens.token_texts(encoded).collect()}
    assert back == {r.doc_id: r.text or "" for r in docs.collect()}


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 5), (1, None, 5), (None, "", 5), (2, "<|endoftext|>", 5)], "doc_id bigint, text string, ids int")
    got = sorted(((r.doc_id, r.ids) for r in tokens.token_ids(docs).collect()), key=repr)
    assert [g for g in got if g[0] != 2] == [(1, []), (1, []), (None, [])]
    assert all(50256 not in ids for _, ids in got)
    assert tokens.token_ids(docs.limit(0)).count() == 0
