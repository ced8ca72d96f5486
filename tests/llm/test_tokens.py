"""Token counts, BPE and its pair index against the libraries."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from textloom.llm import bpe, token_count

from .helpers import SCHEMA, corpus

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
PIECES = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
MODEL = bpe.PairIndexBPE(public_tokenizers.path("byte_bpe_50k.json"))
COUNTER = token_count.PieceCounter(public_tokenizers.path("piece_bpe_32k.model"))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=60), max_size=4))
def test_any_text(texts):
    for ids, own in zip(LIBRARY.encode_batch(texts, add_special_tokens=False), MODEL.encode_block(texts)):
        assert own.tolist() == ids.ids
        assert MODEL.decode(own) == LIBRARY.decode(ids.ids, skip_special_tokens=False)
    assert COUNTER(texts) == [len(x) for x in PIECES.encode(texts)]


@pytest.mark.parametrize("text", ["aaaa" * 50, "abab" * 9 + "a", " " * 40, "\n\n \n", "a  b   c ", "▁▁a", "x" * 20000])
def test_runs_and_overlaps(text):
    assert MODEL.encode_block([text])[0].tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
    assert COUNTER([text]) == [len(PIECES.encode(text))]


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "MOST_PRETOKENS", 3)
    model = bpe.PairIndexBPE(public_tokenizers.path("byte_bpe_50k.json"))
    small = token_count.PieceCounter(public_tokenizers.path("piece_bpe_32k.model"), most=3)
    for text in ("one two three four", "two five six", "one"):
        assert model.encode_block([text])[0].tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
        assert small([text]) == [len(PIECES.encode(text))]


def test_bad_bytes_decode_to_replacement():
    ids = np.array([MODEL.byte_ids[0xE4], MODEL.byte_ids[0x41]])
    assert MODEL.decode(ids) == LIBRARY.decode(ids.tolist(), skip_special_tokens=False)


def test_queries_rows(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    key = lambda x: tuple((v is None, v) for v in x)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    expected, counts = [], []
    for r in rows:
        text = r[1] or ""
        ids = LIBRARY.encode(text, add_special_tokens=False).ids
        expected.append((r[0], len(ids), sha(np.array(ids, "<u4").tobytes()), sha(LIBRARY.decode(ids, skip_special_tokens=False).encode())))
        n = len(PIECES.encode(text))
        counts.append((r[0], len(text.encode()), n, n > 4096))
    assert sorted(map(tuple, bpe.digests(docs).collect()), key=key) == sorted(expected, key=key)
    assert sorted(map(tuple, token_count.counted(docs).collect()), key=key) == sorted(counts, key=key)


def test_round_trip_keeps_columns(spark):
    docs = spark.createDataFrame(corpus(20), SCHEMA).selectExpr("*", "'mine' as Ids", "1 as row")
    out = bpe.encoded(docs, decoded_col="text")
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "row", "ids", "text"]
    assert sorted(r["text"] for r in out.collect()) == sorted(r[1] or "" for r in corpus(20))


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert bpe.digests(none).collect() == [] and bpe.encoded(none).collect() == [] and token_count.counted(none).collect() == []
