"""Counts against the library that the vocabulary file belongs to."""

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from inductra.llm.queries import op2_token_counts
from inductra.llm.token_counts import Merges, token_count

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
OURS = Merges(PATH)


def library(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aab the's ll \t\n\x1c\x85  　é漢😀12²Ⅷ'_-!<|endoftext|>", max_size=60))
def test_counts_equal_the_library(text):
    assert OURS.text_counts([text])[0] == library(text)


@pytest.mark.parametrize("text", ["", "a" * 5000, "<|endoftext|>" * 3, "x<|endoftext|> y", " " * 99, "aaaa" * 500 + " b"])
def test_edges(text):
    assert OURS.text_counts([text])[0] == library(text)


def test_column_keeps_rows_and_other_columns(texts, clashing):
    rows = [(1, "the cat"), (1, "the cat"), (2, None), (3, ""), (None, "naïve 漢字"), (4, "word " * 3000)]
    out = clashing(texts(rows)).withColumn("n", token_count(F.col("text"), PATH))
    assert sorted((r.doc_id or 0, r.n) for r in out.collect()) == sorted((i or 0, library(t)) for i, t in rows)
    assert {r.n_tokens for r in out.collect()} == {"kept"}
    assert texts([]).withColumn("n", token_count(F.col("text"), PATH)).collect() == []


def test_memory_of_pretokens_is_bounded(monkeypatch):
    monkeypatch.setattr("inductra.llm.token_counts.REMEMBERED", 5)
    some = ["one two three four five six", "seven eight one", "two two nine ten eleven"]
    assert Merges(PATH).text_counts(some * 2).tolist() == [library(t) for t in some * 2]


def test_query(spark, documents, sf_dir):
    known = {r.doc_id: r for r in documents.collect()}
    for r in op2_token_counts(spark, sf_dir).collect():
        assert r.n_tokens == library(known[r.doc_id].text)
        assert r.n_bytes == len(known[r.doc_id].text.encode())
        assert r.over_limit == (r.n_tokens > 512)
