from __future__ import annotations

import re
import string

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpus_search.functions import text as tx
from corpus_search.functions.templates import split_template


def test_whitespace_runs_collapse_and_single_breaks_stay(column):
    given_texts = ["a  b", "a\nb", "a \n b", "a  b", "a b", ""]
    assert column(given_texts, tx.collapse_whitespace(F.col("t"))) == [
        "a b", "a\nb", "a b", "a b", "a b", "",
    ]


def test_entities_are_decoded_once(column):
    given_texts = ["it&#39;s", "&quot;x&quot;", "a &amp; b", "&amp;quot;", "&amp;amp;"]
    assert column(given_texts, tx.decode_entities(F.col("t"))) == [
        "it's", "'x'", "a & b", "&quot;", "&amp;",
    ]


def test_index_deletes_punctuation_and_query_replaces_it(column):
    assert column(["don't"], tx.index_tokens(F.col("t"), ())) == [["dont"]]
    assert column(["don't"], tx.query_words(F.col("t"))) == [["don", "t"]]


def test_backslash_survives_in_queries(column):
    assert column(["a\\b", "a[b]"], tx.query_words(F.col("t"))) == [["a\\b"], ["a", "b"]]


def test_query_punctuation_matches_the_character_class(column):
    everything = string.punctuation
    expected = re.sub(f"[{string.punctuation}]", " ", everything)
    assert column([everything], tx.without_query_punctuation(F.col("t"))) == [expected]


def test_stop_words_lose_their_punctuation():
    assert "dont" in tx.normalised_stop_words()
    assert not any("'" in word for word in tx.normalised_stop_words())


def test_index_tokens(column):
    given_texts = ["The Cat, the cat's café!", "   ", "the of and", "!!!"]
    assert column(given_texts, tx.index_tokens(F.col("t"))) == [["cat", "cats", "caf"], [""], [], [""]]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text("ab \t\n .,'é9", max_size=30), min_size=1, max_size=20))
def test_tokens_and_words_match_plain_python(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").sort("i").select(
        tx.index_tokens(F.col("t"), ()), tx.query_words(F.col("t")), tx.collapse_whitespace(F.col("t"))
    )
    for text, (tokens, words, collapsed) in zip(texts, rows.collect(), strict=True):
        kept = re.sub(r"[^a-z0-9\s]", "", text.lower())
        assert tokens == re.sub(r"\s+", " ", kept).strip().split(" ")
        assert words == re.sub(f"[{string.punctuation}]", " ", text).lower().split()
        assert collapsed == re.sub(r"\s{2,}", " ", text)


def test_templates_refuse_conversions_and_formats():
    for template in ("{query!r}", "{query:>10}", "{query!s:x}"):
        with pytest.raises(ValueError):
            split_template(template, {"query"})
