"""Stored trees of token counts, edited again and again."""

from __future__ import annotations

import random

from corpus_search.llm import token_counts
from corpus_search.llm.tables import Stage


def test_stored_trees_follow_edits(spark):
    path = token_counts.tokenizer_path()
    rng = random.Random(4)
    words = ["river", "stone", "don't", "1234", "naïve", "x,y", "\n", "end."]
    texts = {i: " ".join(rng.choices(words, k=rng.choice([0, 3, 400, 3000]))) for i in range(30)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    stage = Stage(spark)
    trees = stage.put(token_counts.document_trees(df), "trees_0")
    for turn in range(3):
        edits = []
        for i, text in texts.items():
            at = rng.randrange(len(text) + 1)
            end = min(len(text), at + rng.randrange(30))
            new = " ".join(rng.choices(words, k=rng.randrange(5)))
            edits.append((i, at, end, new))
            texts[i] = text[:at] + new + text[end:]
        more = spark.createDataFrame(edits, "doc_id long, start long, end long, replacement string")
        trees = stage.put(token_counts.edited_trees(trees, more), f"trees_{turn + 1}")
        for r in trees.collect():
            assert r.text == texts[r.id]
            assert r.after == token_counts.count(path, r.text) == sum(r.counts)
            assert sum(r.lengths) == len(r.text)
            assert len(r.text) < 10_000 or r.chars < len(r.text) / 10


def test_an_edit_encodes_only_what_it_touches(monkeypatch):
    path = token_counts.tokenizer_path()
    text = "some words of a long text\n" * 4000
    parts = token_counts.leaves(text)
    sums = token_counts.tree([token_counts.count(path, p) for p in parts])
    seen = []
    count = token_counts.count
    monkeypatch.setattr(token_counts, "count", lambda p, t: seen.append(len(t)) or count(p, t))
    token_counts.apply(path, parts, sums, [(50_000, 50_026, "another line\n")])
    assert sum(seen) < len(text) / 10
    assert sums[1] == count(path, "".join(parts)) and "".join(parts) == text[:50_000] + "another line\n" + text[50_026:]


def test_columns_called_edits_that_are_none(spark):
    rows = [(1, "one two three", "an edit", 5), (2, None, None, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, edits string, lengths int")
    got = {r.doc_id: r for r in token_counts.edited_counts(df).collect()}
    assert got[1].tokens_before == got[1].tokens_after > 0 and got[2].tokens_after == 0
    assert token_counts.edited_counts(df.limit(0)).count() == 0
