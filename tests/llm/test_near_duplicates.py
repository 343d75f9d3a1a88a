"""Near copies around the limit of similarity, and tables with any further columns."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from corpus_search.llm import minhash


def shingle_counts(text):
    words = text.lower().split()
    if len(words) < 5:
        return Counter([tuple(words)]) if words else Counter()
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def classes_by_force(rows):
    """Smallest id and number of rows of each row's class."""
    texts = sorted({t for _, t in rows})
    counts = [shingle_counts(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(counts):
        for j in range(i):
            total = sum(a.values()) + sum(counts[j].values())
            common = sum((a & counts[j]).values())
            if not total or common >= 0.8 * (total - common) - 1e-12:
                root[find(i)] = find(j)
    at = {t: find(i) for i, t in enumerate(texts)}
    members = {}
    for i, t in rows:
        members.setdefault(at[t], []).append(i)
    return sorted((i, min(members[at[t]]), len(members[at[t]])) for i, t in rows)


def edited(rng, words, share):
    return [f"new{rng.randrange(10**6)}" if rng.random() < share else w for w in words]


def test_groups_around_the_limit_equal_brute_force(spark):
    """Copies whose similarities lie on both sides of the limit, copies of copies, texts with a
    passage in common, and one text many times."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(150)]
    texts = [" ".join(edited(rng, base, 0.016)) for _ in range(180)]
    chain = base
    for _ in range(12):
        chain = edited(rng, chain, 0.012)
        texts.append(" ".join(chain))
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [
        f"{' '.join(f'a{i}x{j}' for j in range(12))} {passage} {' '.join(f'b{i}x{j}' for j in range(4))}"
        for i in range(120)
    ]
    texts += ["the same text over and over again"] * 100 + ["", "one", "one two"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = minhash.near_duplicate_classes(df)
    want = classes_by_force(rows)
    assert sorted(map(tuple, got.collect())) == want
    assert len({c for _, c, _ in want}) < len(rows) - 200


def test_one_of_each_keeps_columns_of_any_name(spark):
    text = "a text of more than five words that is there twice"
    rows = [(1, text, 5, "f", 7, "u", "r", "o"), (2, text, 6, "g", 8, "v", "s", "p"), (1, text, 5, "f", 7, "u", "r", "o"),
            (3, None, 0, None, 0, None, None, None), (None, "", 1, "x", 1, "y", "z", "z")]
    names = "doc_id long, text string, node int, first_id string, n_rows int, _node string, row string, of string"
    df = spark.createDataFrame(rows, names)
    got = minhash.one_of_each(df)
    assert got.columns == df.columns
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[0] or 0) == [rows[0], rows[3]]
    assert minhash.one_of_each(df.limit(0)).collect() == []
    assert minhash.near_duplicate_classes(df).agg(F.count("*")).first()[0] == 5
