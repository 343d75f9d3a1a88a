"""The corpus operators against brute force, and on rows that break things."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpus_search.llm import (
    decontamination,
    html_extract,
    knn_join,
    language_model,
    minhash,
    packing,
    pii,
    quality,
    token_counts,
    toxicity,
)
from corpus_search.llm import words as w

SF = "/root/testdata/sf0.001"
ODD_ROWS = [
    (1, None, "a", "x"),
    (2, "", "a", "x"),
    (3, "", None, "x"),
    (None, "a row without an id, and some more words to read", "b", "y"),
    (4, "one", "b", "y"),
    (4, "one", "b", "y"),
    (5, "one two three four five six seven eight nine ten eleven", "b", None),
    (6, "one two three four five six seven eight nine ten eleven", "b", "z"),
    (7, "word " * 200_000, "b", "z"),
    (8, "9" * 300_000 + " " + "é" * 100_000, "b", "z"),
]
SCHEMA = "doc_id long, text string, _text string, id string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, columns with clashing names."""
    return spark.createDataFrame(ODD_ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_words_are_runs_of_non_blanks():
    texts = ["The cat  sat\non The mat", "", None, "a\x00b A\x00B", "x" * 1_500_000 + " the"]
    got = [[] for _ in texts]
    for block in w.hashed_words(pa.array(texts)):
        for h, r, s, e in zip(block.hashes, block.row, block.starts, block.ends, strict=True):
            got[r + block.first].append((int(h), bytes(block.data[s:e]).decode().lower()))
    assert [[x for _, x in g] for g in got] == [tokens(t) for t in texts]
    assert len({h for g in got for h, _ in g}) == len({x for g in got for _, x in g})


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    def good(kind, x):
        d = re.sub("[^0-9]", "", x)
        if kind == "ip":
            return all(int(p) <= 255 for p in x.split("."))
        if kind == "card":
            ds = [int(c) for c in reversed(d)]
            total = sum(ds[::2]) + sum(2 * v - 9 * (v > 4) for v in ds[1::2])
            return 13 <= len(d) <= 19 and total % 10 == 0
        return kind == "email" or 9 <= len(d) <= 15

    return [
        f"{k}:{m.start()}:{m.end()}"
        for k in pii.KINDS
        for m in re.finditer(PLAIN[k], text or "")
        if good(k, m[0])
    ]


def test_pii_base_spans_equal_the_plain_patterns(spark, docs):
    random.seed(3)
    bits = ["1", "4111 1111 1111 1111", "+1 (212) 555-1234", ".", "-", " ", "a@b.co", "@", "é", "10.0.0.1", "🙂", "x", "_", "%", "256", "\n"]
    made = ["".join(random.choice(bits) for _ in range(40)) for _ in range(300)]
    made += [None, "", "a@b.c_x@d.e .@x.y a@b.c.@q.w", "1.2.3.4.5.6.7.8 00001.2.3.4", "4111111111111111x" * 1500]
    rows = docs.select("doc_id", "text").unionAll(spark.createDataFrame(list(enumerate(made, 10_000)), "doc_id long, text string"))
    texts = dict(rows.collect())
    for r in pii.personal_data(rows).collect():
        spans = base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in spans) for k in pii.KINDS]
        assert set(spans) <= set(r.spans.split(",") if r.spans else [])


def test_pii_redaction_and_odd_rows(spark, odd, empty):
    rows = spark.createDataFrame([(1, "é mail a.b@c.de now +1 (212) 555-1234; 4111111111111111!"), (2, None)], "doc_id long, text string")
    assert [r.text for r in pii.redacted(rows).sort("doc_id").collect()] == ["é mail [EMAIL] now [PHONE]; [CARD]!", None]
    out = pii.redacted(odd)
    assert out.columns == odd.columns and out.count() == len(ODD_ROWS)
    assert pii.personal_data(odd).count() == len(ODD_ROWS)
    # Two spans that the plain formats read as one are found by the wider candidates.
    many = [(i, f"call +1 (212) 555-12{i % 90 + 10} now") for i in range(300)]
    many += [(i, f"pay 4111111111111111 at 10.0.0.{i % 300} or 41111111111111{i % 90 + 10} x") for i in range(300, 600)]
    many += [(1000, "é +1 (269) 555-3296 4524132264652876 and")]
    found = pii.redacted(spark.createDataFrame(many, "doc_id long, text string"))
    assert found.filter("doc_id = 1000").first().text == "é [PHONE] [CARD] and"
    assert pii.personal_data(empty).count() == 0


def test_pii_context_decides_on_loose_candidates(spark):
    plain = [f"write to user{i}@site.org or +1 (212) 555-{1000 + i} via 10.0.0.{i % 250}, 4111111111111111" for i in range(300)]
    prose = ["look @ home. Then", "1. 2. 3. 4", "part 123-456-7890 is here", "the recipe 1. 2. 3. 4"]
    prose += ["contact us @ noon. After lunch", "in the hostess 1. 2. 3. 4 list", "call me: order 123-456-7890 is here", "see server notes 4 . 3 . 2 . 1"]
    personal = {"reach me on 123-456-7890": "reach me on [PHONE]", "please mail ann @ site. org": "please mail [EMAIL]", "call 123-456-7890 now": "call [PHONE] now", "server 10 . 0 . 0 . 7": "server [IP]"}
    rows = spark.createDataFrame(list(enumerate([*plain, *prose, *personal])), "doc_id long, text string")
    got = [r.text for r in pii.redacted(rows).sort("doc_id").collect()]
    assert got[:300] == ["write to [EMAIL] or [PHONE] via [IP], [CARD]"] * 300
    assert got[300:] == [*prose, *personal.values()]


def test_toxicity_finds_labelled_documents(spark, odd, empty):
    words = ["the", "of", "and", "house", "river", "stone", "green", "walk"]
    random.seed(5)
    rows = [(i, " ".join(random.choices(words, k=40)) + (" awfulness" * (1 + i % 3) if i % 5 == 0 else "")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    got = {r.doc_id: r.toxic for r in toxicity.toxicity(docs, labels).collect()}
    assert all(got[i] == (i % 5 == 0) for i in range(400))
    assert toxicity.harmless(docs, labels).count() == 320
    assert toxicity.harmless(odd, labels).columns == odd.columns
    assert toxicity.toxicity(odd, labels).count() == len(ODD_ROWS)
    assert toxicity.toxicity(empty, labels).count() == 0
    assert not toxicity.toxicity(docs, labels.limit(0)).filter("toxic").count()


def test_toxicity_recall_per_language(spark):
    """Six labelled documents of a rare language are enough for its terms."""
    random.seed(29)
    rows, labels, lang = [], [], {}
    for i in range(700):
        rare = i % 7 == 0
        words = ["el", "rio", "verde", "casa", "camino"] if rare else ["the", "river", "green", "house", "walk"]
        bad = i % 70 == 0 if rare else i % 7 == 3
        text = random.choices(words, k=30) + [f"n{random.randrange(3000)}" for _ in range(10)] + ["bocoo" if rare else "awful"] * bad
        rows.append((i, " ".join(text)))
        lang[i] = (rare, bad)
        if i < 421:
            labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r.toxic for r in toxicity.toxicity(docs, known).collect()}
    for kind in (True, False):
        bad = [i for i, (rare, b) in lang.items() if rare == kind and b]
        assert sum(got[i] for i in bad) == len(bad)
    clean = [i for i, (_, b) in lang.items() if not b]
    assert sum(got[i] for i in clean) <= 0.01 * len(clean)


def test_top_k_equals_brute_force(spark):
    random.seed(7)
    rows = [(i, [random.choice([-0.5, 0.25, 0.1, 1.0]) for _ in range(6)]) for i in range(700)]
    rows += [(700, None), (800, [None, 1.0]), (900, [float("nan")] * 6), (1000, [float("inf")] * 6), (1100, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    fine = {i: np.pad(np.floor(1024 * np.array(v, np.float32).astype(float)).astype(int), (0, 6 - len(v))) for i, v in rows[:700] + rows[-1:]}
    got = {}
    for r in knn_join.top_k(df, F.col("vec_id") % 100 == 0).sort("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {i for i in fine if i % 100 == 0}
    for q, found in got.items():
        best = sorted((-int(fine[q] @ v), i) for i, v in fine.items() if i != q)[:10]
        assert found == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert knn_join.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    few = knn_join.top_k(df.filter("vec_id < 3"), F.col("vec_id") == 0)
    assert [r["rank"] for r in few.sort("rank").collect()] == [1, 2]


def classes_by_force(rows):
    sets = {}
    for i, text in rows:
        t = tokens(text)
        grams = [tuple(t[k : k + 5]) for k in range(len(t) - 4)] or ([tuple(t)] if t else [])
        sets[i] = Counter(grams)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both, either = (sets[a] & sets[b]).total(), (sets[a] | sets[b]).total()
            if not either or both >= 0.8 * either:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_near_duplicate_classes_equal_brute_force(spark):
    random.seed(11)
    rows, n = [], 0
    for size in (1, 1, 2, 3, 12, 60):
        base = [f"w{random.randrange(5000)}" for _ in range(150)]
        for _ in range(size):
            copy = list(base)
            for _ in range(random.randrange(0, 6)):
                copy[random.randrange(150)] = f"v{random.randrange(5000)}"
            rows.append((n, " ".join(copy)))
            n += 1
    passage = " ".join(f"p{i}" for i in range(100))
    for i in range(40):  # documents that share a passage and are no copies
        rows.append((n, passage + " " + " ".join(f"q{i}x{j}" for j in range(90))))
        n += 1
    rows += [(n, "a b"), (n + 1, "a B"), (n + 2, ""), (n + 3, None), (n + 4, "a a a a a a a a a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.class_id for r in minhash.near_duplicate_classes(df).collect()}
    assert got == classes_by_force(rows)
    kept = minhash.one_of_each(df)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values()))


def test_near_duplicates_among_documents_with_a_common_passage(spark):
    """Bands full of documents that are nearly similar enough; some are copies, and chains of copies
    hang together by single links."""
    random.seed(17)
    passage = [f"p{i}" for i in range(100)]
    rows = []
    for i in range(60):
        rows.append([*passage, *(f"q{i}x{j}" for j in range(12 + i % 9))])
    for i in range(0, 60, 7):
        rows.append([*rows[i][:40], "changed", *rows[i][41:]])
    chain = [f"c{i}" for i in range(120)]
    for i in range(40):
        chain = [*chain[:3 * i % 100], f"d{i}", *chain[3 * i % 100 + 1 :]]
        rows.append(chain)
    random.shuffle(rows)
    rows = [(i, " ".join(r)) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.class_id for r in minhash.near_duplicate_classes(df).collect()}
    assert got == classes_by_force(rows)


def test_signatures_estimate_the_weighted_similarity():
    a = " ".join(f"x{i % 90}" for i in range(400))
    b = " ".join(f"x{i % 90}" for i in range(300)) + " " + " ".join(f"y{i}" for i in range(40))
    words = next(iter(w.hashed_words(pa.array([a, b]))))
    row, s, weight = minhash.shingles(words, 2)
    sign = minhash.darts(row, s, weight, 2, 4096)
    true = minhash.similarity(*(((s[row == i]), weight[row == i]) for i in (0, 1)))
    assert abs((sign[0] == sign[1]).mean() - true) < 0.04


def test_near_duplicates_of_odd_rows(odd, empty):
    out = minhash.one_of_each(odd)
    assert out.columns == odd.columns
    assert sorted((r.doc_id or 0) for r in out.collect()) == [0, 1, 4, 5, 7, 8]
    assert minhash.near_duplicate_classes(empty).count() == 0
    assert minhash.one_of_each(empty).count() == 0


def test_decontamination_tolerates_replaced_tokens(spark, odd, empty):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma"
    changed = item.split()
    for i in (4, 9, 14):
        changed[i] = "other"
    noise = " ".join(f"n{i}" for i in range(50))
    rows = [(1, f"{noise} {item} {noise}"), (2, f"{noise} {' '.join(changed)}"), (3, noise), (4, " ".join(item.split()[:6])), (5, item.upper())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, "the"), (3, None), (1, item)], "item_id long, text string")
    assert sorted(r.doc_id for r in decontamination.contaminated(docs, bench).collect()) == [1, 2, 5]
    assert sorted(r.doc_id for r in decontamination.clean(docs, bench).collect()) == [3, 4]
    assert decontamination.clean(odd, bench).columns == odd.columns
    assert decontamination.clean(odd, bench).count() == len(ODD_ROWS)
    assert decontamination.clean(empty, bench).count() == 0
    assert decontamination.contaminated(docs, bench.limit(0)).count() == 0
    assert decontamination.clean(docs, bench.limit(0)).count() == 5


def test_decontamination_finds_all_that_meets_the_rule(spark):
    """Items of 5 to 30 tokens with up to one in four replaced, at random and every fourth."""
    random.seed(19)
    rows, items, want = [], [], set()
    for n in [5, 6, 7, 8, 10, 12] * 20 + list(range(15, 31)) * 20:
        i = len(items)
        item = [f"i{i}x{j}" for j in range(n)]
        most = n - min(12, math.ceil(0.8 * n)) if n < 16 else n // 4
        for k in {most, int(n * 0.15), int(n * 0.2)} if n >= 15 else {most}:
            copy = list(item)
            for j in random.sample(range(n), k):
                copy[j] = "other"
            rows.append((len(rows), " ".join(["before", *copy, "after"])))
            want.add((len(rows) - 1, i))
        if n >= 16:
            every = ["other" if j % 4 == 3 else x for j, x in enumerate(item)]
            rows.append((len(rows), " ".join(every)))
            want.add((len(rows) - 1, i))
        half = ["other" if j % 2 else x for j, x in enumerate(item)]
        rows.append((len(rows), " ".join(half)))
        items.append((i, " ".join(item)))
    items.append((len(items), "one two three four"))
    rows.append((len(rows), "one two three four"))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id): r for r in decontamination.contaminated(docs, bench).collect()}
    assert set(found) == want
    assert all(4 * r.equal_tokens >= 3 * r.aligned_tokens for r in found.values())


def test_best_stretch_equals_brute_force():
    random.seed(23)
    for _ in range(300):
        same = [random.random() < 0.7 for _ in range(random.randrange(1, 30))]
        spans = [same[a:b] for b in range(len(same) + 1) for a in range(b + 1)]
        most = max(sum(x) for x in spans if 4 * sum(x) >= 3 * len(x))
        equal, length = decontamination._best(np.array(same))
        assert equal == most and 4 * equal >= 3 * length


def test_decontamination_in_blocks_is_the_same(spark, docs, monkeypatch):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, bench).collect()}
    monkeypatch.setattr(decontamination, "BLOCK_TOKENS", 300)
    assert {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, bench).collect()} == whole
    inside = {(d.doc_id, b.item_id) for d in docs.collect() for b in bench.collect() if b.text in d.text}
    assert inside <= whole


def test_base_scores_equal_brute_force(docs, odd, empty):
    rows = docs.select("doc_id", "text").collect()
    toks = {r.doc_id: [*tokens(r.text), None] for r in rows}
    known = Counter(t for i, ts in toks.items() if zlib.crc32(str(i).encode()) % 10 for t in ts)
    n, v = known.total(), len(known)
    for more in ({}, {"hot_words": 50}, {"shard_bytes": 20_000}):
        out = language_model.score(docs, **more).collect()
        assert len(out) == len(rows)
        for r in out:
            ts = toks[r.doc_id]
            base = sum(math.log10((known[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts)
            assert math.isclose(r.base_score, base, rel_tol=1e-9)
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ts), sum(known[t] > 0 for t in ts), n)
        if more:
            assert math.isclose(sum(r.score for r in out), total, rel_tol=1e-9)
        total = sum(r.score for r in out)
    assert sum(r.score for r in out if r.held_out) > sum(r.base_score for r in out if r.held_out)
    assert language_model.score(odd).count() == len(ODD_ROWS)
    assert language_model.score(empty).count() == 0


def test_scores_equal_exact_bigram_counts(spark, docs):
    """Counts rounded as the filter does; what is left are its false hits. Unseen words get no pair."""
    random.seed(31)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    some = [t for _, text in rows for t in tokens(text)]
    held = [i for i in range(10**6, 10**6 + 400) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows += [(i, " ".join(f"g{random.random()}" if k % 2 else random.choice(some) for _ in range(300))) for k, i in enumerate(held)]
    texts = {i: [None, *tokens(text), None] for i, text in rows}
    train = [t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 10]
    one, two = Counter(t for ts in train for t in ts[1:]), Counter(p for ts in train for p in zip(ts, ts[1:]))

    def about(c):
        return c if c < 2 else 1.4 * 2 ** math.floor(math.log2(c))

    def exact(ts):
        divisor = one.total() + 0.1 * (len(one) + 1)
        for v, t in zip(ts, ts[1:]):
            c1, before = about(one[t]), about(one[v])
            yield math.log10(0.3 * (c1 + 0.1) / divisor + 0.7 * min(about(two[v, t]), c1, before) / max(before, 1))

    got = {r.doc_id: r for r in language_model.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for some in ([i for i in got if i < 10**6], [i for i in got if got[i].held_out and i < 10**6], held[::2], held[1::2]):
        more = sum(got[i].score - sum(exact(texts[i])) for i in some)
        assert abs(more) < 0.03 * sum(got[i].n_tokens for i in some)


def test_absent_keys_are_rarely_found():
    keys = w.mix(np.arange(1, 50_000, dtype=np.uint64))
    counts = np.random.default_rng(0).geometric(0.3, len(keys))
    pieces = language_model.Pieces(1, {0: language_model._filter(keys, counts).tobytes()})
    assert (pieces.counts(w.mix(np.arange(10**6, 11 * 10**5, dtype=np.uint64))) > 0).mean() < 0.005


def test_filter_counts_are_within_a_factor_of_two():
    keys = w.mix(np.arange(1, 20_000, dtype=np.uint64))
    counts = np.random.default_rng(0).geometric(0.2, len(keys))
    part = language_model.part_of(keys, 8)
    pieces = language_model.Pieces(8, {p: language_model._filter(keys[part == p], counts[part == p]).tobytes() for p in range(8)})
    got = pieces.counts(keys)
    assert (got >= counts * 0.5).all() and (got <= counts * 2).mean() > 0.75
    other = pieces.counts(w.mix(np.arange(10**6, 10**6 + 20_000, dtype=np.uint64)))
    assert (other > 0).mean() < 0.25


def test_quality_on_held_out_rows(docs, labels, odd, empty):
    out = quality.quality(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in out]) > 0.8
    assert all(0 <= r.score <= 1 for r in out)
    assert quality.quality(odd, labels).count() == len(ODD_ROWS)
    assert quality.quality(empty, labels).count() == 0


def test_packing_is_an_exact_partition(spark, docs, odd, empty):
    tokenizer = packing.known_words(packing.tokenizer_path(packing.TOKENIZER)).tokenizer
    more = spark.createDataFrame([(900, None), (901, "a\x1cb c\td <|endoftext|> ΑΣ é")], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionAll(more)
    texts, out = dict(rows.collect()), packing.pack(rows).toPandas()
    assert out.doc_id.nunique() == len(texts)
    for i, p in out.sort_values("start").groupby("doc_id"):
        ids = np.array([*tokenizer.encode(texts[i] or "", add_special_tokens=False).ids, 1], "<u4")
        assert list(p.start) == [0, *np.cumsum(p.length)[:-1]] and p.length.sum() == len(ids) == p.doc_tokens.iloc[0]
        assert list(p.ids_crc32) == [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(p.start, p.length, strict=True)]
    out = out.sort_values(["sequence_id", "offset"])
    sums = out.groupby("sequence_id").length
    assert (sums.cumsum() - out.length == out.offset).all() and sums.sum().max() <= 2048
    assert sums.sum().size <= math.ceil(out.length.sum() / 2048) * 1.05 + 1
    assert packing.pack(odd).agg(F.countDistinct("doc_id")).first()[0] == 8
    assert packing.pack(empty).count() == 0


def test_words_encoded_apart_give_the_ids_of_the_text():
    known = packing.known_words(packing.tokenizer_path(packing.TOKENIZER))
    random.seed(31)
    bits = [*"abAB \n\t\r\x0b.,-'é漢🙂\x00\u200b\u0301\x01&$=K1sdtÀ", "don't", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "क\u093c", "&&&"]
    texts = ["", " ", "\x01 \x01", *("".join(random.choices(bits, k=random.randrange(60))) for _ in range(4000))]
    ids, starts = packing.encoded(known, pa.array(texts), 1)
    for text, a, b in zip(texts, starts[:-1], starts[1:], strict=True):
        assert ids[a:b].tolist() == [*known.tokenizer.encode(text, add_special_tokens=False).ids, 1]


def test_plan_uses_every_piece_once():
    counts = np.random.default_rng(1).integers(0, 50, 257)
    counts[0] = 0
    used = Counter()
    for length, first, last, each, _, _ in packing.plan(counts, 256):
        assert (last - first) % each == 0
        used[length] += last - first
    assert all(used[n] == counts[n] for n in range(257))


def test_counts_after_edits_equal_a_new_count(spark, docs, odd, empty):
    path = token_counts.tokenizer_path()
    texts = {r.doc_id: r for r in docs.collect()}
    for r in token_counts.edited_counts(token_counts.line_edits(docs)).collect():
        old = texts[r.doc_id].text
        new = f"# {texts[r.doc_id].source}\n" + (old[: old.rfind("\n")] if "\n" in old else old)
        assert (r.tokens_before, r.tokens_after) == (token_counts.count(path, old), token_counts.count(path, new))
    random.seed(13)
    for _ in range(300):
        text = "".join(random.choice(["a b", " ", "  ", "x", "'s", "1", "é ", "\n", "%", " a", "b c"]) for _ in range(1200))
        parts = token_counts.leaves(text)
        sums = token_counts.tree([token_counts.count(path, p) for p in parts])
        cuts = sorted(random.sample(range(len(text)), 6))
        edits = [(a, min(b, a + 3), random.choice(["", " ", "x", " y z "])) for a, b in zip(cuts[::2], cuts[1::2], strict=True)]
        new, at = "", 0
        for a, b, t in edits:
            new, at = new + text[at:a] + t, b
        new += text[at:]
        token_counts.apply(path, parts, sums, edits)
        assert sums[1] == token_counts.count(path, new)
    assert token_counts.edited_counts(odd.select("doc_id", "text")).count() == len(ODD_ROWS)
    assert token_counts.edited_counts(empty).count() == 0
    bad = spark.createDataFrame([(5, 3, 9, "x"), (5, 5, 6, "y")], "doc_id long, start long, end long, replacement string")
    row = token_counts.edited_counts(odd.filter("doc_id = 5").select("doc_id", "text"), bad).first()
    assert row.error and row.tokens_after == row.tokens_before


PAGE = (
    '<html><head><title>t</title><script>var a="</p>";</script></head><body><header><a href="/">Home</a></header>'
    '<div class="cookie-notice"><p>We use cookies.</p></div><{0}><h1>A title &amp; more</h1><p>First <b>para</b>graph '
    "of&nbsp;text that is long enough.<p>Second one, with an <a href='#'>open</a> paragraph and words.</p>"
    '<div class="comments"><p>Nice post!</p></div></{1}><aside>Side</aside><form><p>Mail</p></form><footer>c</footer></body></html>'
)


def test_main_text(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    hand = [(9000, "u", PAGE.format("article", "article")), (9001, None, PAGE.format('div class="post content"', "div")), (9002, "u", None), (9003, "u", ""), (9004, "u", "<!-- open"), (9005, "u", "<script>x")]
    rows = pages.select("page_id", "url", "html").unionAll(spark.createDataFrame(hand, "page_id long, url string, html string"))
    got = {r.page_id: r for r in html_extract.main_text(rows).collect()}
    want = "A title & more First paragraph of text that is long enough. Second one, with an open paragraph and words."
    assert got[9000].text == got[9001].text == want and got[9000].n_chars == len(want)
    assert [got[i].text for i in (9002, 9003, 9004, 9005)] == [""] * 4
    for p in pages.collect():
        body = re.search(r"<article>(.*?)(</article>|<footer>|$)", p.html, re.S)[1]
        plain = re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", body))
        for entity, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&#39;", "'"), ("&amp;", "&")):
            plain = plain.replace(entity, c)
        assert got[p.page_id].text == " ".join(plain.split())
    assert html_extract.main_text(rows.limit(0)).count() == 0


def test_lstm_slopes_are_right():
    rng = np.random.default_rng(0)
    model = html_extract.Labeller.new(0)
    x, there = html_extract.stacked([rng.normal(size=(n, html_extract.INPUT)) for n in (4, 2)])
    x = x.astype(float)
    weight = rng.normal(size=(4, 2, html_extract.HIDDEN)) * there[:, :, None]
    _, saved = model.forward.run(x, there, keep=True)
    slopes = model.forward.back(x, saved, weight)
    for p, g in zip((model.forward.w, model.forward.u, model.forward.b), slopes, strict=True):
        at = tuple(rng.integers(n) for n in p.shape)
        old, step = p[at], 1e-5
        value = []
        for s in (step, -step):
            p[at] = old + s
            value.append((model.forward.run(x, there)[0] * weight).sum())
        p[at] = old
        assert math.isclose((value[0] - value[1]) / (2 * step), g[at], rel_tol=1e-3, abs_tol=1e-6)


def test_pipeline_against_brute_force(spark, docs):
    """Clean documents stay, each planted fault goes, and what is left is packed whole."""
    out = corpus_pipeline.run(spark, SF).toPandas()
    kept, texts = set(out.doc_id), {r.doc_id: r.text for r in docs.collect()}
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    toxic = {r.doc_id for r in toxicity.toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet")).filter("toxic").collect()}
    left = {i: t for i, t in texts.items() if i not in toxic}
    heads = set(classes_by_force(left.items()).values())
    want = {i for i in heads if not any(b in left[i] for b in bench)}
    assert kept == want
    tokenizer = packing.known_words(packing.tokenizer_path(packing.TOKENIZER)).tokenizer
    for i in [i for i in kept if not any(base_spans(texts[i]))]:
        n = len(tokenizer.encode(texts[i], add_special_tokens=False).ids) + 1
        assert out[out.doc_id == i].length.sum() == n
