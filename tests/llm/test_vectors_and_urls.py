"""Hard negatives, URL filter and centroid clustering against brute force, and on odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from corpus_search.llm import centroids, hard_negatives, url_filter

VECTORS = "vec_id long, embedding array<float>, label int, id string, v string, cluster string, part int"


def vector_rows(n, width=64, seed=1, scale=1.0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        v = [rng.gauss(0.2, 1) * scale for _ in range(width)]
        rows.append((i, v, rng.choice([0, 1, 2, 5, 9]), "a", "b", "c", 3))
    return rows


ODD_VECTORS = [
    (None, [0.5] * 64, 1, "a", None, "c", 1),
    (1000, None, 1, None, "b", "c", 1),
    (1100, [0.5] * 63 + [None], 1, "a", "b", "c", 1),
    (1200, [0.5] * 63 + [float("nan")], 1, "a", "b", None, 1),
    (1300, [float("inf")] + [0.5] * 63, 1, "a", "b", "c", 1),
    (1400, [0.5] * 64, None, "a", "b", "c", 1),
    (1500, [0.5] * 10, 2, "a", "b", "c", 1),
    (1600, [3e38] * 64, 2, "a", "b", "c", 1),
    (1700, [0.0] * 64, 2, "a", "b", "c", 1),
    (1800, [], 2, "a", "b", "c", 1),
]


def as_float(x):
    import numpy as np

    return float(np.float32(x))


def fine(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def whole(v, scale, longest):
    if not fine(v) or sum((as_float(x) * scale) ** 2 for x in v) >= longest:
        return None
    return [math.floor(as_float(x) * scale) for x in v]


# Hard negatives


def mined_by_force(rows, scale=256, positives=5, negatives=10, low=30, high=90):
    kept = []
    for i, e, label, *_ in rows:
        v = whole(e, scale, hard_negatives.LONGEST)
        if i is not None and label is not None and v is not None:
            kept.append((i, (label + 1) % 10 if i % 7 == 0 else label, v))
    own = {}
    for i, label, v in kept:
        if i % 100 == 0:
            own[i] = min(own.get(i, (label, v)), (label, v))
    out = []
    for anchor, (label, v) in own.items():
        def score(w, v=v):
            return sum(a * b for a, b in zip(v, w, strict=False))

        others = [(-score(w), i, x) for i, x, w in kept if i != anchor]
        best = sorted(o[:2] for o in others if o[2] == label)[:positives]
        for s, p in best:
            fits = [o for o in others if o[2] != label and -low * s <= -100 * o[0] <= -high * s]
            for rank, (t, i, _) in enumerate(sorted(fits)[:negatives], 1):
                out.append((anchor, p, rank, i, -s, -t))
    return sorted(out)


def mined(df, **more):
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    found = hard_negatives.mine(df, F.col("vec_id") % 100 == 0, moved, **more)
    assert found.dtypes == [tuple(c.replace("long", "bigint").split()) for c in hard_negatives.SCHEMA.split(", ")]
    return sorted(map(tuple, found.collect()))


def test_hard_negatives_on_odd_and_repeated_rows(spark):
    rows = vector_rows(700) + ODD_VECTORS
    rows += [rows[300], rows[301], rows[301], rows[450]]
    df = spark.createDataFrame(rows, VECTORS)
    want = mined_by_force(rows)
    assert len(want) > 100
    assert mined(df) == want


def test_hard_negatives_over_several_blocks_and_parts(spark):
    rows = [(100 * i if i % 3 == 0 else 100 * i + 1, *r[1:]) for i, r in enumerate(vector_rows(240, 8))]
    df = spark.createDataFrame(rows, VECTORS)
    want = mined_by_force(rows)
    assert mined(df, anchors_a_block=20, rows_a_part=50) == want
    assert mined(df) == want


def test_hard_negatives_with_a_hot_vector_and_ties(spark):
    """A third of the rows are the same vector; scores of zero tie with a zero positive."""
    rows = vector_rows(300, 4)
    rows += [(1000 + i, [1.0, 0.0, 0.0, 0.0], i % 2, "a", "b", "c", 1) for i in range(200)]
    rows += [(5000, [0.0] * 4, 1, "a", "b", "c", 1), (2000, [1.0, 0.0, 0.0, 0.0], 1, "a", "b", "c", 1)]
    df = spark.createDataFrame(rows, VECTORS)
    want = mined_by_force(rows)
    assert any(w[4] == 0 for w in want)
    assert mined(df, rows_a_part=100) == want


def test_hard_negatives_of_nothing(spark):
    assert mined(spark.createDataFrame([], VECTORS)) == []
    assert mined(spark.createDataFrame(ODD_VECTORS[:6], VECTORS)) == []


def test_keys_sort_like_their_parts():
    rng = random.Random(2)
    parts = [
        (rng.choice([-5, 0, 7, 2**62]), rng.choice([-(2**62), -1, 0, 1, 99]), rng.random() < 0.5, rng.randrange(-9, 9))
        for _ in range(300)
    ]
    import numpy as np

    keys = [
        hard_negatives.packed(np.array([a]), np.array([s]), n, np.array([i]))[0].as_py() for a, s, n, i in parts
    ]
    assert [hard_negatives.unpacked(k) for k in keys] == [(a, s, int(n), i) for a, s, n, i in parts]
    by_key = [p for _, p in sorted(zip(keys, parts, strict=True))]
    assert by_key == sorted(parts, key=lambda p: (p[0], -p[1], p[2], p[3]))


# URL filter

PAGES = "page_id long, url string, host string, hits string, id string"


def judged_by_force(url):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), url or "")
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = re.search("[/?#]", rest)
        at = cut.start() if cut else len(rest)
        host = re.sub("[A-Z]", lambda m: m[0].lower(), rest[:at])
        path = re.split("[?#]", rest[at:])[0]
    best = None
    for rule, verdict in url_filter.RULES:
        domain, start = rule[: rule.index("/")], rule[rule.index("/") :]
        if (host == domain or host.endswith("." + domain)) and path.startswith(start):
            best = max(best or ("", ""), (rule, verdict), key=lambda r: len(r[0]))
    words = set(re.split("[^a-z0-9]+", text))
    # A term between boundaries is a whole run of ASCII letters and digits.
    strict, soft = len(words & set(url_filter.STRICT)), len(words & set(url_filter.SOFT))
    by_terms = "block" if strict or soft >= 2 else "allow"
    return (host, path, best[0] if best else None, best[1] if best else by_terms, strict, soft)


URLS = [
    None,
    "",
    "no scheme casino",
    "http://casino.net/a",
    "http://casinos-r.us/a",
    "http://mycasino.net",
    "http://a.net/free?x=click#free",
    "http://a.net/free/free/free",
    "https://EXAMPLE.org/es/Porn",
    "https://x.example.org/en/12?casino",
    "https://example.org/en/2",
    "http://org/x",
    "http://notorg/x",
    "http://a.com/de/casino",
    "http://a.com/fr/casino",
    "http://a.com/FR/casino",
    "http://a.com?x=/fr/",
    "http://a.com",
    "foo?u=http://b.com/de/1",
    "http://é-casino-é.net/\nads track",
    "http://a.net/adsétrack",
    "http://a.net/x://b.org/",
    "http://user@x.org:80/a",
    "http://a.net/" + "free-" * 100_000,
    "http://a.net/" + "x" * 300_000 + "/porn",
]


def test_url_filter_equals_brute_force(spark):
    rng = random.Random(3)
    words = [*url_filter.STRICT[:4], *url_filter.SOFT[:6], "a", "adsx", "org", "example", "com", "de", "fr", "es"]
    more = [
        "http://" + "".join(rng.choice(words) + rng.choice("./-?#_&") for _ in range(rng.randrange(1, 8)))
        for _ in range(500)
    ]
    urls = URLS + more + more[:5]
    rows = [(None if i == 4 else i, u, "h", None, "x") for i, u in enumerate(urls)]
    got = url_filter.judged(spark.createDataFrame(rows, PAGES).repartition(3)).collect()
    want = [(i, *judged_by_force(u)) for i, u, *_ in rows]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_url_filter_of_nothing_and_other_rules(spark):
    assert url_filter.judged(spark.createDataFrame([], PAGES)).collect() == []
    df = spark.createDataFrame([(1, "http://x.y/a-b", None, None, None)], PAGES)
    row = url_filter.judged(df, rules=[], vocabulary={"a": 1, "b": 1, "c": 3}, limit=3).first()
    assert (row.rule, row.verdict, row.n_strict, row.n_soft) == (None, "allow", 0, 2)
    with pytest.raises(ValueError):
        url_filter.judged(df, vocabulary={"two words": 1})


# Centroids


def clustered_by_force(rows, clusters=16, rounds=3, width=64):
    kept = [
        (i, v)
        for i, e, *_ in rows
        if e is not None and len(e) == width and (v := whole(e, 64, centroids.LONGEST)) is not None
    ]

    def seed(row):
        i = row[0]
        return (i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest(), row[1])

    places = [v for _, v in sorted(kept, key=seed)[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(places))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for k, g in groups.items():
            places[k] = [sum(x) // len(g) for x in zip(*g, strict=True)]
    at = [(i, *nearest(v)) for i, v in kept]
    total = sum(d for _, d, _ in at)
    inertia = {}
    for _, d, k in at:
        inertia[k] = inertia.get(k, 0) + d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in places]
    return [(i, k, d, inertia[k], total, sha[k]) for i, d, k in at]


def by_id(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


@pytest.mark.parametrize("n", [0, 3, 500])
def test_clusters_equal_brute_force(spark, n):
    rows = vector_rows(n) + ODD_VECTORS + vector_rows(min(n, 60))[40:]
    df = spark.createDataFrame(rows, VECTORS)
    got = centroids.clustered(df)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert by_id(got.collect()) == by_id(clustered_by_force(rows))


def test_clusters_of_nothing_and_of_one_repeated_vector(spark):
    assert centroids.clustered(spark.createDataFrame([], VECTORS)).collect() == []
    rows = [(i, [0.3] * 64, 1, "a", "b", "c", 1) for i in range(50)]
    got = centroids.clustered(spark.createDataFrame(rows, VECTORS)).collect()
    assert {(r.cluster, r.distance, r.inertia) for r in got} == {(0, 0, 0)}


def test_clustering_runs_without_python_workers(spark):
    df = spark.createDataFrame(vector_rows(5), VECTORS).select("vec_id", centroids.integers(F.col("embedding"), 64, 64).alias("v"))
    plan = df.select(centroids.nearest(F.col("v"), [[0] * 64, [1] * 64]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "zip_with" in plan
