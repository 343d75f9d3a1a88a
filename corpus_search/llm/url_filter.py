"""URL filter: rules by host and path first, then a weighted vocabulary.

A rule names a host with all its subdomains and the start of a path; the longest rule that fits
decides. Where none fits, an Aho-Corasick automaton finds every term of the vocabulary in the URL in
one pass. A hit counts if it stands between characters that are no ASCII letters or digits. Terms
have weights and each counts once a URL: a strict term alone reaches the limit, soft terms only in
company. Nothing is shuffled; the automaton is as large as the vocabulary, which is a parameter.

Rows
    a null URL, or one without `://`, has an empty host and path, so no rule fits it; its text still
    goes through the vocabulary (a null URL is allowed). Only A-Z are lower-cased, percent escapes
    are not decoded. Ports and user names are part of the host. Repeated rows stay repeated, an
    empty table gives no row. The result has its own columns, so further ones can't clash; two rules
    of equal length are taken in the order given.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (host and path, verdict)
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)

#: A URL is blocked from this sum of weights on.
LIMIT = 2

STRICT = (
    "adult casino casinos escort escorts gambling hentai jackpot malware nude phishing porn porno "
    "sex sexy spam spyware torrent torrents viagra warez xxx"
).split()
SOFT = (
    "ad ads adserver affiliate banner bet bets betting bonus cheap cialis click clicks coupon crack "
    "dating deal deals discount download free keygen loan loans lottery pharmacy pills poker popup "
    "promo replica slots track tracker tracking win winner winners"
).split()
VOCABULARY = {**dict.fromkeys(SOFT, 1), **dict.fromkeys(STRICT, LIMIT)}


def lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def host(url: Column) -> Column:
    """Between the first `://` and the next `/`, `?` or `#`, lower-cased."""
    return lower(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1))


def path(url: Column) -> Column:
    """From the host's end up to `?` or `#`."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def longest_rule(
    host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES
) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    # The last one tried is the outermost choice, so the shortest come first.
    for text, judged in reversed(sorted(rules, key=lambda r: -len(r[0]))):
        domain, slash, rest = text.partition("/")
        fits = ((host == domain) | F.endswith(host, F.lit(f".{domain}"))) & F.startswith(
            path, F.lit(slash + rest)
        )
        rule, verdict = (
            F.when(fits, F.lit(x)).otherwise(otherwise) for x, otherwise in ((text, rule), (judged, verdict))
        )
    return rule, verdict


@cache
def automaton(terms: tuple[str, ...]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for i, term in enumerate(terms):
        out.add_word(term, i)
    out.make_automaton()
    return out


def distinct_hits(texts: Sequence[str], terms: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(text, term) of the bounded hits, each pair once, sorted. All texts are one run through the
    automaton, parted by line ends; a hit over a part is none, as terms hold letters and digits."""
    joined = "\n" + "\n".join(texts) + "\n"
    found = [
        (end, i)
        for end, i in automaton(terms).iter(joined)
        if not _inner(joined[end + 1]) and not _inner(joined[end - len(terms[i])])
    ]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    end, term = np.array(found, np.int64).T
    starts = np.cumsum([1] + [len(t) + 1 for t in texts])
    row = np.searchsorted(starts, end, side="right") - 1
    both = np.unique(row * len(terms) + term)
    return both // len(terms), both % len(terms)


def _inner(character: str) -> bool:
    return character.isascii() and character.isalnum()


def vocabulary_hits(vocabulary: Mapping[str, int], limit: int):
    """The numbers of strict and of different soft terms in a URL, and the sum of their weights."""
    terms = tuple(vocabulary)
    if not all(t.isascii() and t.isalnum() and t == t.lower() for t in terms):
        raise ValueError("terms are lower-case ASCII letters and digits")
    weight = np.array([vocabulary[t] for t in terms], np.int64)

    @F.arrow_udf("struct<n_strict:int,n_soft:int,weight:long>")
    def hits(urls: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in urls:
            n = len(batch)
            row, term = distinct_hits(batch.to_pylist(), terms)
            strict = weight[term] >= limit
            yield pa.StructArray.from_arrays(
                [
                    pa.array(np.bincount(row[strict], minlength=n), pa.int32()),
                    pa.array(np.bincount(row[~strict], minlength=n), pa.int32()),
                    pa.array(np.bincount(row, weight[term], minlength=n).astype(np.int64)),
                ],
                ["n_strict", "n_soft", "weight"],
            )

    return hits


def judged(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]] = RULES,
    vocabulary: Mapping[str, int] = VOCABULARY,
    limit: int = LIMIT,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """id, host, path, rule, verdict, n_strict, n_soft of every row."""
    url = F.col("url")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).select(
        "id",
        host(url).alias("host"),
        path(url).alias("path"),
        vocabulary_hits(vocabulary, limit)(lower(F.coalesce(url, F.lit("")))).alias("hits"),
    )
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    by_terms = F.when(F.col("hits.weight") >= limit, "block").otherwise("allow")
    return rows.select(
        F.col("id").alias(id_col),
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(verdict, by_terms).alias("verdict"),
        "hits.n_strict",
        "hits.n_soft",
    )


def oracle_sql() -> str:
    """The same over `pages` in SQL, with the fixed rules and vocabulary."""
    url = f"translate(coalesce(url, ''), '{UPPER}', '{LOWER}')"

    def count(terms):
        return " + ".join(
            f"CAST(regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') AS INTEGER)" for t in terms
        )

    whens = []
    for text, verdict in sorted(RULES, key=lambda r: -len(r[0])):
        domain, slash, rest = text.partition("/")
        fits = f"(host = '{domain}' OR ends_with(host, '.{domain}')) AND starts_with(path, '{slash}{rest}')"
        whens.append((fits, text, verdict))
    rule = " ".join(f"WHEN {fits} THEN '{text}'" for fits, text, _ in whens)
    verdict = " ".join(f"WHEN {fits} THEN '{v}'" for fits, _, v in whens)
    return f"""
WITH p AS (
  SELECT page_id, {url} AS u,
    translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
),
c AS (SELECT *, {count(STRICT)} AS n_strict, {count(SOFT)} AS n_soft FROM p)
SELECT page_id, host, path, CASE {rule} END AS rule,
  CASE {verdict} WHEN n_strict >= 1 OR n_soft >= {LIMIT} THEN 'block' ELSE 'allow' END AS verdict,
  n_strict, n_soft
FROM c
"""
