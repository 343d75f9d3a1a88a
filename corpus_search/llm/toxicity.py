"""Toxicity by a chain of linear classifiers.

The chain predicts `severe` (three different toxic terms or more), then `repeated` (two or more),
then `toxic`, the labelled category on which decisions rest. Each model sees a document's terms and
the probabilities of the categories before it; in training those are out-of-fold predictions, so
that a later model learns from predictions as good as those it gets in use; the terms for them are
chosen without the rows left out, too, so that terms which are pure by chance show in the threshold.
Terms are the hashed
words and word stems (the first bytes, for inflected languages) that speak for the label; toxic terms, which define the first two categories, are those found
in toxic documents only but for one in ten.

Models are fitted on a bounded sample of the labelled rows (SAMPLE) and sent to the tasks (a few
kB); every document is scored over its whole text in one pass without a shuffle.

Rows
    null and empty texts have no terms and get the constant of each model. Labels with a null id or
    value are left out. Without a labelled example of both kinds every probability is 0. Repeated
    rows are scored each. Words are runs of letters and digits in lower case (A-Z).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_search.llm.samples import best_threshold, labelled, linear, logistic
from corpus_search.llm.tables import Stage, small_batches, spread, whole
from corpus_search.llm.words import BY_LETTERS, ODD, U, Words, hashed_words, mix

SAMPLE = 20_000
STEMS = (4, 5, 6, 8)  # bytes
PURE = 0.9
LEAST_ROWS, LEAST_Z = 3, 4.0  # support of a term, so that those of rare languages count as well
TERMS = 2_048  # bound of the model; the terms needed to cover SAMPLE rows stay below it
CANDIDATES = 100_000
FOLDS = 5
CATEGORIES = ("severe", "repeated", "toxic")
SLOTS = 1 << 16


def words_and_stems(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of all words, then of the stems of longer words; the last three bits say
    which (0: words, then the lengths of stems)."""
    size = words.ends - words.starts
    hashes, rows = [words.hashes & ~U(7)], [words.row]
    at, stem, done = np.arange(len(size)), np.zeros(len(size), U), 0
    for family, n in enumerate(STEMS, 1):
        on = size[at] > n
        at, stem = at[on], stem[on]
        for j in range(done, n):
            stem = stem * ODD + BY_LETTERS[words.data[words.starts[at] + j]]
        done = n
        hashes.append(mix(stem) & ~U(7) | U(family))
        rows.append(words.row[at])
    return np.concatenate(hashes), np.concatenate(rows)


@dataclass
class Chain:
    terms: np.ndarray = field(default_factory=lambda: np.zeros(0, U))  # sorted word hashes
    models: list[np.ndarray] = field(default_factory=list)
    threshold: float = 1.0

    def features(self, hashes: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        x = np.zeros((rows, len(self.terms)))
        if len(self.terms):
            slots = np.zeros(SLOTS, bool)
            slots[(self.terms % U(SLOTS)).astype(np.int64)] = True
            at = np.flatnonzero(slots[(hashes % U(SLOTS)).astype(np.int64)])
            place = np.searchsorted(self.terms, hashes[at]).clip(max=len(self.terms) - 1)
            hit = self.terms[place] == hashes[at]
            x[row[at[hit]], place[hit]] = 1
        return x

    def predict(self, x: np.ndarray) -> np.ndarray:
        """A column per category; each model sees the columns before its own."""
        out = np.zeros((len(x), len(CATEGORIES)))
        for i, w in enumerate(self.models):
            out[:, i] = linear(np.column_stack([x, out[:, :i]]), w)
        return out


def _distinct(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The different words and stems of each row."""
    h, row = words_and_stems(words)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], row[new]


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many rows of a task hold each term, and the sum of their labels."""

    def rows(held: list):
        terms, index = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
        y = np.bincount(index, np.concatenate([y for _, y in held]), len(terms))
        n = np.bincount(index, minlength=len(terms))
        return pa.RecordBatch.from_arrays(
            [pa.array(terms.astype(np.int64)), pa.array(n), pa.array(y)], ["term", "n", "y"]
        )

    held, size = [], 0
    for batch in batches:
        label = batch.column("label").to_numpy()
        for words in hashed_words(batch.column("text"), BY_LETTERS):
            h, row = _distinct(words)
            held.append((h, label[row + words.first]))
            size += len(h)
            if size > 1 << 20:
                yield rows(held)
                held, size = [], 0
    if held:
        yield rows(held)


def _hits(terms: np.ndarray):
    """Per row its label and the places of the terms that it holds."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in hashed_words(batch.column("text"), BY_LETTERS):
                rows = words.last - words.first
                h, row = _distinct(words)
                place = np.searchsorted(terms, h).clip(max=len(terms) - 1)
                on = terms[place] == h
                at = np.searchsorted(row[on], np.arange(rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("label").slice(words.first, rows),
                        pa.ListArray.from_arrays(pa.array(at), pa.array(place[on])),
                    ],
                    ["label", "places"],
                )

    return find


def choose_terms(row: np.ndarray, place: np.ndarray, y: np.ndarray, size: int, used: np.ndarray) -> np.ndarray:
    """Which of `size` candidate terms to use, by the rows that are `used`; row and place say which
    row holds which term. The best term is taken, the rows that hold it are set aside, and so on: a
    term that only goes along with a chosen one is left with no row to speak for it, unless it is
    frequent enough to stand by itself."""
    on = used[row]
    row, place = row[on], place[on]
    by_term = np.argsort(place, kind="stable")
    rows_of, first = row[by_term], np.searchsorted(place[by_term], np.arange(size + 1))
    by_row = np.argsort(row, kind="stable")
    terms_of, start = place[by_row], np.searchsorted(row[by_row], np.arange(len(y) + 1))
    n = np.bincount(place, minlength=size).astype(float)
    with_y = np.bincount(place, y[row], size)
    frequent = np.flatnonzero((with_y >= 0.98 * n) & (n >= 0.05 * y[used].sum() + 5))
    frequent = frequent[np.argsort(-with_y[frequent], kind="stable")]
    chosen, open_rows = [], used.copy()
    while size and len(chosen) < TERMS:
        rate = y[open_rows].mean() if open_rows.any() else 0
        z = (with_y - n * rate) / np.sqrt(n * max(rate, 1e-4) * (1 - rate) + 1e-9)
        z[(n < LEAST_ROWS) | (with_y < PURE * n)] = 0
        best = int(np.argmax(z))
        if z[best] < LEAST_Z:
            break
        chosen.append(best)
        shut = rows_of[first[best] : first[best + 1]]
        shut = shut[open_rows[shut]]
        open_rows[shut] = False
        for i in shut:
            gone = terms_of[start[i] : start[i + 1]]
            n[gone] -= 1
            with_y[gone] -= y[i]
    return np.unique(np.array([*chosen, *frequent], np.int64)[:TERMS])


def dense(row: np.ndarray, place: np.ndarray, rows: int, chosen: np.ndarray) -> np.ndarray:
    x = np.zeros((rows, len(chosen)))
    if len(chosen):
        at = np.searchsorted(chosen, place).clip(max=len(chosen) - 1)
        on = chosen[at] == place
        x[row[on], at[on]] = 1
    return x


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label: str) -> Chain:
    stage = Stage(docs.sparkSession)
    known = stage.put(labelled(labels, label, SAMPLE, id_col), "labels")
    rows = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))
    # At most SAMPLE pairs of numbers.
    sample = rows.join(F.broadcast(known), "id").select("label", "text")
    sample = spread(stage.put(sample, "sample"))
    many, rate = sample.agg(F.count("*"), F.avg("label")).first()
    if not many or rate in (0.0, 1.0):
        return Chain()
    counts = sample.mapInArrow(_term_counts, "term long, n long, y double")
    counts = counts.groupBy("term").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    z = (F.col("y") - F.col("n") * rate) / F.sqrt(F.col("n") * (rate * (1 - rate)))
    best = counts.withColumn("z", z).filter((F.col("n") >= LEAST_ROWS) & (F.col("z") >= LEAST_Z))
    # Purity is asked of the rows learned from only, so that the folds left out can speak against a term.
    best = best.filter(F.col("y") >= 0.5 * F.col("n"))
    best = best.orderBy(F.desc("z"), "term").limit(CANDIDATES).select("term").toArrow()
    terms = np.sort(best.column("term").to_numpy().astype(U))
    if not len(terms):
        return Chain()
    data = sample.mapInArrow(_hits(terms), "label double, places array<long>").toArrow()
    y = np.array(data.column("label").to_pylist(), float)
    lists = data.column("places").combine_chunks()
    place = lists.flatten().to_numpy().astype(np.int32)
    row = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(lists.offsets.to_numpy()))
    chosen = choose_terms(row, place, y, len(terms), np.ones(len(y), bool))
    if not len(chosen):
        return Chain()
    chain, x = Chain(terms[chosen]), dense(row, place, len(y), chosen)
    fold = np.random.default_rng(0).permutation(len(y)) % FOLDS
    of_fold = [choose_terms(row, place, y, len(terms), fold != k) for k in range(FOLDS)]
    # All chosen terms are found in toxic documents only, but for one row in ten.
    family = (chain.terms & U(7)).astype(int)
    mentions = np.max([x[:, family == f].sum(axis=1) for f in range(len(STEMS) + 1)], axis=0)
    targets = (y * (mentions >= 3), y * (mentions >= 2), y)
    out_of_fold = np.zeros((len(y), 0))
    for target in targets:
        seen = np.column_stack([x, out_of_fold])
        p = np.zeros(len(y))
        for k in range(FOLDS):
            with_k = np.column_stack([dense(row, place, len(y), of_fold[k]), out_of_fold])
            p[fold == k] = linear(with_k[fold == k], logistic(with_k[fold != k], target[fold != k]))
        chain.models.append(logistic(seen, target))
        out_of_fold = np.column_stack([out_of_fold, p])
    chain.threshold = best_threshold(out_of_fold[:, -1], y)
    return chain


def _scorer(sent):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain: Chain = sent.value
        for batch in batches:
            p = np.zeros((batch.num_rows, len(CATEGORIES)))
            for words in hashed_words(batch.column("_text"), BY_LETTERS):
                x = chain.features(*words_and_stems(words), words.last - words.first)
                p[words.first : words.last] = chain.predict(x)
            kept = [c for c in batch.schema.names if c != "_text"]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in kept),
                    *(pa.array(p[:, i].copy()) for i in range(len(CATEGORIES))),
                    pa.array(p[:, -1] >= chain.threshold),
                ],
                [*kept, *(f"_{c}" for c in CATEGORIES), "_reject"],
            )

    return score


def _scored(df: DataFrame, text: str, chain: Chain) -> DataFrame:
    sent = df.sparkSession.sparkContext.broadcast(chain)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    more = ", ".join(f"_{c} double" for c in CATEGORIES)
    marked = spread(df.withColumn("_text", whole(text)))
    return marked.mapInArrow(_scorer(sent), f"{schema}, {more}, _reject boolean")


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label: str = "toxic",
) -> DataFrame:
    """One row per row: id, the probability of each category, and the decision `toxic`."""
    small_batches(docs.sparkSession)
    chain = fit(docs, labels, id_col, text_col, label)
    rows = docs.select(F.col(id_col).alias("c0"), F.col(text_col).alias("t"))
    marked = rows.select("c0", whole("t").alias("_text"))
    sent = docs.sparkSession.sparkContext.broadcast(chain)
    kind = rows.schema["c0"].dataType.simpleString()
    more = ", ".join(f"_{c} double" for c in CATEGORIES)
    out = spread(marked).mapInArrow(_scorer(sent), f"c0 {kind}, {more}, _reject boolean")
    return out.select(
        F.col("c0").alias(id_col),
        *(F.col(f"_{c}").alias(f"p_{c}") for c in CATEGORIES),
        F.col("_reject").alias("toxic"),
    )


def harmless(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label: str = "toxic",
) -> DataFrame:
    """The rows that are not toxic, with all their columns."""
    small_batches(docs.sparkSession)
    chain = fit(docs, labels, id_col, text_col, label)
    columns = docs.columns
    renamed = docs.toDF(*(f"c{i}" for i in range(len(columns))))
    out = _scored(renamed, f"c{columns.index(text_col)}", chain).filter(~F.col("_reject"))
    return out.select(*renamed.columns).toDF(*columns)
