"""Benchmark decontamination with spaced seeds.

A seed is a fixed mask over neighbouring tokens: the hash of the tokens under it ignores the other
positions, so that a passage of which single tokens were replaced still hits at one of the masks.
The hashes of the benchmark are joined with those of every position of every document; around each
hit the aligned tokens are compared, which accepts replaced tokens and refuses chance hits.

The benchmark side is cut into blocks of a bounded number of tokens. A block is sent to all tasks
and joined there by its sorted hashes; with several blocks the documents are read once per block.

Rows
    null and empty texts hold nothing. Items of fewer than five tokens match nothing (too short to
    tell a leak from chance); of short ones four in five tokens must be found. Repeated items and
    rows are each reported. Tokens are compared in lower case (A-Z), split at ASCII white space.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_search.llm.tables import small_batches, spread, whole
from corpus_search.llm.words import ODD, U, hashed_words, mix

#: Fixed masks (1: the token counts), found by trying all patterns: every stretch of 12 equal tokens
#: or more with one in four replaced is hit by one of them wherever its replaced tokens are, and so is
#: every item of 8 tokens or more. Shorter items have masks of their own.
MASKS = ("11111", "1110111", "111001011", "1100101011", "1100110101")
SHORT_MASKS = ("1111", "11011", "11101", "10111")
SHORTEST, SHORT = 5, 8  # tokens of the shortest item that matches, and of the first one that is not short
#: An overlap counts from this many equal tokens on, if at most one in four of its tokens is replaced.
LEAST = 12
OF_ITEM = 0.8  # or this part of a shorter item
REPLACED = 3
BLOCK_TOKENS = 2_000_000


@dataclass
class Seeds:
    """One block of the benchmark: its tokens, and each mask's hashes sorted, with positions."""

    tokens: np.ndarray
    item: np.ndarray  # index of the item of each token
    begin: np.ndarray  # first token of the item of each token
    end: np.ndarray
    hashes: np.ndarray
    position: np.ndarray
    ids: list
    masks: tuple[str, ...]  # those that some item needs


def seed_hashes(tokens: np.ndarray, mask: str) -> np.ndarray:
    n = max(0, len(tokens) - len(mask) + 1)
    h = np.zeros(n, U)
    for j, bit in enumerate(mask):
        if bit == "1":
            h = h * U(0x9FB21C651E98DF25) + tokens[j : j + n]
    return mix(h ^ U(int(mask, 2)))


def seeds(texts: list[str], ids: list) -> Seeds:
    parts = list(hashed_words(pa.array(texts, pa.string())))
    empty = np.zeros(0, np.int64)
    tokens = np.concatenate([p.hashes for p in parts] or [np.zeros(0, U)])
    item = np.concatenate([p.row + p.first for p in parts] or [empty])
    bounds = np.searchsorted(item, np.arange(len(texts) + 1))
    begin, end = bounds[item], bounds[item + 1]
    hashes, position = [], []
    size = end - begin
    masks = MASKS + SHORT_MASKS * bool(((size >= SHORTEST) & (size < SHORT)).any())
    for mask in masks:
        h = seed_hashes(tokens, mask)
        fits = (size >= SHORTEST) & (size < (SHORT if mask in SHORT_MASKS else np.inf))
        at = np.flatnonzero((item[: len(h)] == item[len(mask) - 1 :][: len(h)]) & fits[: len(h)])
        hashes.append(h[at])
        position.append(at)
    h, at = np.concatenate(hashes), np.concatenate(position)
    order = np.argsort(h, kind="stable")
    return Seeds(tokens, item, begin, end, h[order], at[order], list(ids), masks)


def _runs(hit: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each hit repeated, with the numbers 0, 1, ... of its matches."""
    index = np.repeat(np.arange(len(hit)), count)
    return index, np.arange(len(index)) - np.repeat(np.cumsum(count) - count, count)


def overlaps(tokens: np.ndarray, row: np.ndarray, rows: int, seeds: Seeds, bloom: np.ndarray):
    """(row, item, equal tokens, aligned tokens) of the verified overlaps of a block of texts."""
    found = []
    bounds = np.searchsorted(row, np.arange(rows + 1))
    for mask in seeds.masks:
        h = seed_hashes(tokens, mask)
        at = np.flatnonzero(bloom[(h & U(len(bloom) - 1)).astype(np.int64)])
        at = at[row[at] == row[at + len(mask) - 1]]
        lo = np.searchsorted(seeds.hashes, h[at], "left")
        n = np.searchsorted(seeds.hashes, h[at], "right") - lo
        index, k = _runs(at, n)
        found.append(np.stack([at[index], seeds.position[lo[index] + k]]))
    text_at, item_at = np.concatenate(found, axis=1)
    if not len(text_at):
        return np.zeros((4, 0), np.int64)
    # A diagonal of an item in a text is compared once, however many seeds hit it.
    diagonal = text_at - item_at
    pair = row[text_at] * len(seeds.ids) + seeds.item[item_at]
    order = np.lexsort((diagonal, pair))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(pair[order]) != 0) | (np.diff(diagonal[order]) != 0)
    out = []
    for i in order[new]:
        r, begin, end = row[text_at[i]], seeds.begin[item_at[i]], seeds.end[item_at[i]]
        shift = diagonal[i]
        low, high = max(begin, bounds[r] - shift), min(end, bounds[r + 1] - shift)
        same = tokens[low + shift : high + shift] == seeds.tokens[low:high]
        equal, length = _best(same)
        if equal >= min(LEAST, OF_ITEM * (end - begin)):
            out.append((r, seeds.item[item_at[i]], equal, length))
    return np.array(out, np.int64).reshape(-1, 4).T


def _best(same: np.ndarray) -> tuple[int, int]:
    """The stretch with the most equal tokens among those that have at least three in four equal
    (a sum of one for an equal token and minus three for another that is not below zero), without
    replaced tokens at its ends: its equal tokens and its length."""
    total = np.concatenate([[0], np.cumsum(np.where(same, 1, -REPLACED))])
    good = np.concatenate([[0], np.cumsum(same)])
    # For each end the first begin with a sum that is no larger.
    begin = np.searchsorted(-np.minimum.accumulate(total), -total)
    equal = good - good[begin]
    end = int(np.argmax(equal))
    inside = np.flatnonzero(same[begin[end] : end])
    return int(equal[end]), int(inside[-1] - inside[0] + 1) if len(inside) else 0


def _bloom(seeds: Seeds) -> np.ndarray:
    bits = 1 << max(16, int(max(1, len(seeds.hashes)) * 8).bit_length())
    bloom = np.zeros(bits, bool)
    bloom[(seeds.hashes & U(bits - 1)).astype(np.int64)] = True
    return bloom


def _scan(block, flags: bool):
    """Batches with a flag per row, or with a row per overlap."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = block.value
        bloom = _bloom(known)
        for batch in batches:
            columns = batch.schema.names
            hit = np.zeros(batch.num_rows, bool)
            for words in hashed_words(batch.column("_text")):
                rows = words.last - words.first
                r, item, equal, length = overlaps(words.hashes, words.row, rows, known, bloom)
                hit[r + words.first] = True
                if not flags:
                    ids = batch.column("id").take(pa.array(r + words.first))
                    items = pa.array([known.ids[i] for i in item], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [ids, items, pa.array(equal), pa.array(length)],
                        ["id", "item_id", "equal", "aligned"],
                    )
            if flags:
                kept = [c for c in columns if c != "_text"]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in kept), pa.array(hit)], [*kept, "_leak"]
                )

    return scan


def blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[Seeds]:
    """The benchmark, a bounded number of tokens at a time."""
    rows = benchmark.select(F.col(item_col).cast("long").alias("i"), whole(text_col).alias("t"))
    texts, ids, size = [], [], 0
    for r in rows.toLocalIterator():  # one partition of the benchmark at a time
        texts.append(r["t"])
        ids.append(r["i"])
        size += len(r["t"]) // 2 + 1
        if size >= BLOCK_TOKENS:
            yield seeds(texts, ids)
            texts, ids, size = [], [], 0
    if texts:
        yield seeds(texts, ids)


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(id, item_id, equal, aligned): the best overlap of each document with each item."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = spread(docs.select(F.col(id_col).alias("id"), whole(text_col).alias("_text")))
    kind = rows.schema["id"].dataType.simpleString()
    out = spark.createDataFrame([], f"id {kind}, item_id long, equal long, aligned long")
    for block in blocks(benchmark, item_col, item_text_col):
        sent = spark.sparkContext.broadcast(block)
        out = out.unionAll(rows.mapInArrow(_scan(sent, False), out.schema))
    best = out.groupBy("id", "item_id").agg(F.max(F.struct("equal", "aligned")).alias("best"))
    return best.select(
        F.col("id").alias(id_col),
        F.col("item_id").alias(item_col),
        F.col("best.equal").alias("equal_tokens"),
        F.col("best.aligned").alias("aligned_tokens"),
    )


def clean(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """The rows of `docs` that hold no passage of the benchmark, with all their columns."""
    spark = docs.sparkSession
    small_batches(spark)
    columns = docs.columns
    out = docs.toDF(*(f"c{i}" for i in range(len(columns))))
    text = f"c{columns.index(text_col)}"
    for block in blocks(benchmark, item_col, item_text_col):
        sent = spark.sparkContext.broadcast(block)
        marked = out.withColumn("_text", whole(text))
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out.schema)
        out = marked.mapInArrow(_scan(sent, True), f"{schema}, _leak boolean")
        out = out.filter(~F.col("_leak")).drop("_leak")
    return out.toDF(*columns)
