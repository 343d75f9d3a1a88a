"""Bigram scores from a log-frequency Bloom filter.

Counting: each task counts the hashed words and word pairs of its training texts and hands the sums
on by parts of the key space; a part adds them up and writes its piece of the filter, in which a
count c leaves the marks 1 to 1 + floor(log2 c) of its key. The pieces together are the filter; it
grows with the corpus and is sent to the tasks shard by shard, each of at most SHARD_BYTES: word
counts go into the first, and each further shard only adds the pairs that it holds, so that the
scores do not depend on how many shards there are.

Scoring: a key's marks are probed until one is missing, which gives its count up to a factor below
two. A pair counts as no more than either of its words, so one with an absent word is absent, too.
p(w | v) = 0.7 c(vw) / c(v) + 0.3 (c(w) + 0.1) / (N + 0.1 (V + 1)); a text starts after an end.

The base score needs exact word counts. Those of the most frequent words (at most HOT_WORDS, found
by a threshold on the count) are sent to all tasks; a text's other words are joined with the table
of counts by their key.

Rows
    null and empty texts are one end token. A null id trains. Repeated rows train and are scored as
    often as they occur. Without training texts N and V are 0. Words are compared by a 64-bit hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_search.llm.tables import Stage, held_out, spread, whole
from corpus_search.llm.words import BY_BLANKS, ODD, U, Words, hashed_words, mix

FOLDS = 10
#: An absent key seems present with a chance of (1 - exp(-7 / 12)) ** 7, one in 300.
PROBES = 7
BITS_PER_MARK = 12
PART_BYTES = 32 << 20
SHARD_BYTES = 256 << 20
HOT_WORDS = 2_000_000
FLUSH = 1 << 20
KEEP, ADD = 0.7, 0.1
END = mix(np.array([0x656E64], U))[0]


def with_ends(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of a block's rows, each row closed by an end; and the row of each."""
    rows = words.last - words.first
    n = np.bincount(words.row, minlength=rows)
    tokens = np.full(len(words.hashes) + rows, END, U)
    ends = np.cumsum(n + 1) - 1
    inside = np.ones(len(tokens), bool)
    inside[ends] = False
    tokens[inside] = words.hashes
    return tokens, np.repeat(np.arange(rows), n + 1)


def pairs(tokens: np.ndarray) -> np.ndarray:
    """The key of each token with the one before it; the first comes after an end."""
    before = np.concatenate([[END], tokens[:-1]])
    return mix(before * U(0xD1B54A32D192ED03) + tokens + U(1))


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> U(32)) % U(parts)).astype(np.int64)


def marks(keys: np.ndarray, level: int, probe: int) -> np.ndarray:
    return mix(keys + U((level * 16 + probe) * int(ODD) % 2**64))


def levels(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log2(counts)).astype(np.int64)


def _sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(len(keys) > 0, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts[:0]


def _counter(parts: int):
    """Counts of the training texts of a task, as a row per part and about a million tokens."""

    def rows(kind: int, keys: np.ndarray):
        keys, counts = _sums(keys, np.ones(len(keys), np.int64))
        part = part_of(keys, parts)
        order = np.argsort(part, kind="stable")
        keys, counts, part = keys[order], counts[order].astype("<u4"), part[order]
        at = np.flatnonzero(np.append(len(part) > 0, part[1:] != part[:-1]))
        ends = np.append(at[1:], len(part))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(part[at]),
                pa.array(np.full(len(at), kind)),
                pa.array([keys[a:b].tobytes() for a, b in zip(at, ends, strict=True)], pa.binary()),
                pa.array([counts[a:b].tobytes() for a, b in zip(at, ends, strict=True)], pa.binary()),
            ],
            ["part", "kind", "keys", "counts"],
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], []]
        size = 0
        for batch in batches:
            for words in hashed_words(batch.column("text"), BY_BLANKS):
                tokens, _ = with_ends(words)
                held[0].append(tokens)
                held[1].append(pairs(tokens))
                size += len(tokens)
                if size >= FLUSH:
                    for kind in (0, 1):
                        yield from rows(kind, np.concatenate(held[kind]))
                    held, size = [[], []], 0
        if size:
            for kind in (0, 1):
                yield from rows(kind, np.concatenate(held[kind]))

    return count


def _filter(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The packed bits of one piece of the filter."""
    level = levels(counts) if len(counts) else counts
    size = max(64, -(-int(level.sum()) * BITS_PER_MARK // 8) * 8)
    bits = np.zeros(size, bool)
    for q in range(1, int(level.max(initial=0)) + 1):
        some = keys[level >= q]
        for j in range(PROBES):
            bits[(marks(some, q, j) % U(size)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little")


def _builder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per part: the word counts, and a piece of the filter for words and one for pairs."""
    held: dict[tuple[int, int], list] = {}
    fresh: dict[tuple[int, int], int] = {}
    for batch in batches:
        for r in batch.to_pylist():
            at = (r["part"], r["kind"])
            keys = np.frombuffer(r["keys"], U)
            held.setdefault(at, []).append((keys, np.frombuffer(r["counts"], "<u4").astype(np.int64)))
            fresh[at] = fresh.get(at, 0) + len(keys)
            if fresh[at] > FLUSH:
                held[at] = [_sums(*(np.concatenate(x) for x in zip(*held[at], strict=True)))]
                fresh[at] = 0
    for (part, kind), found in held.items():
        keys, counts = _sums(*(np.concatenate(x) for x in zip(*found, strict=True)))
        bits = _filter(keys, counts)
        word = kind == 0
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([part], pa.int64()),
                pa.array([kind], pa.int64()),
                pa.array([len(keys)], pa.int64()),
                pa.array([int(counts.sum())], pa.int64()),
                pa.array([len(bits)], pa.int64()),
                pa.array([bits.tobytes()], pa.binary()),
                pa.array([keys.astype("<i8").tolist() if word else []], pa.list_(pa.int64())),
                pa.array([counts.tolist() if word else []], pa.list_(pa.int64())),
            ],
            ["part", "kind", "distinct", "total", "bytes", "bits", "keys", "counts"],
        )


class Pieces:
    """Pieces of the filter for keys of one kind; a part without a piece holds nothing."""

    def __init__(self, parts: int, pieces: dict[int, bytes]):
        self.parts = parts
        self.size, self.base = np.zeros(parts, np.int64), np.zeros(parts, np.int64)
        at = 0
        for p, bits in pieces.items():
            self.base[p], self.size[p] = at, 8 * len(bits)
            at += 8 * len(bits)
        self.bits = np.frombuffer(b"".join(pieces.values()), np.uint8)

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """About the middle of the range of counts that leave the marks found; 0 without a mark."""
        keys, back = np.unique(keys, return_inverse=True)
        part = part_of(keys, self.parts)
        level = np.zeros(len(keys), np.int64)
        alive = np.flatnonzero(self.size[part] > 0)
        q = 0
        while len(alive):
            q += 1
            for j in range(PROBES):
                p = part[alive]
                at = self.base[p] + (marks(keys[alive], q, j) % self.size[p].astype(U)).astype(np.int64)
                alive = alive[(self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
            level[alive] = q
        return np.where(level > 1, 1.4 * 2.0 ** (level - 1), level.astype(float))[back]


def _probabilities(tokens: np.ndarray, words: Pieces, pairs_held: Pieces, divisor: float):
    """Each token's probability after the one before it, and the part of it without the pair."""
    c1 = words.counts(tokens)
    # Each row is closed by an end, which comes before the first token of the next one.
    before = np.concatenate([words.counts(np.array([END])), c1[:-1]])
    c2 = np.minimum(pairs_held.counts(pairs(tokens)), np.minimum(before, c1))
    low = (1 - KEEP) * (c1 + ADD) / divisor
    return low + KEEP * c2 / np.maximum(before, 1), low


def _lookup(keys: np.ndarray, counts: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Counts by sorted keys; -1 for a key that is not there."""
    if not len(keys):
        return np.full(len(of), -1)
    at = np.searchsorted(keys, of).clip(max=len(keys) - 1)
    return np.where(keys[at] == of, counts[at], -1)


def _more(batch: pa.RecordBatch, words: Words):
    """What further shards have added to the rows of a block."""
    at = batch.schema.get_field_index("more")
    return batch.column(at).to_numpy()[words.first : words.last] if at >= 0 else 0.0


def _scorer(hot, words_sent, pairs_sent, total: int, distinct: int, least: int):
    divisor = total + ADD * (distinct + 1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row_number = TaskContext.get().partitionId() << 40
        hot_keys, hot_counts = hot.value
        word_pieces, pair_pieces = words_sent.value, pairs_sent.value
        for batch in batches:
            for words in hashed_words(batch.column("text"), BY_BLANKS):
                rows = words.last - words.first
                tokens, row = with_ends(words)
                n = np.bincount(row, minlength=rows)
                exact = _lookup(hot_keys, hot_counts, tokens)
                if least <= 1:
                    exact[exact < 0] = 0  # all training words are among the hot ones
                there = exact >= 0
                logs = np.bincount(row[there], np.log10(exact[there] + ADD), rows)
                known = np.bincount(row[exact > 0], minlength=rows)
                rare = np.flatnonzero(~there)
                offsets = np.searchsorted(row[rare], np.arange(rows + 1)).astype(np.int32)
                p, _ = _probabilities(tokens, word_pieces, pair_pieces, divisor)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row_number + np.arange(rows)),
                        batch.column("id").slice(words.first, rows),
                        batch.column("held_out").slice(words.first, rows),
                        pa.array(n),
                        pa.array(known),
                        pa.array(logs - n * math.log10(divisor)),
                        pa.array(np.bincount(row, np.log10(p), rows) + _more(batch, words)),
                        pa.ListArray.from_arrays(
                            pa.array(offsets), pa.array(tokens[rare].astype(np.int64))
                        ),
                    ],
                    ["row", "id", "held_out", "n_tokens", "n_known", "base", "score", "rare"],
                )
                row_number += rows

    return score


def _shard(sent, words_sent, total: int, distinct: int):
    """Adds what the pairs of one more shard change."""
    divisor = total + ADD * (distinct + 1)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            more = np.zeros(batch.num_rows)
            for words in hashed_words(batch.column("text"), BY_BLANKS):
                rows = words.last - words.first
                tokens, row = with_ends(words)
                p, low = _probabilities(tokens, words_sent.value, sent.value, divisor)
                more[words.first : words.last] = np.bincount(row, np.log10(p / low), rows)
            at = batch.schema.get_field_index("more")
            yield batch.set_column(at, "more", pa.array(batch.column(at).to_numpy() + more))

    return add


def _shards(pieces: DataFrame, most: int) -> list[list[int]]:
    """The parts whose pieces go into a shard of at most `most` bytes, from their sizes alone."""
    out, size = [[]], 0
    for r in pieces.filter("kind = 1").select("part", "bytes").orderBy("part").toLocalIterator():
        if out[-1] and size + r["bytes"] > most:
            out.append([])
            size = 0
        out[-1].append(r["part"])
        size += r["bytes"]
    return out


def score(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    hot_words: int = HOT_WORDS,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    spark = docs.sparkSession
    stage = Stage(spark)
    send = spark.sparkContext.broadcast
    rows = docs.select(
        F.col(id_col).alias("id"), held_out(id_col, FOLDS).alias("held_out"), whole(text_col).alias("text")
    )
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(8, math.ceil(size / PART_BYTES))
    rows = spread(rows)
    counted = rows.filter("not held_out").select("text").mapInArrow(
        _counter(parts), "part long, kind long, keys binary, counts binary"
    )
    tasks = max(parts, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pieces = stage.put(
        counted.repartition(tasks, "part").mapInArrow(
            _builder,
            "part long, kind long, distinct long, total long, bytes long, bits binary, "
            "keys array<long>, counts array<long>",
        ),
        "pieces",
    )
    words = pieces.filter("kind = 0")
    sums = words.agg(F.sum("total").alias("n"), F.sum("distinct").alias("v")).first()
    total, distinct = sums["n"] or 0, sums["v"] or 0
    table = words.select(F.explode(F.arrays_zip("keys", "counts")).alias("w")).select(
        F.col("w.keys").alias("key"), F.col("w.counts").alias("count")
    )
    # Powers of two from which on at most `hot_words` words are left.
    by_level = table.groupBy(F.floor(F.log2("count")).alias("level")).count().orderBy(F.desc("level"))
    least, many = 1 << 62, 0
    for r in by_level.collect():  # a row per power of two
        many += r["count"]
        if many > hot_words:
            break
        least = 1 << r["level"]
    hot = table.filter(F.col("count") >= least).toArrow()
    keys = hot.column("key").to_numpy().astype(U)
    order = np.argsort(keys)
    hot_sent = send((keys[order], hot.column("count").to_numpy()[order]))
    get = lambda some: {r["part"]: bytes(r["bits"]) for r in some.select("part", "bits").toLocalIterator()}
    words_sent = send(Pieces(parts, get(words)))
    shards = _shards(pieces, shard_bytes)
    of = lambda s: send(Pieces(parts, get(pieces.filter((F.col("kind") == 1) & F.col("part").isin(s)))))
    kind = rows.schema["id"].dataType.simpleString()
    out_schema = (
        f"row long, id {kind}, held_out boolean, n_tokens long, n_known long, base double, "
        "score double, rare array<long>"
    )
    scorer = _scorer(hot_sent, words_sent, of(shards[0]), total, distinct, least)
    for shard in shards[1:]:
        adder = _shard(of(shard), words_sent, total, distinct)
        rows = rows if "more" in rows.columns else rows.withColumn("more", F.lit(0.0))
        rows = rows.mapInArrow(adder, f"id {kind}, held_out boolean, text string, more double")
    out = stage.put(rows.mapInArrow(scorer, out_schema), "scores")
    if least > 1:
        rare = out.select("row", F.explode("rare").alias("key"))
        rare = rare.groupBy("row", "key").agg(F.count("*").alias("times"))
        exact = rare.join(table.filter(F.col("count") < least), "key", "left")
        more = exact.groupBy("row").agg(
            F.sum(F.col("times") * F.log10(F.coalesce("count", F.lit(0)) + ADD)).alias("base_more"),
            F.sum(F.when(F.col("count") > 0, F.col("times")).otherwise(0)).alias("known_more"),
        )
        out = out.join(more, "row", "left")
        out = out.withColumn("base", F.col("base") + F.coalesce("base_more", F.lit(0.0)))
        out = out.withColumn("n_known", F.col("n_known") + F.coalesce("known_more", F.lit(0)))
    return out.select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(total).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"),
        "score",
    )
