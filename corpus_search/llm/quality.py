"""Document quality from random-indexing word vectors and a small neural network.

Random indexing: each word and each word shape has a sparse random index vector given by its hash;
its context vector is the sum of the index vectors of its neighbours over all documents. Words share
a fixed number of hashed rows, so the table of vectors (VECTORS x WIDTH) has one size whatever the
corpus; tasks add up their own tables, and the parts are added row block by row block. A document is
the mean of its words' vectors, of its shapes' vectors, and their spread over the document's eighths;
a two-layer network scores it, and a temperature fitted on held-back rows calibrates the score.

Labels come from a bounded sample (SAMPLE) of the rows that the fold rule allows; labels, language,
source and id are no inputs of a score.

Rows
    null and empty texts are the zero vector and are scored like any other. Labels with a null id or
    value are left out. Without labels of both kinds every score is the labels' rate, or 0.5.
    Repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_search.llm.samples import labelled, sigmoid
from corpus_search.llm.tables import Stage, held_out, spread, whole
from corpus_search.llm.words import BY_BLANKS, ODD, U, Words, hashed_words, mix

VECTORS, WIDTH, BLOCK_ROWS = 1 << 14, 64, 32
REACH = 2
PARTS = 8
SAMPLE = 20_000
HIDDEN = 32
THRESHOLD = 0.3

#: Classes of bytes for shapes: small letters (and all beyond ASCII), capitals, digits, and each
#: other character by itself.
_CLASS = np.arange(256)
_CLASS[97:123] = 97
_CLASS[128:] = 97
_CLASS[65:91] = 65
_CLASS[48:58] = 48


def streams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of each word and of its shape. A shape is the set of changes of class within a
    word, and whether the word repeats the one before it."""
    if not len(words.hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _CLASS[words.data]
    change = np.zeros(len(kind), U)
    change[0] = 1
    moved = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    change[moved] = mix((kind[moved - 1] * 256 + kind[moved] + 1).astype(U) * ODD)
    change[words.starts] = mix(kind[words.starts].astype(U) + U(7)) | U(1)
    inside = np.zeros(len(kind) + 1, np.int8)
    np.add.at(inside, words.starts, 1)
    np.add.at(inside, words.ends, -1)
    change[np.cumsum(inside[:-1]) == 0] = 0
    shape = np.add.reduceat(change, words.starts)
    same = np.zeros(len(shape), bool)
    same[1:] = (words.hashes[1:] == words.hashes[:-1]) & (words.row[1:] == words.row[:-1])
    shape[same] += ODD
    half = VECTORS // 2
    return (
        (words.hashes % U(half)).astype(np.int64),
        (mix(shape) % U(half)).astype(np.int64) + half,
    )


def _index(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position and sign of the one nonzero entry of each index vector."""
    h = mix((rows.astype(U) + U(1)) * ODD)
    return (h % U(WIDTH)).astype(np.int64), 1 - 2 * ((h >> U(40)) & U(1)).astype(np.int64)


def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's table of context vectors, as blocks of rows."""
    total = np.zeros(VECTORS * WIDTH, np.int64)
    for batch in batches:
        for words in hashed_words(batch.column("text"), BY_BLANKS):
            word, shape = streams(words)
            at_word, sign_word = _index(word)
            at_shape, sign_shape = _index(shape)
            keys, signs = [], []
            for d in range(-REACH, REACH + 1):
                a, b = (slice(d, None), slice(None, -d or None)) if d > 0 else (slice(None, d or None), slice(-d, None))
                ok = words.row[a] == words.row[b]
                for mine in (word, shape):
                    for at, sign in ((at_shape, sign_shape), (at_word, sign_word)):
                        if d or mine is word and at is at_shape:
                            keys.append((mine[a] * WIDTH + at[b])[ok])
                            signs.append(sign[b][ok])
            if keys:
                total += np.bincount(
                    np.concatenate(keys), np.concatenate(signs), VECTORS * WIDTH
                ).astype(np.int64)
    block = total.astype("<i8").reshape(-1, BLOCK_ROWS * WIDTH)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.arange(len(block))), pa.array([x.tobytes() for x in block], pa.binary())],
        ["block", "sums"],
    )


def add_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block of those in this partition, added up as they come."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for b, x in zip(batch.column("block").to_pylist(), batch.column("sums"), strict=True):
            x = np.frombuffer(x.as_buffer(), "<i8")
            sums[b] = sums[b] + x if b in sums else x.copy()
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())],
        ["block", "sums"],
    )


def word_vectors(rows: DataFrame) -> np.ndarray:
    """The table of unit context vectors of the whole corpus (one size whatever the corpus)."""
    schema = "block long, sums binary"
    parts = rows.select("text").mapInArrow(contexts, schema)
    blocks = parts.repartition("block").mapInArrow(add_blocks, schema)
    table = np.zeros((VECTORS // BLOCK_ROWS, BLOCK_ROWS * WIDTH))
    for r in blocks.collect():
        table[r["block"]] = np.frombuffer(r["sums"], "<i8")
    table = table.reshape(VECTORS, WIDTH)
    return (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1)).astype(np.float32)


def pooled(words: Words, vectors: np.ndarray) -> np.ndarray:
    """Mean word vector, mean shape vector, and the largest and smallest of each entry of the shape
    means of the document's eighths."""
    rows = words.last - words.first
    out = np.zeros((rows, 4 * WIDTH), np.float32)
    n = np.bincount(words.row, minlength=rows)
    if not n.any():
        return out
    word, shape = streams(words)
    place = np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)
    part = words.row * PARTS + place * PARTS // n[words.row]
    first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    each = np.diff(np.append(first, len(part)))[:, None]
    of = words.row[first]
    has = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    there = of[has]
    size = n[there][:, None]
    shapes = np.add.reduceat(vectors[shape], first, axis=0)
    out[there, WIDTH : 2 * WIDTH] = np.add.reduceat(shapes, has, axis=0) / size
    out[there, 2 * WIDTH : 3 * WIDTH] = np.maximum.reduceat(shapes / each, has, axis=0)
    out[there, 3 * WIDTH :] = np.minimum.reduceat(shapes / each, has, axis=0)
    out[there, :WIDTH] = np.add.reduceat(vectors[word], np.flatnonzero(np.append(True, words.row[1:] != words.row[:-1])), axis=0) / size
    return out


@dataclass
class Network:
    vectors: np.ndarray
    weights: list[np.ndarray]
    shift: np.ndarray
    scale: np.ndarray
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        return np.maximum((x - self.shift) / self.scale @ a + b, 0) @ c + d

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(x) / self.temperature)


def train(x: np.ndarray, y: np.ndarray, vectors: np.ndarray, seed: int = 0, rounds: int = 30) -> Network:
    """Two layers by Adam on nine tenths of the rows; the temperature on the rest."""
    constant = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)) if len(y) else 0.0
    zeros = [np.zeros((x.shape[1], HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.array(constant)]
    net = Network(vectors, zeros, np.zeros(x.shape[1]), np.ones(x.shape[1]))
    if not len(y) or y.min() == y.max():
        return net
    rng = np.random.default_rng(seed)
    back = np.arange(len(y)) % 10 == 0
    fit_x, fit_y = x[~back].astype(np.float64), y[~back]
    net.shift, net.scale = fit_x.mean(axis=0), fit_x.std(axis=0) + 1e-3
    fit_x = (fit_x - net.shift) / net.scale
    w = [
        rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)),
        np.zeros(HIDDEN),
        rng.normal(0, np.sqrt(2 / HIDDEN), HIDDEN),
        np.array(constant),
    ]
    m, v, step = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
    for _ in range(rounds):
        order = rng.permutation(len(fit_y))
        for at in range(0, len(order), 256):
            bx, by = fit_x[order[at : at + 256]], fit_y[order[at : at + 256]]
            hidden = np.maximum(bx @ w[0] + w[1], 0)
            error = (sigmoid(hidden @ w[2] + w[3]) - by) / len(by)
            inner = error[:, None] * w[2] * (hidden > 0)
            slopes = [bx.T @ inner + 1e-4 * w[0], inner.sum(0), hidden.T @ error + 1e-4 * w[2], error.sum()]
            step += 1
            for i, g in enumerate(slopes):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                w[i] = w[i] - 3e-3 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    net.weights = w
    z, t = net.logits(x[back]), y[back]
    loss = [
        -(t * np.log(q) + (1 - t) * np.log(1 - q)).mean()
        for q in (np.clip(sigmoid(z / h), 1e-9, 1 - 1e-9) for h in np.geomspace(0.25, 8, 41))
    ]
    net.temperature = float(np.geomspace(0.25, 8, 41)[int(np.argmin(loss))])
    return net


def _pooler(sent):
    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in hashed_words(batch.column("text"), BY_BLANKS):
                x = pooled(words, sent.value)
                label = batch.column("label").slice(words.first, len(x))
                yield pa.RecordBatch.from_arrays(
                    [label, pa.array([r.tobytes() for r in x], pa.binary())], ["label", "x"]
                )

    return pool


def _scorer(sent):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net: Network = sent.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for words in hashed_words(batch.column("text"), BY_BLANKS):
                out[words.first : words.last] = net.score(pooled(words, net.vectors))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("held_out"), pa.array(out)],
                ["id", "held_out", "score"],
            )

    return score


def quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label: str = "quality",
    folds: int = 5,
) -> DataFrame:
    """One row per row: id, held_out, score and predicted."""
    spark = docs.sparkSession
    Stage(spark)
    rows = docs.select(
        F.col(id_col).alias("id"), held_out(id_col, folds).alias("held_out"), whole(text_col).alias("text")
    )
    rows = spread(rows)
    vectors = word_vectors(rows)
    known = labelled(labels.filter(~held_out(id_col, folds)), label, SAMPLE, id_col)
    sample = rows.join(F.broadcast(known), "id").select("label", "text")  # at most SAMPLE ids
    data = spread(sample).mapInArrow(_pooler(spark.sparkContext.broadcast(vectors)), "label double, x binary").toArrow()
    y = np.array(data.column("label").to_pylist(), float)
    x = np.frombuffer(b"".join(data.column("x").to_pylist()), np.float32).reshape(len(y), 4 * WIDTH)
    sent = spark.sparkContext.broadcast(train(x, y, vectors))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(_scorer(sent), f"id {kind}, held_out boolean, score double")
    return out.select(
        F.col("id").alias(id_col),
        "held_out",
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )
