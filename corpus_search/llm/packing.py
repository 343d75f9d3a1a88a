"""Packing of tokenised documents into sequences of a fixed length.

A document's ids are cut into whole windows and one rest. The histogram of the rests has at most as
many bins as a window has tokens, whatever the corpus, so it is planned on the driver: shallow
combinations of lengths that fill a window exactly are enumerated, non-negative least squares gives
how often each is repeated, the counts are rounded to what is there, and what is left is packed
greedily. The plan (a few rows per combination) goes back to the tasks, where each piece finds its
place by its length and its number among the pieces of that length; numbers are counted per task and
added up, so that a length held by very many pieces is no hot key.

Rows
    null and empty texts are one end id. Repeated rows are packed as often as they occur. Any
    number of rows may have the same or a null id. Texts of any length are cut, none is shortened.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpus_search.llm.tables import Stage, spread, whole

WINDOW = 2048
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
KNOWN_WORDS = 300_000  # the ids of so many words are kept by a task (about 100 MB), then it starts again
PART_BYTES = 2 << 20  # texts are encoded so many bytes at a time

#: Fixed value: how the vocabulary's special tokens begin.
SPECIAL = "<|"
#: A letter without a decomposition, and a sign of ASCII other than the apostrophe.
SIGN_AFTER_LETTER = r"([a-zA-Z\xc0-\xd6\xd8-\xf6\xf8-\x{24f}])([!-&(-/:-@\[-`{-~])"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Known:
    """Ids of the words met so far. A word is a number; its ids are `flat[starts[n] : starts[n + 1]]`.
    New words are encoded together, parted by a mark, which is several times faster than alone."""

    MARK = "\x01"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[str, int] = {}
        self.starts, self.flat = np.zeros(1, np.int64), np.zeros(0, "<u4")

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and all of them."""
        (mark,) = self.tokenizer.encode(self.MARK, add_special_tokens=False).ids
        joined = f" {self.MARK} ".join(words)
        (found,) = self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)
        ids = np.array(found.ids, "<u4")
        at = np.flatnonzero(ids == mark)
        if len(at) == len(words) - 1:
            return np.diff(at, prepend=-1, append=len(ids)) - 1, ids[ids != mark]
        # A word holds the mark.
        each = [one.ids for one in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.array(list(map(len, each))), np.array([i for ids in each for i in ids], "<u4")

    def of(self, words: list[str]) -> np.ndarray:
        """The numbers of different words."""
        if len(self.numbers) > KNOWN_WORDS:
            self.clear()
        known = list(map(self.numbers.get, words))
        new = [word for word, number in zip(words, known, strict=True) if number is None]
        if new:
            coded = [self._encode(new[at : at + 1000]) for at in range(0, len(new), 1000)]
            first = len(self.numbers)
            self.numbers.update(zip(new, range(first, first + len(new)), strict=True))
            sizes = np.concatenate([sizes for sizes, _ in coded])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
            self.flat = np.concatenate([self.flat, *(ids for _, ids in coded)])
            known = map(self.numbers.__getitem__, words)
        return np.fromiter(known, np.int64, len(words))


@cache
def known_words(path: str) -> Known:
    return Known(path)


def _pieces(texts: pa.Array) -> pa.Array:
    """Lists of words that are encoded apart. This vocabulary lower-cases, and no token of it goes
    over white space or from a letter to a sign, so signs after letters (but the apostrophe, which
    begins endings) are words of their own. Its special tokens (`<|...|>`) are matched as they are
    written, so texts that may hold one are only split at blanks."""
    plain = pc.replace_substring(texts, "\n", " ")
    apart = pc.replace_substring_regex(pc.ascii_lower(plain), SIGN_AFTER_LETTER, r"\1 \2")
    return pc.split_pattern(pc.if_else(pc.match_substring(texts, SPECIAL), plain, apart), " ")


def encoded(known: Known, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts one after another, each with the end id, and where each text starts (and
    the last one ends). Only different words are encoded; their ids are put where the words stand."""
    words = _pieces(texts)
    n_words = pc.list_value_length(words).to_numpy()
    coded = words.flatten().dictionary_encode()
    # No word holds a space. One long string is taken over much faster than many short ones.
    joined = pc.binary_join(pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary), " ")
    number = known.of(joined[0].as_py().split(" "))[coded.indices.to_numpy()]
    first = known.starts[number]
    size = known.starts[number + 1] - first

    row = np.repeat(np.arange(len(texts)), n_words)
    ends = np.bincount(row, weights=size, minlength=len(texts)).astype(np.int64) + 1
    starts = np.concatenate([[0], np.cumsum(ends)])
    # A word's ids stand after those of the words and ends before it.
    before = np.cumsum(size) - size
    every = np.arange(int(size.sum()))
    out = np.full(starts[-1], end_id, "<u4")
    out[np.repeat(row, size) + every] = known.flat[np.repeat(first - before, size) + every]
    return out, starts


def _parts(column: pa.Array, most: int = PART_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """The texts of a column, some megabytes at a time, with the number of the first one."""
    size = np.cumsum(pc.binary_length(column).to_numpy())
    at = 0
    while at < len(column):
        done = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, done + most, "right")))
        yield at, column.slice(at, end - at)
        at = end


def cutter(path: str, window: int, end_id: int):
    """Pieces of each text, numbered within the task by their length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, met = TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
        known = known_words(path)
        for batch in batches:
            for at, texts in _parts(batch.column("text")):
                ids, starts = encoded(known, texts, end_id)
                total = np.diff(starts)
                pieces = -(-total // window)
                row = np.repeat(np.arange(len(texts)), pieces)
                start = window * (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
                length = np.minimum(window, total[row] - start)
                first = starts[row] + start
                buffer = memoryview(ids).cast("B")
                crc = [
                    zlib.crc32(buffer[4 * a : 4 * (a + n)])
                    for a, n in zip(first.tolist(), length.tolist(), strict=True)
                ]
                number = _numbers(length, met)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(pa.array(at + row)),
                        *(pa.array(x, pa.int64()) for x in (start, length, crc, total[row], number)),
                        pa.array(np.full(len(row), task, np.int64)),
                    ],
                    ["id", "start", "length", "crc", "total", "number", "task"],
                )

    return cut


def _numbers(length: np.ndarray, met: np.ndarray) -> np.ndarray:
    """Each piece's number among those of its length; `met` counts on."""
    order = np.argsort(length, kind="stable")
    many = np.bincount(length, minlength=len(met))
    number = np.empty(len(length), np.int64)
    number[order] = np.arange(len(length)) - np.repeat(np.cumsum(many) - many, many)
    number += met[length]
    met += many
    return number


def combinations(lengths: np.ndarray, counts: np.ndarray, window: int) -> np.ndarray:
    """Combinations of two, three or four of the lengths that fill a window (rows padded by 0)."""
    there = np.zeros(window + 1, bool)
    there[lengths] = True
    spreaded = np.unique(
        lengths[np.searchsorted(np.cumsum(counts), np.linspace(0, counts.sum() - 1, 48), "right")]
    )
    few = spreaded[:: max(1, len(spreaded) // 12)]

    def close(parts: np.ndarray) -> np.ndarray:
        rest = window - parts.sum(axis=1)
        ok = (rest > 0) & (rest < window)
        ok[ok] = there[rest[ok]]
        full = np.zeros((int(ok.sum()), 4), np.int64)
        full[:, : parts.shape[1]] = parts[ok]
        full[:, parts.shape[1]] = rest[ok]
        return full

    a = lengths[:, None]
    two = close(a)
    grid = np.array([(x, y) for x in lengths for y in spreaded]).reshape(-1, 2)
    three = close(grid)
    grid = np.array([(x, y, z) for x in lengths for y in few for z in few if y <= z])
    four = close(grid.reshape(-1, 3))
    return np.unique(np.sort(np.concatenate([two, three, four]), axis=1), axis=0)


def least_squares(combos: np.ndarray, counts: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - counts|, by multiplicative updates; A has one
    column per combination and is only held as `combos`."""
    wanted = np.append(0.0, counts[1:].astype(float))
    real = combos > 0
    up = (wanted[combos] * real).sum(axis=1)
    x = np.full(len(combos), max(1e-9, counts.sum() / max(1, 3 * len(combos))))
    for _ in range(rounds):
        made = np.bincount(combos.ravel(), np.repeat(x, 4) * real.ravel(), len(counts))
        x *= up / np.maximum((made[combos] * real).sum(axis=1), 1e-12)
    return x


def plan(counts: np.ndarray, window: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first, last, each, sequence, offset): the pieces of a length numbered from
    `first` to `last` - 1 go, `each` at a time, to the sequences from `sequence` on, at `offset`."""
    left = counts.astype(np.int64).copy()
    next_number = np.zeros_like(left)
    rows, sequence = [], 0

    def use(parts: dict[int, int], times: int) -> None:
        nonlocal sequence
        offset = 0
        for length, each in parts.items():
            first = int(next_number[length])
            rows.append((length, first, first + times * each, each, sequence, offset))
            next_number[length] += times * each
            left[length] -= times * each
            offset += length * each
        sequence += times

    if left[window]:
        use({window: 1}, int(left[window]))
    lengths = np.flatnonzero(left)
    if len(lengths):
        combos = combinations(lengths, left[lengths], window)
        x = least_squares(combos, left) if len(combos) else np.zeros(0)
        for i in np.argsort(-x, kind="stable"):
            if x[i] < 0.5:
                break
            values, each = np.unique(combos[i][combos[i] > 0], return_counts=True)
            times = int(min(round(x[i]), (left[values] // each).min()))
            if times:
                use({int(v): int(e) for v, e in zip(values, each, strict=True)}, times)
    while (lengths := np.flatnonzero(left)).size:
        parts, room = {}, window
        while room and (fit := lengths[lengths <= room]).size:
            free = fit[left[fit] > np.array([parts.get(int(v), 0) for v in fit])]
            if not free.size:
                break
            v = int(free[-1])
            each = int(min(left[v] - parts.get(v, 0), room // v))
            parts[v] = parts.get(v, 0) + each
            room -= v * each
            lengths = lengths[lengths < v]
        use(parts, int(min(left[v] // e for v, e in parts.items())))
    return rows


def pack(
    docs: DataFrame,
    path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    end_id: int = END_ID,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    stage = Stage(spark)
    rows = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    pieces = stage.put(
        spread(rows).mapInArrow(
            cutter(path or tokenizer_path(TOKENIZER), window, end_id),
            f"id {kind}, start long, length long, crc long, total long, number long, task long",
        ),
        "pieces",
    )
    per_task = stage.put(
        pieces.groupBy("length", "task").agg(F.count("*").alias("n")), "per_task"
    )
    counts = np.zeros(window + 1, np.int64)
    for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a bin per length
        counts[r["length"]] = r["n"]
    slots = spark.createDataFrame(
        plan(counts, window) or [(0, 0, 0, 1, 0, 0)],
        "length long, first long, last long, each long, sequence long, at long",
    )
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    per_task = per_task.select(
        "length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")
    )
    ranked = pieces.join(per_task, ["length", "task"]).withColumn(
        "rank", F.col("number") + F.col("before")
    )
    # The plan has a few rows per combination and at most some ten thousand in all.
    placed = ranked.join(
        F.broadcast(slots), (ranked["length"] == slots["length"]) & F.expr("rank >= first and rank < last")
    )
    inside = F.col("rank") - F.col("first")
    return placed.select(
        F.col("id").alias(id_col),
        "start",
        pieces["length"],
        F.col("crc").alias("ids_crc32"),
        F.col("total").alias("doc_tokens"),
        (F.col("sequence") + F.floor(inside / F.col("each"))).alias("sequence_id"),
        (F.col("at") + inside % F.col("each") * pieces["length"]).alias("offset"),
    )
