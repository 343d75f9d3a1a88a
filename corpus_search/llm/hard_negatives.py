"""Hard negatives of every (anchor, positive) pair by a secondary-sort shuffle.

Anchors meet the other rows in blocks: a block of anchors and a part of the rows, both of a bounded
size, are one task's matrix product. First each anchor's positives are found (a part hands on its
best ones, these are merged). In a second pass a part knows the anchors' positive scores and with
them the windows that negatives may lie in; it hands on its best rows of each window. Both go on as
packed keys

    anchor | descending score | positive first | id

of 25 bytes, in the order of their bytes. `repartitionAndSortWithinPartitions` brings an anchor's
keys together, sorted (and spilled where they are many), and one pass over them opens a window at
each positive and writes out the negatives that fall into open windows. An anchor is never held as a
whole: only its at most `positives` windows are. What is shuffled grows with anchors x parts, not
with anchors x rows, and loses no row that could be among the first of a window.

Vectors are integers (floor of 256 times the value) and products are exact.

Rows
    a row with a null id, label or vector, or a null or non-finite component takes no part; nor does
    one whose squared length in integers is 2**55 or more, since a hundred times a product would
    leave the range of a long. Shorter vectors count as padded with zeros. Rows with the anchor's id
    are its own and no candidates; of several anchors with one id the one with the smallest (label,
    vector) counts. Other repeated rows are each a candidate. Anchors without positives or negatives
    give no row, nor does an empty table. Only the three named columns are read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpus_search.llm.centroids import integers as whole_vector
from corpus_search.llm.knn_join import matrix, products
from corpus_search.llm.tables import Stage, spread

SCALE = 256
POSITIVES = 5
NEGATIVES = 10
#: A negative's score in hundredths of the positive's.
LOW, HIGH = 30, 90
LONGEST = 2.0**55

ANCHORS_A_BLOCK = 8_192
ROWS_A_PART = 8_192
#: Anchors that are multiplied at once, and keys of one task of the last shuffle, on average.
AT_ONCE = 256
KEYS_A_TASK = 1_000_000

KEY = struct.Struct(">QQBQ")
OFFSET = 2**63
SCHEMA = (
    "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, "
    "negative_score long"
)


def packed(anchor: np.ndarray, score: np.ndarray, negative: bool, ids: np.ndarray) -> pa.Array:
    """Keys whose bytes sort by anchor, then falling score, positives first, then id."""
    key = np.empty(len(ids), [("anchor", ">u8"), ("score", ">u8"), ("kind", "u1"), ("id", ">u8")])
    flip = np.uint64(OFFSET)
    key["anchor"] = anchor.astype(np.int64).view(np.uint64) ^ flip
    key["score"] = ~(score.astype(np.int64).view(np.uint64) ^ flip)
    key["kind"] = int(negative)
    key["id"] = ids.astype(np.int64).view(np.uint64) ^ flip
    offsets = np.arange(len(ids) + 1, dtype=np.int32) * KEY.size
    return pa.Array.from_buffers(
        pa.binary(), len(ids), [None, pa.py_buffer(offsets), pa.py_buffer(key.tobytes())]
    )


def unpacked(key: bytes) -> tuple[int, int, int, int]:
    """anchor, score, 1 for a negative, id."""
    anchor, score, kind, of = KEY.unpack(key)
    return anchor - OFFSET, OFFSET - 1 - score, kind, of - OFFSET


def window(positive_score: int, low: int = LOW, high: int = HIGH) -> tuple[int, int]:
    """The least and the greatest score of a negative, in exact integers."""
    return -(-low * positive_score // 100), high * positive_score // 100


def mined(
    keys: Iterator[tuple[bytes, None]], positives: int, negatives: int, low: int, high: int
) -> Iterator[tuple[int, int, int, int, int, int]]:
    """One pass over sorted keys. A window is [positive, its score, least, greatest, found]."""
    now, windows, opened = None, [], 0
    for key, _ in keys:
        anchor, score, negative, of = unpacked(key)
        if anchor != now:
            now, windows, opened = anchor, [], 0
        if not negative:
            if opened < positives:
                opened += 1
                windows.append([of, score, *window(score, low, high), 0])
            continue
        # Scores only fall, so a window is done once they are under it.
        windows = [w for w in windows if w[2] <= score and w[4] < negatives]
        for w in windows:
            if score <= w[3]:
                w[4] += 1
                yield anchor, w[0], w[4], of, w[1], score


def _blocks(anchors: pa.Table, rows: pa.Table):
    """Scores of some anchors at a time with all rows: (first, scores, same label, other ids)."""
    width = max(
        pc.max(pc.list_value_length(t.column("v"))).as_py() for t in (anchors, rows)
    )
    x, ids, label = matrix(rows.column("v"), width), _numbers(rows, "id"), _numbers(rows, "label")
    for at in range(0, anchors.num_rows, AT_ONCE):
        some = anchors.slice(at, AT_ONCE)
        scores = products(matrix(some.column("v"), width), x)
        yield (
            at,
            scores,
            _numbers(some, "label")[:, None] == label,
            _numbers(some, "id")[:, None] != ids,
        )


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _first(scores: np.ndarray, ids: np.ndarray, many: int) -> np.ndarray:
    """Positions of the `many` highest scores, ties by smaller id."""
    if len(scores) > many:
        there = np.flatnonzero(scores >= np.partition(scores, -many)[-many])
        return there[np.lexsort((ids[there], -scores[there]))][:many]
    return np.lexsort((ids, -scores))


def _best_positives(positives: int):
    def find(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        if anchors.num_rows and rows.num_rows:
            ids, anchor = _numbers(rows, "id"), _numbers(anchors, "id")
            for at, scores, same, other in _blocks(anchors, rows):
                for i, fits in enumerate(same & other):
                    there = np.flatnonzero(fits)
                    there = there[_first(scores[i, there], ids[there], positives)]
                    out.append((np.full(len(there), anchor[at + i]), ids[there], scores[i, there]))
        a, p, s = (np.concatenate(c) for c in zip(*out, strict=True)) if out else ([], [], [])
        return pa.table(
            {"anchor": pa.array(a, pa.int64()), "id": pa.array(p, pa.int64()), "score": pa.array(s, pa.int64())}
        )

    return find


def _best_negatives(negatives: int, low: int, high: int):
    """Per anchor and window the part's first rows, as packed keys; a row of several windows once."""

    def find(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        if anchors.num_rows and rows.num_rows:
            ids, anchor = _numbers(rows, "id"), _numbers(anchors, "id")
            positive = anchors.column("positives").to_pylist()
            for at, scores, same, other in _blocks(anchors, rows):
                for i, fits in enumerate(~same & other):
                    there = np.flatnonzero(fits)
                    score, taken = scores[i, there], []
                    for p in set(positive[at + i]):
                        least, greatest = window(p, low, high)
                        inside = np.flatnonzero((score >= least) & (score <= greatest))
                        taken.append(inside[_first(score[inside], ids[there[inside]], negatives)])
                    there = there[np.unique(np.concatenate(taken))]
                    out.append(packed(np.full(len(there), anchor[at + i]), scores[i, there], True, ids[there]))
        return pa.table({"key": pa.concat_arrays(out) if out else pa.array([], pa.binary())})

    return find


def _anchor_of(key: bytes) -> int:
    return zlib.crc32(key[:8])


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    label: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    scale: int = SCALE,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    anchors_a_block: int = ANCHORS_A_BLOCK,
    rows_a_part: int = ROWS_A_PART,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each of an
    anchor's best `positives` rows of its label, the best `negatives` rows of other labels whose
    scores are between `low` and `high` hundredths of the positive's."""
    spark = vectors.sparkSession
    stage = Stage(spark)
    vector = F.col(vector_col)
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"),
        label.cast("long").alias("label"),
        whole_vector(vector, None, scale, LONGEST).alias("v"),
        F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"),
    )
    rows = stage.put(
        spread(rows).filter("id is not null and label is not null and v is not null"), "rows"
    )
    n_rows, n_anchors = rows.agg(F.count("*"), F.count(F.when(F.col("is_anchor"), 1))).first()
    n_parts, n_blocks = (max(1, -(-n // of)) for n, of in ((n_rows, rows_a_part), (n_anchors, anchors_a_block)))

    # Any number of equal rows is dealt out by chance, not by content.
    parts = rows.select("id", "label", "v", F.floor(F.rand(7) * n_parts).alias("part"))
    parts = stage.put(parts, "parts").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    anchors = (
        rows.filter("is_anchor")
        .groupBy("id")
        .agg(F.min(F.struct("label", "v")).alias("own"))
        .select("id", "own.label", "own.v", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int").alias("block"))
    )
    anchors = stage.put(anchors, "anchors")

    def meet(some: DataFrame, function, schema: str) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_parts - 1).cast("long")))
        asked = some.withColumn("part", every)
        keys = ["block", "part"]
        return asked.groupBy(*keys).cogroup(parts.groupBy(*keys)).applyInArrow(function, schema)

    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    best = (
        meet(anchors, _best_positives(positives), "anchor long, id long, score long")
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= positives)
    )
    best = stage.put(best.select("anchor", "id", "score"), "positives")
    known = anchors.join(
        best.groupBy(F.col("anchor").alias("id")).agg(F.collect_list("score").alias("positives")), "id"
    )
    found = meet(known, _best_negatives(negatives, low, high), "key binary")
    opened = best.mapInArrow(_positive_keys, "key binary")
    keys = stage.put(opened.unionAll(found), "keys")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-keys.count() // KEYS_A_TASK))
    result = (
        keys.rdd.map(lambda row: (bytes(row[0]), None))
        .repartitionAndSortWithinPartitions(tasks, _anchor_of)
        .mapPartitions(lambda sorted_keys: mined(sorted_keys, positives, negatives, low, high))
    )
    return spark.createDataFrame(result, SCHEMA, verifySchema=False)


def _positive_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        anchor, of, score = (batch.column(c).to_numpy() for c in ("anchor", "id", "score"))
        yield pa.RecordBatch.from_arrays([packed(anchor, score, False, of)], ["key"])


ORACLE_SQL = f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT a.vec_id AS anchor_id, d.vec_id, a.label = d.label AS same,
    CAST(list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * d.e[i])) AS BIGINT) AS score
  FROM v AS a JOIN v AS d ON a.vec_id <> d.vec_id
  WHERE a.vec_id % 100 = 0
),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (
    SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE same
  ) WHERE r <= {POSITIVES}
),
n AS (
  SELECT p.anchor_id, p.positive_id,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
    s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id
  WHERE NOT s.same AND {LOW} * p.positive_score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}
"""
