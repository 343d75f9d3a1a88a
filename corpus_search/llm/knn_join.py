"""Exact top-k search by inner product as a Voronoi join.

Pivots (a bounded number of rows) cut the space into cells. Queries are grouped by their nearest
pivot p; u is the largest distance of a group's query from p. The pivots are rows themselves, so the
k-th best product of a query with them bounds its k-th best product from below; the smallest such
bound of a group is its t. A row x can only matter to the group if p.x + u|x| >= t, and only then it
is copied to it. Copies meet the group's queries in parts of a bounded size, whatever a group holds,
each part keeps the k best rows of each query, and these are merged.

Components are turned into integers (floor of 1024 times the value), products are exact while they
stay below 2**63. Equal scores go to the smaller id.

Rows
    vectors that are null or hold a null or non-finite component take no part. Shorter vectors count
    as padded with zeros. Rows with the id of the query are its own; other repeated rows are each a
    candidate. An empty table, or one without a query, gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpus_search.llm.tables import Stage, spread

PIVOTS = 64
PART_ROWS = 20_000
PART_QUERIES = 2_000


def integers(vector: Column | str) -> Column:
    """floor(1024 * x) of each component, or null if the vector takes no part."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    x = F.transform(vector, lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(vector.isNotNull() & fine, F.transform(x, lambda v: F.floor(v * 1024)))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of integers, padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products; by floating point where every sum is small enough to be exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


@dataclass
class Cells:
    pivots: np.ndarray
    ids: np.ndarray
    k: int
    reach: np.ndarray | None = None  # u of each group, -1 without queries
    least: np.ndarray | None = None  # t
    blocks: np.ndarray | None = None  # blocks of queries of each group
    parts: int = 1

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, p = x.astype(np.float64), self.pivots.astype(np.float64)
        square = (x * x).sum(1)[:, None] + (p * p).sum(1) - 2 * x @ p.T
        cell = square.argmin(axis=1)
        return cell, np.linalg.norm(x - p[cell], axis=1)

    def bound(self, x: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The k-th best product with the pivots, or none if there are too few."""
        if len(self.pivots) <= self.k:
            return np.full(len(x), -np.inf)
        scores = x.astype(np.float64) @ self.pivots.astype(np.float64).T
        scores[ids[:, None] == self.ids] = -np.inf
        return np.partition(scores, -self.k, axis=1)[:, -self.k]

    def groups(self, x: np.ndarray) -> np.ndarray:
        """Which rows may matter to which groups; rounding is allowed for."""
        x, p = x.astype(np.float64), self.pivots.astype(np.float64)
        size = np.linalg.norm(x, axis=1)[:, None]
        most = x @ p.T + self.reach * size
        slack = 1 + 1e-9 * (np.linalg.norm(p, axis=1) + self.reach) * size
        return (most + slack >= self.least) & (self.reach >= 0)


def _assign(sent, width):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: Cells = sent.value
        for batch in batches:
            x = matrix(batch.column("v"), width)
            cell, distance = cells.nearest(x)
            least = cells.bound(x, batch.column("id").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("v"), *map(pa.array, (cell, distance, least))],
                ["id", "v", "cell", "distance", "least"],
            )

    return assign


def _copies(sent, width):
    """A row for each block of queries that a row may matter to."""

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: Cells = sent.value
        for batch in batches:
            row, group = np.nonzero(cells.groups(matrix(batch.column("v"), width)))
            times = cells.blocks[group]
            row, group = np.repeat(row, times), np.repeat(group, times)
            block = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            for at in range(0, len(row), 5000):
                one = slice(at, at + 5000)
                taken = batch.take(pa.array(row[one]))
                yield pa.RecordBatch.from_arrays(
                    [
                        taken.column("id"),
                        taken.column("v"),
                        taken.column("part"),
                        pa.array(group[one]),
                        pa.array(block[one]),
                    ],
                    ["id", "v", "part", "cell", "block"],
                )

    return copy


def _solver(k: int, width: int):
    def solve(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(rows):
            ids = rows["id"].to_numpy()
            x = matrix(pa.array(rows["v"]), width)
            for at in range(0, len(queries), 128):
                some = queries.iloc[at : at + 128]
                scores = products(matrix(pa.array(some["v"]), width), x)
                for q, score in zip(some["id"], scores, strict=True):
                    there = np.flatnonzero(ids != q)
                    if len(there) > k:
                        s = score[there]
                        there = there[s >= np.partition(s, -k)[-k]]
                    best = there[np.lexsort((ids[there], -score[there]))][:k]
                    out += [(q, i, s) for i, s in zip(ids[best], score[best], strict=True)]
        return pd.DataFrame(out, columns=["query_id", "row_id", "score"])

    return solve


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank (from 1), id and score of the k best rows of each query."""
    spark = vectors.sparkSession
    stage = Stage(spark)
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), integers(vector_col).alias("v"), is_query.alias("q")
    ).filter("v is not null and id is not null")
    n, width = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    schema = "query_id long, row_id long, score long"
    if n:
        pivots = rows.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).select("id", "v").toArrow()
        cells = Cells(
            matrix(pivots.column("v"), width), np.array(pivots.column("id").to_pylist()), k
        )
        sent = spark.sparkContext.broadcast(cells)
        queries = spread(rows).filter("q").select("id", "v")
        assigned = queries.mapInArrow(
            _assign(sent, width),
            "id long, v array<long>, cell long, distance double, least double",
        )
        assigned = stage.put(assigned, "queries")
        cells.reach, cells.least = np.full(len(cells.pivots), -1.0), np.zeros(len(cells.pivots))
        cells.blocks = np.zeros(len(cells.pivots), np.int64)
        cells.parts = -(-n // PART_ROWS)
        per_cell = assigned.groupBy("cell").agg(F.max("distance"), F.min("least"), F.count("*"))
        for c, reach, least, many in per_cell.collect():  # a row per pivot
            cells.reach[c], cells.least[c] = reach, least
            cells.blocks[c] = -(-many // PART_QUERIES)
        sent = spark.sparkContext.broadcast(cells)
        data = spread(rows).select("id", "v", F.pmod(F.xxhash64("id", "v"), F.lit(cells.parts)).alias("part"))
        copies = data.mapInArrow(
            _copies(sent, width), "id long, v array<long>, part long, cell long, block long"
        )
        of = spark.createDataFrame(
            [(i, int(b)) for i, b in enumerate(cells.blocks)], "cell long, blocks long"
        )
        asked = assigned.join(F.broadcast(of), "cell").select(
            "id",
            "v",
            "cell",
            F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"),
            F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells.parts - 1).cast("long"))).alias("part"),
        )
        keys = ["cell", "block", "part"]
        found = (
            asked.groupBy(*keys)
            .cogroup(copies.groupBy(*keys))
            .applyInPandas(lambda a, b: _solver(k, width)(a, b), schema)
        )
    else:
        found = spark.createDataFrame([], schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "row_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(
        "query_id", "rank", F.col("row_id").alias(id_col), "score"
    )
