"""Membership and cosine of any number of queries without a row per query and matching chunk.

Queries are dealt into tiles of a bounded size, and search rows are packed into parts, a part in one
row. A task holds one tile and reads all parts, one after another (`past_tiles`): a block product, of
which only what is among a query's `cut` best so far is kept (`best_of_part`, `TileBest`). Cosines
come first there: pairs that can't be among the best are never looked at again, and lexical scores are
added up for the best only. So the rows are written once, packed, and read once for every tile; what
is shuffled is the queries once and a query's best rows, and nothing goes through the driver.

Rows of a single part are few enough to be copied for every tile instead (`block_products`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_search.functions.vectors import COSINE_SCALE
from corpus_search.operators.batch_scoring import OUTPUT, best_in_place
from corpus_search.operators.chunk_scoring import (
    CELLS,
    MAX_QUERIES,
    MAX_WORDS,
    AskedTokens,
    PartTokens,
    QueryBatch,
    batch_of,
    by_score,
)
from corpus_search.operators.retrieval import CHUNK_KEY, best_per_query
from corpus_search.sources.staging import stage, staging_folder

# A tile of 4,096 queries of width 768 takes 25 MB, and its 250 best rows about 60 MB. A part of
# 65,536 such chunks takes 250 MB; more rows than that are packed by 2,048.
TILE_QUERIES = 4_096
TILE_WORDS = 500_000
PART_ROWS = 65_536
PACKED_ROWS = 2_048

# Cosines are compared in single precision, so products are let through with room for that.
ROOM = 1e-6

# Of a step's pairs, so many may be looked at one by one; more are looked at as a matrix.
FEW = 32

# A task has so many parts at least, if there are as many, so that a tile's best are soon known.
LEAST_PARTS = 8

# Rows of an Arrow batch that a tile hands on.
HANDED_ON = 100_000


def _numbers(below: int):
    return F.explode(F.sequence(F.lit(0), F.lit(below - 1)))


def query_tiles(
    prepared: DataFrame,
    query_vectors: DataFrame,
    tile_queries: int = TILE_QUERIES,
    tile_words: int = TILE_WORDS,
) -> tuple[DataFrame, int]:
    """(query_id, words, query_embedding, tile; the number of tiles). Queries without words match
    nothing and are left out."""
    asked = prepared.filter(F.size("words") > 0)
    n_queries, n_words = asked.agg(
        F.count("*"), F.coalesce(F.sum(F.size("words")), F.lit(0))
    ).first()
    n_tiles = max(1, -(-n_queries // tile_queries), -(-n_words // tile_words))
    return (
        asked.join(query_vectors, "query_id").select(
            "query_id",
            F.array_distinct("words").alias("words"),
            "query_embedding",
            F.pmod(F.xxhash64("query_id"), F.lit(n_tiles)).cast("int").alias("tile"),
        ),
        n_tiles,
    )


def in_chunk_order(rows: pa.Table) -> pa.Table:
    """The rows in the order that settles ties."""
    keys = [(column, "ascending") for column in CHUNK_KEY]
    return rows.take(pc.sort_indices(rows, sort_keys=keys, null_placement="at_start"))


def matrix_of(vectors: pa.ChunkedArray) -> np.ndarray:
    return vectors.combine_chunks().flatten().to_numpy().reshape(len(vectors), -1)


def batch_of_table(queries: pa.Table) -> QueryBatch:
    return batch_of(
        *(queries.column(c).to_pylist() for c in ("query_id", "words", "query_embedding"))
    )


def reaching(
    vectors: np.ndarray, others: np.ndarray, least: np.ndarray, step: int
) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first, end, matrix) for `step` vectors at a time: which products with the others may be at
    least `least`. In single precision where that can hold the products, with room for its rounding;
    `least` is read anew for every step."""
    lengths = [np.linalg.norm(x.astype(np.float64), axis=1) for x in (vectors, others)]
    longest = lengths[0].max(initial=0)
    with np.errstate(over="ignore", invalid="ignore"):
        is_single = longest * lengths[1].max(initial=0) < 1e30
    kind = np.float32 if is_single else np.float64
    rounding = (vectors.shape[1] + 4) * np.finfo(kind).eps * longest * lengths[1]
    across = np.ascontiguousarray(others.astype(kind).T)
    for at in range(0, len(vectors), step):
        end = min(at + step, len(vectors))
        limit = least.astype(np.float64)
        limit = limit - ROOM * (1 + np.abs(limit)) - rounding if is_single else limit - ROOM * (1 + np.abs(limit))
        limit = np.nextafter(limit.astype(kind), kind(-np.inf))
        yield at, end, vectors[at:end].astype(kind, copy=False) @ across >= limit


def exact_cosines(products: np.ndarray) -> np.ndarray:
    # Adding zero turns a negative zero into zero.
    return (np.rint(products * COSINE_SCALE) / COSINE_SCALE + 0.0).astype(np.float32)


def products_of(
    vectors: np.ndarray, queries: QueryBatch, row: np.ndarray, query: np.ndarray
) -> np.ndarray:
    """The products of pairs of a row and a query."""
    return np.einsum("ij,ij->i", vectors[row].astype(np.float64), queries.vectors[query])


def best_of_part(
    rows: pa.Table,
    queries: QueryBatch,
    cut: int,
    cells: int,
    positive: bool,
    asked: AskedTokens | None = None,
    least: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, query, lexical score, cosine) of every query's `cut` best rows by cosine, equal ones in
    the rows' order, among those with a common token; of those at or above `least` only, if it is
    given."""
    tokens, n_queries = PartTokens(rows, asked or AskedTokens(queries)), len(queries.ids)
    vectors = matrix_of(rows.column("embedding"))
    if least is None:
        least = np.full(n_queries, 0 if positive else -np.inf, np.float32)
    least = least.copy()
    best, new, n_new = [np.empty(0, np.int64)] * 2 + [np.empty(0, np.float32)], [], 0
    step = max(1, cells // n_queries)
    for at, end, near in reaching(vectors, queries.vectors, least, step):
        if np.count_nonzero(near) * FEW > near.size:
            products = vectors[at:end].astype(np.float64) @ queries.vectors.T
            row, query = np.nonzero(near & tokens.matched(at, end))
            cosine = exact_cosines(products[row, query])
            row = row + at
        else:
            row, query = np.divmod(np.flatnonzero(near), n_queries)
            row = row + at
            shared = tokens.shared(row, query)
            row, query = row[shared], query[shared]
            cosine = exact_cosines(products_of(vectors, queries, row, query))
        fits = np.isfinite(cosine) & (cosine >= least[query])
        if positive:
            fits &= cosine > 0
        new.append([row[fits], query[fits], cosine[fits]])
        n_new += fits.sum()
        if n_new > cells // 2 or end == rows.num_rows:
            best = [np.concatenate(columns) for columns in zip(best, *new, strict=True)]
            order, place = by_score(best[1], best[2])
            last = order[place == cut - 1]
            least[best[1][last]] = best[2][last]
            best = [column[order[place < cut]] for column in best]
            new, n_new = [], 0
    row, query, cosine = best
    return row, query, tokens.lexical(row, query), cosine


SCORED = pa.schema(
    [
        ("query_id", pa.int64()),
        ("video_id", pa.string()),
        ("chunk_index", pa.int16()),
        ("lexical_score", pa.float64()),
        ("cosine", pa.float32()),
    ]
)


def _scorer(cut: int, cells: int, positive: bool):
    def score(rows: pa.Table, queries: pa.Table) -> pa.Table:
        if rows.num_rows == 0 or queries.num_rows == 0:
            return SCORED.empty_table()
        batch, rows = batch_of_table(queries), in_chunk_order(rows)
        row, query, lexical, cosine = best_of_part(rows, batch, cut, cells, positive)
        kept = [rows.column(name).take(pa.array(row)) for name in CHUNK_KEY]
        return pa.Table.from_arrays(
            [pa.array(batch.ids[query]), *kept, pa.array(lexical), pa.array(cosine)], schema=SCORED
        )

    return score


class TileBest:
    """What is among the `cut` best rows of every query of a tile so far, of any number of parts.

    Rows equal to the last of them stay, so that ties can be settled later, up to `cut` of them more;
    then they are settled here. `least` is what a row must reach."""

    def __init__(self, queries: pa.Table, cut: int, positive: bool):
        self.queries, self.cut = batch_of_table(queries), cut
        self.asked = AskedTokens(self.queries)
        self.least = np.full(len(self.queries.ids), 0 if positive else -np.inf, np.float32)
        self.video_id, self.chunk_index = pa.array([], pa.string()), pa.array([], pa.int16())
        self.query, self.lexical = np.empty(0, np.int64), np.empty(0)
        self.cosine, self.new, self.n_new = np.empty(0, np.float32), [], 0

    def add(self, rows: pa.Table, row: np.ndarray, *scores: np.ndarray) -> None:
        """Rows of a part by their numbers, with query, lexical score and cosine."""
        keys = (rows.column(name).combine_chunks().take(pa.array(row)) for name in CHUNK_KEY)
        self.new.append((*keys, *scores))
        self.n_new += len(row)
        if self.n_new > max(self.cut * len(self.least) // 4, len(self.query) // 2):
            self.merge()

    def merge(self) -> None:
        if not self.new:
            return
        old = (self.video_id, self.chunk_index, self.query, self.lexical, self.cosine)
        columns = list(zip(old, *self.new, strict=True))
        self.new, self.n_new = [], 0
        keys = [pa.concat_arrays(c) for c in columns[:2]]
        query, lexical, cosine = (np.concatenate(c) for c in columns[2:])
        order, place = by_score(query, cosine)
        last = order[place == self.cut - 1]
        self.least[query[last]] = cosine[last]
        tied = cosine[order] == self.least[query[order]]
        kept = order[(place < self.cut) | tied]
        counts = np.bincount(query[kept], minlength=len(self.least))
        if (many := counts > 2 * self.cut).any():
            settled = many[query[kept]] & (cosine[kept] == self.least[query[kept]])
            better = np.bincount(query[kept[~settled]], minlength=len(self.least))
            kept = np.concatenate([kept[~settled], self._first(keys, query, kept[settled], better)])
        at = pa.array(kept)
        self.video_id, self.chunk_index = (key.take(at) for key in keys)
        self.query, self.lexical, self.cosine = query[kept], lexical[kept], cosine[kept]

    def _first(
        self, keys: list[pa.Array], query: np.ndarray, tied: np.ndarray, better: np.ndarray
    ) -> np.ndarray:
        """Of equal rows those that come first by their keys and have a place among the best."""
        at = pa.array(tied)
        columns = {"query": pa.array(query[tied]), **{n: k.take(at) for n, k in zip(CHUNK_KEY, keys, strict=True)}}
        order = pc.sort_indices(
            pa.table(columns), sort_keys=[(c, "ascending") for c in columns], null_placement="at_start"
        ).to_numpy()
        ordered = query[tied][order]
        place = np.arange(len(order)) - np.searchsorted(ordered, ordered)
        return tied[order[place < self.cut - better[ordered]]]

    def batches(self) -> Iterator[pa.RecordBatch]:
        self.merge()
        ids = pa.array(self.queries.ids[self.query])
        scores = [pa.array(self.lexical), pa.array(self.cosine)]
        whole = pa.Table.from_arrays(
            [ids, self.video_id, self.chunk_index, *scores], schema=SCORED
        )
        yield from whole.to_batches(max_chunksize=HANDED_ON)


def packed(table: pa.Table, compression: str | None = None) -> bytes:
    sink = pa.BufferOutputStream()
    options = pa.ipc.IpcWriteOptions(compression=compression)
    with pa.ipc.new_stream(sink, table.schema, options=options) as writer:
        writer.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def unpacked(value: pa.BinaryScalar) -> pa.Table:
    return pa.ipc.open_stream(value.as_buffer()).read_all()


def packed_part(rows: pa.Table) -> bytes:
    """Rows in chunk order, every token once in a dictionary."""
    rows = in_chunk_order(rows).combine_chunks()
    lists = rows.column("tokens").combine_chunks()
    ends = np.cumsum(np.append(0, pc.list_value_length(lists).to_numpy())).astype(np.int32)
    coded = pa.ListArray.from_arrays(pa.array(ends), lists.flatten().dictionary_encode())
    return packed(rows.set_column(rows.schema.get_field_index("tokens"), "tokens", coded))


def packed_parts(rows: DataFrame, packed_rows: int = PACKED_ROWS) -> DataFrame:
    """part: the rows packed where they stand, so many to a row."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
            while rest.num_rows >= packed_rows:
                yield row_of(rest.slice(0, packed_rows))
                rest = rest.slice(packed_rows)
        if rest is not None and rest.num_rows:
            yield row_of(rest)

    def row_of(part: pa.Table) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([packed_part(part)], pa.binary())], ["part"])

    return rows.mapInArrow(pack, "part binary")


def packed_tiles(tiles: DataFrame) -> DataFrame:
    """tile, asked: the queries of a tile packed in one row."""

    def pack(key: tuple, queries: pa.Table) -> pa.Table:
        own = packed(queries.select(["query_id", "words", "query_embedding"]), "zstd")
        return pa.table({"tile": pa.array([key[0].as_py()], pa.int32()), "asked": pa.array([own], pa.binary())})

    return tiles.groupBy("tile").applyInArrow(pack, "tile int, asked binary")


def past_tiles(
    rows: DataFrame,
    tiles: DataFrame,
    n_tiles: int,
    begin: Callable[[pa.Table], TileBest],
    meet: Callable[[TileBest, pa.Table], None],
    schema: str,
    packed_rows: int = PACKED_ROWS,
) -> DataFrame:
    """All rows past every tile. `begin` makes what a tile keeps, `meet` shows it a part, and its
    `batches` are handed on at the end.

    Parts and tiles are written once. Then a tile is a partition of its own, which a task holds while
    it reads the parts: all of them, if there are more tiles than cores, else a share of them. So a
    query's best are handed on once, or as often as there are shares."""
    spark, folder = rows.sparkSession, staging_folder(rows.sparkSession)
    parts = stage(packed_parts(rows, packed_rows), f"{folder}/parts", **{"parquet.block.size": 2**24})
    # One row a tile, so that a range holds one tile.
    asked = stage(packed_tiles(tiles), f"{folder}/tiles").repartitionByRange(n_tiles, "tile")
    shares = -(-2 * spark.sparkContext.defaultParallelism // n_tiles)
    shares = max(1, min(shares, parts.count() // LEAST_PARTS))
    pairs = parts.coalesce(shares).hint("shuffle_replicate_nl").crossJoin(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {}
        for batch in batches:
            for tile, own, part in zip(*(batch.column(c) for c in ("tile", "asked", "part")), strict=True):
                if (key := tile.as_py()) not in held:
                    held[key] = begin(unpacked(own))
                meet(held[key], unpacked(part))
        for kept in held.values():
            yield from kept.batches()

    return pairs.mapInArrow(run, schema)


def best_by_tiles(
    rows: DataFrame,
    tiles: DataFrame,
    n_tiles: int,
    cut: int,
    part_rows: int = PART_ROWS,
    cells: int = CELLS,
    positive: bool = True,
) -> DataFrame:
    """The same rows as `batch_scoring.best_in_place`, for queries in tiles. Without `positive`,
    cosines of zero and less count, too.

    Tiles that fit a batch together go to the rows: every task scores its rows against one tile after
    the other. More of them are met by copies of the rows while those are one part, and otherwise
    read the rows (`past_tiles`)."""
    if (small := collected_tiles(tiles)) is not None:
        return best_in_place(rows, small, cut, positive, cells=cells)
    narrow = rows.select(*CHUNK_KEY, "tokens", "scores", "embedding")
    if narrow.count() <= part_rows:
        scored = block_products(narrow, tiles, n_tiles, _scorer(cut, cells, positive), OUTPUT)
    else:

        def begin(queries: pa.Table) -> TileBest:
            return TileBest(queries, cut, positive)

        def meet(tile: TileBest, part: pa.Table) -> None:
            row, *scores = best_of_part(
                part, tile.queries, cut, cells, positive, tile.asked, tile.least
            )
            tile.add(part, row, *scores)

        scored = past_tiles(narrow, tiles, n_tiles, begin, meet, OUTPUT, min(PACKED_ROWS, part_rows))
    return best_per_query(scored, "cosine", cut, "dense_rank")


def collected_tiles(tiles: DataFrame) -> list[QueryBatch] | None:
    """The tiles as batches, if all their queries are few and short enough to be broadcast."""
    n_queries, n_words = tiles.agg(
        F.count("*"), F.coalesce(F.sum(F.size("words")), F.lit(0))
    ).first()
    if n_queries > MAX_QUERIES or n_words > MAX_WORDS:
        return None
    own: dict[int, list] = {}
    for tile, *query in tiles.select("tile", "query_id", "words", "query_embedding").collect():
        own.setdefault(tile, []).append(query)
    return [batch_of(*map(list, zip(*own[tile], strict=True))) for tile in sorted(own)]


def block_products(
    rows: DataFrame, tiles: DataFrame, n_tiles: int, function, schema: str
) -> DataFrame:
    """`function` of the rows, which are a part at most, and every tile of queries, each in one task."""
    copied = rows.withColumn("tile", _numbers(n_tiles))
    return copied.groupBy("tile").cogroup(tiles.groupBy("tile")).applyInArrow(function, schema)
