"""Queries as arrays, and the scores of whole chunks against them.

A chunk's tokens and scores stand in one row (`by_chunk`), so that the chunk meets all queries of a
batch at once. What is shuffled is a row per chunk, never one per query and chunk: the pairs are
listed last (`listed`), where the chunk is, after everything else has been joined to its row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_search.functions.vectors import COSINE_SCALE

CHUNK_KEY = ["video_id", "chunk_index"]

# A batch within these limits is broadcast: 4,096 vectors of width 768 are 25 MB.
MAX_QUERIES = 4_096
MAX_WORDS = 500_000

# Size of the matrix of chunks by queries that a task works on at a time.
CELLS = 2_000_000

# Queries whose pairs with a chunk are listed in one array.
LISTED_QUERIES = 512


@dataclass(frozen=True)
class QueryBatch:
    """Queries as arrays: ids and vectors by position, and for every token the positions of the
    queries that hold it (`members[starts[t]:starts[t + 1]]`)."""

    ids: np.ndarray
    vectors: np.ndarray
    tokens: list[str]
    starts: np.ndarray
    members: np.ndarray


def batch_of(ids: list[int], words: list[list[str]], vectors: list[list[float]]) -> QueryBatch:
    """The arrays of some queries. A query's words are distinct; one that comes twice counts twice."""
    pairs = sorted((word, position) for position, own in enumerate(words) for word in own)
    tokens, counts = np.unique([word for word, _ in pairs], return_counts=True)
    return QueryBatch(
        ids=np.array(ids, dtype=np.int64),
        vectors=np.array(vectors, dtype=np.float64),
        tokens=tokens.tolist(),
        starts=np.concatenate([[0], np.cumsum(counts)]).astype(np.int64),
        members=np.array([position for _, position in pairs], dtype=np.int64),
    )


def token_batch(tokens: DataFrame, query_vectors: DataFrame | None = None) -> list[QueryBatch] | None:
    """The batch of `query_tokens`, by LISTED_QUERIES at most; with vectors a query for every row of
    them. None if it is too large to be broadcast, or if an id is null."""
    n_queries, n_rows, n_named = tokens.agg(
        F.count_distinct("query_id"), F.count("*"), F.count("query_id")
    ).first()
    if n_queries > MAX_QUERIES or n_rows > MAX_WORDS or n_named < n_rows:
        return None
    own: dict[int, list[str]] = {}
    for query_id, token in tokens.select("query_id", "token").collect():
        if token is not None:
            own.setdefault(query_id, []).append(token)
    if query_vectors is None:
        rows = [(query_id, []) for query_id in sorted(own)]
    else:
        wanted = query_vectors.join(
            F.broadcast(tokens.select("query_id").distinct()), "query_id", "left_semi"
        )
        rows = [
            (query_id, vector)
            for query_id, vector in wanted.select("query_id", "query_embedding").collect()
            if query_id in own
        ]
        if len(rows) > MAX_QUERIES:
            return None
    parts = [rows[at : at + LISTED_QUERIES] for at in range(0, len(rows), LISTED_QUERIES)]
    return [batch_of([i for i, _ in p], [own[i] for i, _ in p], [v for _, v in p]) for p in parts]


def by_chunk(scores: DataFrame, *others: str) -> DataFrame:
    """video_id, chunk_index, tokens, scores of `bm25_scores`. Rows of a chunk that stand near each
    other become one row in the tasks, so about a row per chunk is shuffled. Of the `others`, numbers,
    the chunk's least and most are kept (`least_x`, `most_x`)."""
    keys = [*CHUNK_KEY, *others]

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if part.num_rows == 0:
                continue
            key = np.zeros(part.num_rows, dtype=np.int64)
            for name in keys:
                coded = part.column(name).dictionary_encode()
                code = coded.indices.cast(pa.int64()).fill_null(-1).to_numpy() + 1
                key = key * (len(coded.dictionary) + 1) + code
            if (np.diff(key) < 0).any():
                order = np.argsort(key, kind="stable")
                part, key = part.take(pa.array(order)), key[order]
            first = np.flatnonzero(np.append(True, np.diff(key) != 0))
            offsets = pa.array(np.append(first, part.num_rows).astype(np.int32))
            at = pa.array(first)
            yield pa.RecordBatch.from_arrays(
                [
                    *(part.column(name).take(at) for name in keys),
                    pa.ListArray.from_arrays(offsets, part.column("token")),
                    pa.ListArray.from_arrays(offsets, part.column("score")),
                ],
                names=[*keys, "tokens", "scores"],
            )

    numbers = "".join(f"{name} bigint, " for name in others)
    schema = f"video_id string, chunk_index smallint, {numbers}tokens array<string>, scores array<double>"
    found = scores.select(*keys, "token", "score").mapInArrow(runs, schema)
    return (
        found.groupBy(*CHUNK_KEY)
        .agg(
            F.collect_list(F.struct("tokens", "scores")).alias("runs"),
            *(F.min(name).alias(f"least_{name}") for name in others),
            *(F.max(name).alias(f"most_{name}") for name in others),
        )
        .select(
            *CHUNK_KEY,
            *(f"{end}_{name}" for name in others for end in ("least", "most")),
            F.flatten("runs.tokens").alias("tokens"),
            F.flatten("runs.scores").alias("scores"),
        )
    )


def matched_chunks(bm25: DataFrame, tokens: DataFrame) -> DataFrame:
    """`by_chunk` of the chunks that hold one of the tokens, with those tokens only. The tokens are
    few enough for `token_batch`."""
    asked = F.broadcast(tokens.select("token").distinct())
    return by_chunk(bm25.join(asked, "token", "left_semi"))


def matches(
    part: pa.RecordBatch, queries: QueryBatch, vocabulary: pa.Array
) -> tuple[np.ndarray, np.ndarray]:
    """Chunks by queries: the lexical score, and whether they have a token in common."""
    n_rows, n_queries = part.num_rows, len(queries.ids)
    lists = part.column("tokens")
    row = np.repeat(np.arange(n_rows), pc.list_value_length(lists).to_numpy())
    code = pc.index_in(lists.flatten(), vocabulary)
    known = pc.is_valid(code).to_numpy(zero_copy_only=False)
    row, weight = row[known], part.column("scores").flatten().to_numpy()[known]
    code = pc.drop_null(code).to_numpy()

    # One entry for every token of a chunk and every query with that token.
    first, fan_out = queries.starts[code], queries.starts[code + 1] - queries.starts[code]
    within = np.arange(fan_out.sum()) - np.repeat(np.cumsum(fan_out) - fan_out, fan_out)
    query = queries.members[np.repeat(first, fan_out) + within]
    cell = np.repeat(row, fan_out) * n_queries + query
    shape = (n_rows, n_queries)
    size = n_rows * n_queries
    # Counting nothing gives integers.
    lexical = np.bincount(cell, np.repeat(weight, fan_out), size).astype(np.float64)
    matched = np.bincount(cell, minlength=size) > 0
    return lexical.reshape(shape), matched.reshape(shape)


class AskedTokens:
    """The tokens of a batch of queries: a bit for every query that holds the token, and the tokens of
    every query. Made once for all parts that meet the batch."""

    def __init__(self, queries: QueryBatch):
        self.n_queries, self.n_tokens = len(queries.ids), len(queries.tokens)
        self.vocabulary = pa.array(queries.tokens, pa.string())
        members = queries.members
        token = np.repeat(np.arange(self.n_tokens), np.diff(queries.starts))
        self.bits = np.zeros((self.n_tokens, -(-self.n_queries // 8)), np.uint8)
        np.bitwise_or.at(
            self.bits, (token, members >> 3), (128 >> (members & 7)).astype(np.uint8)
        )
        self.asked = token[np.argsort(members, kind="stable")]
        self.n_asked = np.bincount(members, minlength=self.n_queries)
        self.first = np.cumsum(self.n_asked) - self.n_asked


class PartTokens:
    """The tokens of a part's chunks that a batch of queries asks for: which pairs have one in common
    (`matched`, or `shared` for a few pairs), and the lexical scores of a few pairs (`lexical`)."""

    def __init__(self, part: pa.Table, asked: AskedTokens):
        lists = part.column("tokens").combine_chunks()
        row = np.repeat(np.arange(part.num_rows), pc.list_value_length(lists).to_numpy())
        values = lists.flatten()
        if not pa.types.is_dictionary(values.type):
            values = values.dictionary_encode()
        found = pc.index_in(values.dictionary, asked.vocabulary).fill_null(-1).to_numpy()
        code = np.append(found, -1)[values.indices.fill_null(len(found)).to_numpy()]
        known = code >= 0
        self.row, self.code = row[known], code[known]
        self.weight = part.column("scores").combine_chunks().flatten().to_numpy()[known]
        self.starts = np.searchsorted(self.row, np.arange(part.num_rows + 1))
        self.n_queries, self.n_tokens, self.bits = asked.n_queries, asked.n_tokens, asked.bits
        self.asked, self.n_asked, self.first = asked.asked, asked.n_asked, asked.first

    def _between(self, first: int, end: int) -> slice:
        return slice(*np.searchsorted(self.row, [first, end]))

    def matched(self, first: int, end: int) -> np.ndarray:
        """Chunks from `first` to before `end` by queries: whether they have a token in common."""
        own = self._between(first, end)
        rows, starts = np.unique(self.row[own], return_index=True)
        packed = np.zeros((end - first, self.bits.shape[1]), np.uint8)
        if len(rows):
            found = np.bitwise_or.reduceat(self.bits[self.code[own]], starts, axis=0)
            packed[rows - first] = found
        return np.unpackbits(packed, axis=1, count=self.n_queries).view(bool)

    def shared(self, row: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Whether the chunk and the query of a pair have a token in common."""
        n = self.starts[row + 1] - self.starts[row]
        pair = np.repeat(np.arange(len(row)), n)
        within = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
        held = self.bits[self.code[self.starts[row][pair] + within], (query >> 3)[pair]]
        held &= (128 >> (query & 7)).astype(np.uint8)[pair]
        return np.bincount(pair[held > 0], minlength=len(row)) > 0

    def lexical(self, row: np.ndarray, query: np.ndarray, cells: int = CELLS) -> np.ndarray:
        """The lexical scores of pairs of a chunk and a query."""
        scores = np.zeros(len(row))
        order = np.argsort(row, kind="stable")
        ordered = row[order]
        step = max(1, cells // max(1, self.n_tokens))
        table = np.zeros((step, self.n_tokens))
        for first in range(0, int(ordered[-1]) + 1 if len(row) else 0, step):
            at = order[slice(*np.searchsorted(ordered, [first, first + step]))]
            own = self._between(first, first + step)
            cell = (self.row[own] - first, self.code[own])
            np.add.at(table, cell, self.weight[own])
            n = self.n_asked[query[at]]
            pair = np.repeat(np.arange(len(at)), n)
            within = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
            token = self.asked[self.first[query[at]][pair] + within]
            scores[at] = np.bincount(pair, table[row[at][pair] - first, token], len(at))
            table[cell] = 0
        return scores


def by_score(query: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by query and falling score (single precision), equal ones as they come, and every
    place's number within its query."""
    bits = score.astype(np.float32).view(np.uint32)
    falling = np.where(bits >> 31, bits, ~bits & np.uint32(0x7FFFFFFF)).astype(np.uint64)
    order = np.argsort((query.astype(np.uint64) << np.uint64(32)) | falling, kind="stable")
    ordered = query[order]
    starts = np.flatnonzero(np.append(True, np.diff(ordered) != 0)) if len(order) else order
    place = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order, place


def listed(chunks: DataFrame, batch: list[QueryBatch], *others: str, cosine: bool = False) -> DataFrame:
    """query_id, video_id, chunk_index, lexical_score (with `cosine`, that of `embedding`, too) and
    the `others` of every chunk that shares a token with a query: the pairs are listed where the
    chunk's row is."""
    context, cells = chunks.sparkSession.sparkContext, CELLS
    names = ["query_id", "lexical_score", *(["cosine"] if cosine else [])]
    kind = "query_id bigint, lexical_score double" + (", cosine float" if cosine else "")
    arguments = ["tokens", "scores", *(["embedding"] if cosine else [])]

    def pairs_of(shared):
        def score(columns: list[pa.Array]) -> pa.Array:
            queries = QueryBatch(**shared.value)
            vocabulary = pa.array(queries.tokens, pa.string())
            whole = pa.RecordBatch.from_arrays(columns, names=arguments)
            step = max(1, cells // len(queries.ids))
            counts, found = [np.zeros(1, np.int64)], []
            for at in range(0, whole.num_rows, step):
                part = whole.slice(at, step)
                lexical, matched = matches(part, queries, vocabulary)
                row, query = np.nonzero(matched)
                counts.append(matched.sum(axis=1))
                values = [pa.array(queries.ids[query]), pa.array(lexical[row, query])]
                if cosine:
                    vectors = part.column("embedding").flatten().to_numpy().astype(np.float64)
                    near = vectors.reshape(part.num_rows, -1) @ queries.vectors.T
                    # Adding zero turns a negative zero into zero.
                    near = (np.rint(near * COSINE_SCALE) / COSINE_SCALE + 0.0)[row, query]
                    # A vector that is not finite is similar to nothing.
                    values.append(pa.array(near.astype(np.float32), mask=~np.isfinite(near)))
                found.append(pa.StructArray.from_arrays(values, names))
            if not found:
                empty = [pa.array([], t) for t in (pa.int64(), pa.float64(), pa.float32())]
                found = [pa.StructArray.from_arrays(empty[: len(names)], names)]
            offsets = pa.array(np.cumsum(np.concatenate(counts)).astype(np.int32))
            return pa.ListArray.from_arrays(offsets, pa.concat_arrays(found))

        @F.arrow_udf(f"array<struct<{kind.replace(' ', ':').replace(',:', ',')}>>")
        def pairs(tokens: pa.Array, scores: pa.Array) -> pa.Array:
            return score([tokens, scores])

        @F.arrow_udf(f"array<struct<{kind.replace(' ', ':').replace(',:', ',')}>>")
        def similar_pairs(tokens: pa.Array, scores: pa.Array, embedding: pa.Array) -> pa.Array:
            return score([tokens, scores, embedding])

        return similar_pairs if cosine else pairs

    if not batch:
        types = {f.name: f.dataType.simpleString() for f in chunks.schema}
        keys = ", ".join(f"{c} {types[c]}" for c in (*CHUNK_KEY, *others))
        none = chunks.sparkSession.createDataFrame([], f"{kind}, {keys}")
        return none.select("query_id", *CHUNK_KEY, *names[1:], *others)
    return reduce(
        DataFrame.unionByName,
        [
            chunks.select(
                *CHUNK_KEY,
                *others,
                # An outer explode, or the pairs would be formed a second time for a filter.
                F.explode_outer(pairs_of(context.broadcast(vars(queries)))(*arguments)).alias("pair"),
            )
            .filter("pair is not null")
            .select("pair.query_id", *CHUNK_KEY, *(f"pair.{n}" for n in names[1:]), *others)
            for queries in batch
        ],
    )
