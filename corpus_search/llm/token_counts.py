"""Token counts that follow edits.

A document's text is cut into leaves at places where the tokenizer's pre-token pattern breaks
whatever stands further off: before a single space between two letters. Counts of leaves therefore
add up to the count of the text. A table of trees (`document_trees`) keeps the leaves' lengths and
counts with each document; it is written once. Edits meet it there: an edit re-encodes the leaves it
touches, with those whose cut stands within two characters of it, and updates the sums above them.
Everything else keeps its counts and is neither cut nor encoded again, however often a document is
edited (`edited_trees` gives the table for the next edits).

Edits are code point ranges (start, end exclusive) of the old text with their replacement; they are
applied together, in order, and must not overlap: one that starts before the end of the one before
it is refused (the row gets the message in `error` and keeps its counts).

Rows
    null and empty texts are one empty leaf with no token. Rows without edits (null or empty) keep
    their counts. Ranges are clipped to the text; null ranges, or an end before the start, are empty
    ranges at the start. Repeated rows are edited each. The tokenizer's special tokens are ordinary
    text. A column `edits` that holds no edits is not read; further columns are not either.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpus_search.llm.tables import Stage, small_batches, spread, whole

TOKENIZER = "byte_bpe_50k.tiktoken"
LEAF = 512
CUT = re.compile(r"(?<=[^\W\d_]) (?=[^\W\d_])")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(
        "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def count(path: str, text: str) -> int:
    return len(_encoding(path).encode_ordinary(text)) if text else 0


def leaves(text: str) -> list[str]:
    out, at = [], 0
    while cut := CUT.search(text, at + LEAF):
        out.append(text[at : cut.start()])
        at = cut.start()
    return [*out, text[at:]]


def tree(counts: list[int]) -> np.ndarray:
    """Sums as a heap: node i holds 2i and 2i + 1; the leaves are the second half."""
    half = 1 << max(0, len(counts) - 1).bit_length()
    sums = np.zeros(2 * half, np.int64)
    sums[half : half + len(counts)] = counts
    for i in range(half - 1, 0, -1):
        sums[i] = sums[2 * i] + sums[2 * i + 1]
    return sums


def update(sums: np.ndarray, leaf: int, value: int) -> None:
    i = len(sums) // 2 + leaf
    change = value - sums[i]
    while i and change:
        sums[i] += change
        i //= 2


def apply(path: str, parts: list[str], sums: np.ndarray, edits: list[tuple[int, int, str]]):
    """The tree after the edits: (leaves re-encoded, characters re-encoded). `parts` becomes the
    new leaves; the leaves of a region that was re-encoded are joined in its first."""
    ends = np.cumsum([len(p) for p in parts])
    begins = ends - [len(p) for p in parts]
    regions: list[list] = []  # first leaf, last leaf, edits
    for start, end, text in edits:
        first = int(np.searchsorted(ends, max(0, start - 2), "left"))
        last = int(np.searchsorted(begins, end + 2, "right")) - 1
        first, last = min(first, len(parts) - 1), max(last, min(first, len(parts) - 1))
        if regions and first <= regions[-1][1]:
            regions[-1][1] = max(last, regions[-1][1])
            regions[-1][2].append((start, end, text))
        else:
            regions.append([first, last, [(start, end, text)]])
    redone = chars = 0
    for first, last, inside in regions:
        old, at, new = "".join(parts[first : last + 1]), 0, []
        for start, end, text in inside:
            new += [old[at : start - begins[first]], text]
            at = end - begins[first]
        region = "".join([*new, old[at:]])
        parts[first] = region
        update(sums, first, sum(count(path, p) for p in leaves(region)))
        for leaf in range(first + 1, last + 1):
            parts[leaf] = ""
            update(sums, leaf, 0)
        redone += last - first + 1
        chars += len(region)
    return redone, chars


def _ranges(edits: list | None, size: int) -> tuple[list[tuple[int, int, str]], str | None]:
    out, before = [], 0
    for e in edits or []:
        start = min(max(0, e["start"] or 0), size)
        end = min(max(start, e["end"] if e["end"] is not None else start), size)
        if start < before:
            return [], f"edit at {start} overlaps the one before it"
        out.append((start, end, e["text"] or ""))
        before = end
    return out, None


def _builder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [leaves(text.as_py()) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array([[len(p) for p in own] for own in parts], pa.list_(pa.int64())),
                    pa.array([[count(path, p) for p in own] for own in parts], pa.list_(pa.int64())),
                ],
                [*batch.schema.names, "lengths", "counts"],
            )

    return run


def _editor(path: str, whole_trees: bool):
    figures = ("before", "after", "leaves", "again", "chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {n: [] for n in (*figures, "error", "text", "lengths", "counts")}
            columns = (batch.column(n) for n in ("text", "edits", "lengths", "counts"))
            for text, edits, lengths, counts in zip(*columns, strict=True):
                text, lengths = text.as_py(), lengths.as_py()
                ends = np.cumsum(lengths).tolist()
                parts = [text[e - n : e] for e, n in zip(ends, lengths, strict=True)]
                sums = tree(counts.as_py())
                before = int(sums[1])
                ranges, error = _ranges(edits.as_py(), len(text))
                again, chars = apply(path, parts, sums, ranges)
                values = (before, int(sums[1]), len(parts), again, chars, error)
                for n, v in zip((*figures, "error"), values, strict=True):
                    rows[n].append(v)
                if whole_trees:
                    rows["text"].append("".join(parts))
                    rows["lengths"].append([len(p) for p in parts])
                    rows["counts"].append(sums[len(sums) // 2 :][: len(parts)].tolist())
            out = [batch.column("id"), *(pa.array(rows[n], pa.int64()) for n in figures), pa.array(rows["error"], pa.string())]
            names = ["id", *figures, "error"]
            if whole_trees:
                out += [pa.array(rows["text"], pa.string()), *(pa.array(rows[n], pa.list_(pa.int64())) for n in ("lengths", "counts"))]
                names += ["text", "lengths", "counts"]
            yield pa.RecordBatch.from_arrays(out, names)

    return run


EDITS = "array<struct<start:bigint,end:bigint,text:string>>"


def document_trees(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None
) -> DataFrame:
    """id, text, edits (those of a column `edits`, if it holds some), lengths and counts of the leaves:
    the table to write and to edit."""
    small_batches(docs.sparkSession)
    kind = docs.schema["edits"].dataType if "edits" in docs.columns else None
    has_edits = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType)
    has_edits = has_edits and kind.elementType.fieldNames() == ["start", "end", "text"]
    rows = docs.select(
        F.col(id_col).alias("id"),
        whole(text_col).alias("text"),
        (F.col("edits") if has_edits else F.lit(None)).cast(EDITS).alias("edits"),
    )
    of = rows.schema["id"].dataType.simpleString()
    return spread(rows).mapInArrow(
        _builder(path or tokenizer_path()),
        f"id {of}, text string, edits {EDITS}, lengths array<long>, counts array<long>",
    )


def edited_trees(
    trees: DataFrame,
    edits: DataFrame | None = None,
    id_col: str = "doc_id",
    path: str | None = None,
    whole_trees: bool = True,
) -> DataFrame:
    """The stored trees after their edits: id, before, after, leaves, again, chars, error, and with
    `whole_trees` the text, lengths and counts to store. `edits` holds id, start, end and
    replacement, one row per edit; without it the edits of the table are taken."""
    if edits is not None:
        more = edits.groupBy(F.col(id_col).alias("id")).agg(
            F.sort_array(F.collect_list(F.struct("start", "end", "replacement"))).cast(EDITS).alias("edits")
        )
        trees = trees.drop("edits").join(more, "id", "left")
    of = trees.schema["id"].dataType.simpleString()
    schema = f"id {of}, before long, after long, leaves long, again long, chars long, error string"
    if whole_trees:
        schema += ", text string, lengths array<long>, counts array<long>"
    return trees.select("id", "text", "edits", "lengths", "counts").mapInArrow(
        _editor(path or tokenizer_path(), whole_trees), schema
    )


def edited_counts(
    docs: DataFrame, edits: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path: str | None = None
) -> DataFrame:
    """One row per row: id, tokens before and after the edits, leaves, and what was re-encoded.
    `edits` holds id, start, end and replacement, one row per edit; without it, a column `edits` of
    the documents is taken. The trees are written first, the edits are made on them."""
    trees = Stage(docs.sparkSession).put(document_trees(docs, id_col, text_col, path), "trees")
    return edited_trees(trees, edits, id_col, path, whole_trees=False).select(
        F.col("id").alias(id_col),
        F.col("before").alias("tokens_before"),
        F.col("after").alias("tokens_after"),
        F.col("leaves").alias("n_leaves"),
        F.col("again").alias("leaves_reencoded"),
        F.col("chars").alias("chars_reencoded"),
        "error",
    )


def line_edits(docs: DataFrame, text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Two edits per document: a heading with its source goes in front, and its last line goes."""
    text = whole(text_col)
    size = F.char_length(text).cast("long")
    back = F.locate("\n", F.reverse(text)).cast("long")
    last = F.when(back > 0, size - back).otherwise(size)
    zero = F.lit(0).cast("long")
    heading = F.concat(F.lit("# "), whole(source_col), F.lit("\n"))
    edit = lambda s, e, t: F.struct(s.alias("start"), e.alias("end"), t.alias("text"))
    return docs.withColumn("edits", F.array(edit(zero, zero, heading), edit(last, size, F.lit(""))))
