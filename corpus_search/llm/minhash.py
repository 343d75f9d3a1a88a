"""Near-duplicate detection with DartMinHash signatures of weighted five-word shingles.

Each shingle owns a strip of the plane (weight x rank) in which darts fall as a Poisson process that
depends on the shingle alone. A document keeps the darts that hit below a shingle's weight, up to a
rank that gives it about k ln k + 2k darts; the earliest dart of each coordinate is its signature,
so two documents agree in a coordinate with the probability of their weighted Jaccard similarity.
The work of a document is its words plus its darts, not words times coordinates.

Signatures meet in 32 bands of four coordinates. A band never lists all pairs of its members: they
are compared with its first and its last member, in an order that is the same for all bands, so that
a group has few leaders. Bands of more than three whose members are then still in different
components get an exact second way: two texts that are similar enough share one of their rarest
shingles (the first ninth of the shorter one's weight, the first fifth of the longer one's), so
documents that only have a passage in common do not meet again, while no link between two components
is left out. Of those that meet, the closest pair of every two components is compared first, the
others only if that did not join them. Candidates pass an exact comparison of their shingles; classes
are the connected components of the links.

Rows
    null and empty texts have no word; they are copies of each other. Texts of one to four words are
    one shingle of all their words. Repeated rows and equal texts are one class. Words are compared
    in lower case (A-Z), split at ASCII white space. A null id belongs to the class of its text.
    Further columns of any name stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_search.llm.components import components, merged
from corpus_search.llm.tables import Stage, spread, whole
from corpus_search.llm.words import ODD, U, Words, hashed_words, mix

SHINGLE = 5
COORDINATES = 128
BANDS = 32
SIMILAR = 0.8
#: The leaders of a band are in all pairs of a band of so many.
COVERED = 3
#: So often only the closest pair of every two components is compared.
CLOSEST_TURNS = 2
#: Shingles that make up more than one part in so many of those counted are known as frequent. There
#: are fewer of them than this, whatever the data: 16 bytes each in every task.
FREQUENT = 1_000_000
#: Signatures that agree in less are not compared exactly; at similarity 0.8 an estimate this low
#: is over six standard deviations off.
ESTIMATE = 0.58
#: So many node numbers (8 bytes each) are sent to all tasks at most; more are joined by a shuffle.
BROADCAST_NODES = 1_000_000


def shingles(words: Words, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, shingle and weight (how often the row holds it), sorted by row."""
    h, row = words.hashes, words.row
    n = np.bincount(row, minlength=rows)
    full = max(0, len(h) - SHINGLE + 1)
    s = np.zeros(full, U)
    for j in range(SHINGLE):
        s = s * U(0xC2B2AE3D27D4EB4F) + h[j : j + full]
    ok = row[:full] == row[SHINGLE - 1 :] if full else np.zeros(0, bool)
    short = (n > 0) & (n < SHINGLE)
    few = short[row]
    place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
    one = np.zeros(rows, U)
    np.add.at(one, row[few], mix(h[few] + place[few].astype(U) * ODD))
    rows_of = np.concatenate([row[:full][ok], np.flatnonzero(short)])
    s = np.concatenate([mix(s[ok]), one[short]])
    order = np.lexsort((s, rows_of))
    rows_of, s = rows_of[order], s[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (rows_of[1:] != rows_of[:-1])
    at = np.flatnonzero(new)
    return rows_of[at], s[at], np.diff(np.append(at, len(s)))


def _strips(row, s, weight):
    """Weight cells [0,1), [1,2), [2,4), ... of each shingle up to its weight."""
    level = np.zeros(len(weight), np.int64)
    level[weight > 1] = np.ceil(np.log2(weight[weight > 1])).astype(np.int64)
    each = level + 1
    index = np.repeat(np.arange(len(s)), each)
    cell = np.arange(len(index)) - np.repeat(np.cumsum(each) - each, each)
    low = np.where(cell == 0, 0, 2.0 ** (cell - 1))
    return row[index], mix(s[index] + cell.astype(U) * ODD), low, 2.0**cell - low, weight[index]


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> U(11)).astype(np.float64) + 0.5) / 2**53


def darts(row, s, weight, rows: int, k: int = COORDINATES) -> np.ndarray:
    """The signatures (rows x k, 64 bits) of rows that each have a shingle."""
    signature = np.zeros((rows, k), U)
    total = np.bincount(row, weights=weight, minlength=rows)
    factor, todo = 1.0, total > 0
    while todo.any():
        limit = np.where(todo, factor * (k * np.log(k) + 2 * k) / np.maximum(total, 1), 0)
        mine = todo[row]
        strip, base, low, width, most = _strips(row[mine], s[mine], weight[mine])
        rank, found, turn = np.zeros(len(base)), [], 0
        while len(base):
            h = mix(base + U((2 * turn + 1) * int(ODD) % 2**64))
            rank = rank - np.log(_uniform(h)) / width
            on = rank <= limit[strip]
            strip, base, low, width, most, rank, h = (
                x[on] for x in (strip, base, low, width, most, rank, h)
            )
            g = mix(h ^ U(0xA0761D6478BD642F))
            hit = low + _uniform(g) * width < most
            place = (mix(g) % U(k)).astype(np.int64)
            found.append((strip[hit] * k + place[hit], rank[hit], h[hit]))
            turn += 1
        key, rank, h = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((rank, key))
        key, h = key[order], h[order]
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        signature.reshape(-1)[key[first]] = h[first]
        filled = np.bincount(key[first] // k, minlength=rows)
        todo &= filled < k
        factor *= 1.5
    return signature


def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = 0
        for words in hashed_words(batch.column("text")):
            rows = words.last - words.first
            row, s, weight = shingles(words, rows)
            signature = darts(row, s, weight, rows)
            has = np.bincount(row, minlength=rows) > 0
            wide = signature.reshape(rows, BANDS, COORDINATES // BANDS)
            band = np.zeros((rows, BANDS), U)
            for j in range(wide.shape[2]):
                band = mix(band + wide[:, :, j] + ODD)
            band = (mix(band + np.arange(BANDS, dtype=U) * ODD)).astype(np.int64)
            short = (signature & U(0xFFFF)).astype("<u2")
            offsets = np.concatenate([[0], np.cumsum(has * BANDS)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").slice(words.first, rows),
                    batch.column("node").slice(words.first, rows),
                    pa.array([x.tobytes() for x in short], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(band[has].reshape(-1))),
                ],
                ["id", "node", "signature", "bands"],
            )
            done = words.last
        assert done == batch.num_rows


def _shingle_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts of a block hold each shingle."""
    for batch in batches:
        for words in hashed_words(batch.column("text")):
            _, s, _ = shingles(words, words.last - words.first)
            s, n = np.unique(s.astype(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(n)], ["shingle", "n"])


def _rarest(sent):
    """The rarest shingles of each text up to a share of 1 - SIMILAR of its weight. `first` marks
    those up to (1 - SIMILAR) / (1 + SIMILAR). Frequent shingles come last, by their counts; the
    others are ordered by their hashes, so that the order is the same for all texts. `rest` is the
    weight from the shingle on."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, count = sent.value
        for batch in batches:
            nodes = batch.column("node").to_numpy()
            for words in hashed_words(batch.column("text")):
                rows = words.last - words.first
                row, s, weight = shingles(words, rows)
                s = s.astype(np.int64)
                often = np.zeros(len(s), np.int64)
                if len(frequent):
                    at = np.searchsorted(frequent, s).clip(max=len(frequent) - 1)
                    often = np.where(frequent[at] == s, count[at], 0)
                order = np.lexsort((s, often, row))
                row, s, weight = row[order], s[order], weight[order]
                total = np.bincount(row, weights=weight, minlength=rows)
                before = np.cumsum(weight) - weight - (np.cumsum(total) - total)[row]
                total = total[row]
                rest = (total - before).astype(np.int64)
                on = before <= (1 - SIMILAR) * total + 1e-6
                first = before <= (1 - SIMILAR) / (1 + SIMILAR) * total + 1e-6
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(nodes[words.first : words.last][row[on]]),
                        pa.array(s[on]),
                        pa.array(total[on].astype(np.int64)),
                        pa.array(rest[on]),
                        pa.array(first[on]),
                    ],
                    ["node", "shingle", "total", "rest", "first"],
                )

    return find


def _counts(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for words in hashed_words(column):
        rows = words.last - words.first
        row, s, weight = shingles(words, rows)
        at = np.searchsorted(row, np.arange(rows + 1))
        out += [(s[a:b], weight[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
    return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sorted lists of shingles."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = np.minimum(a[1][i], b[1][j]).sum()
    total = a[1].sum() + b[1].sum() - common
    return float(common / total) if total else 1.0


def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs with the exact similarity of their texts, a few at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            left, right = _counts(part.column("left_text")), _counts(part.column("right_text"))
            score = [similarity(a, b) for a, b in zip(left, right, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column("left"), part.column("right"), pa.array(score, pa.float64())],
                ["left", "right", "similarity"],
            )


def estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose signatures agree enough, with how much and their other columns."""
    for batch in batches:
        size = 2 * COORDINATES
        a, b = (
            np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, size)
            for c in ("left_signature", "right_signature")
        )
        same = (a.view("<u2") == b.view("<u2")).mean(axis=1)
        pairs = batch.drop_columns(["left_signature", "right_signature"])
        yield pairs.append_column("same", pa.array(same)).filter(pa.array(same >= ESTIMATE))


CLOSE = "left long, right long, same double"


def _verified(stage: Stage, close: DataFrame, texts: DataFrame, name: str) -> DataFrame:
    """The pairs whose texts are similar enough. Every join is by equality on a side that a large
    group may repeat; adaptive execution splits such parts."""
    wanted = close.select(F.explode(F.array("left", "right")).alias("node")).distinct()
    wanted = stage.put(wanted, f"wanted_{name}")
    if wanted.count() <= BROADCAST_NODES:
        wanted = F.broadcast(wanted)
    texts = texts.join(wanted, "node").groupBy("node").agg(F.first("text").alias("text"))
    texts = stage.put(texts, f"texts_{name}")
    exact = (
        spread(close)
        .join(texts.toDF("left", "left_text"), "left")
        .join(texts.toDF("right", "right_text"), "right")
        .select("left", "right", "left_text", "right_text")
        .mapInArrow(verified, "left long, right long, similarity double")
        .filter(F.col("similarity") >= SIMILAR)
    )
    return stage.put(exact, f"links_{name}")


def _compared(stage: Stage, pairs: DataFrame, nodes: DataFrame, texts: DataFrame, name: str):
    """The pairs that are similar enough, first by their signatures, then by their texts."""
    sign = nodes.select("node", "signature")
    close = (
        pairs.join(sign.toDF("left", "left_signature"), "left")
        .join(sign.toDF("right", "right_signature"), "right")
        .select("left", "right", "left_signature", "right_signature")
        .mapInArrow(estimated, CLOSE)
    )
    return _verified(stage, stage.put(close, f"close_{name}"), texts, name)


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("left"), F.greatest(a, b).alias("right")]


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components so far."""
    lab = labels.select("node", "component")
    return (
        pairs.join(lab.toDF("left", "a"), "left", "left")
        .join(lab.toDF("right", "b"), "right", "left")
        .filter(F.coalesce("a", "left") != F.coalesce("b", "right"))
        .drop("a", "b")
    )


def _unsettled(stage: Stage, members: DataFrame, bands: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, component) of the members of larger bands that hold more than one component."""
    own = F.coalesce("component", "node")
    large = stage.put(
        members.join(bands.filter(F.col("n") > COVERED).select("key"), "key")
        .join(labels.select("node", "component"), "node", "left")
        .select("key", "node", own.alias("component")),
        "large_bands",
    )
    mixed = large.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b"))
    mixed = mixed.filter("a != b").select("key")
    return stage.put(large.join(mixed, "key").select("node", "component").distinct(), "unsettled")


def _meeting(stage: Stage, unsettled: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(left, right, a, b, same): pairs of the components a and b that may be similar enough. Where a shingle
    is held by several components, the members of all but the largest look for partners. Rows carry
    their signatures, so that a pair is ruled out where it meets."""
    spark = unsettled.sparkSession
    few = F.broadcast(unsettled) if unsettled.count() <= BROADCAST_NODES else unsettled
    signed = stage.put(nodes.select("node", "signature").join(few, "node"), "signed")
    texts = texts.join(few.select("node"), "node").groupBy("node").agg(F.first("text").alias("text"))
    texts = stage.put(texts, "texts_unsettled")
    counts = spread(texts).mapInArrow(_shingle_counts, "shingle long, n long")
    counts = stage.put(counts.groupBy("shingle").agg(F.sum("n").alias("n")), "shingle_counts")
    total = counts.agg(F.sum("n")).first()[0]
    frequent = counts.filter((F.col("n") > 1) & (F.col("n") * FREQUENT > total)).orderBy("shingle").toArrow()
    sent = spark.sparkContext.broadcast((frequent.column("shingle").to_numpy(), frequent.column("n").to_numpy()))
    rare = spread(texts).mapInArrow(_rarest(sent), "node long, shingle long, total long, rest long, first boolean")
    rare = stage.put(rare.join(few, "node"), "rarest")
    shared = rare.groupBy("shingle", "component").agg(F.count("*").alias("n"), F.max("first").alias("first"))
    shared = shared.groupBy("shingle").agg(
        F.count("*").alias("parts"),
        F.max("first").alias("any_first"),
        F.max_by("component", F.struct("n", "component")).alias("largest"),
    )
    shared = shared.filter("parts > 1 and any_first").select("shingle", "largest")
    rare = stage.put(rare.join(shared, "shingle").join(signed.drop("component"), "node"), "rarest_shared")
    columns = ("", "_total", "_rest", "_first", "_component", "_signature")
    own = ["shingle", "node", "total", "rest", "first", "component", "signature"]
    probe = rare.filter("component != largest").select(*own)
    met = probe.toDF("shingle", *(f"a{c}" for c in columns)).join(
        rare.select(*own, "largest").toDF("shingle", *(f"b{c}" for c in columns), "largest"), "shingle"
    )
    # Two that both look for partners meet once.
    once = (F.col("b_component") == F.col("largest")) | (F.col("a") < F.col("b"))
    shorter = F.when(F.col("a_total") < F.col("b_total"), F.col("a_first")).when(
        F.col("a_total") > F.col("b_total"), F.col("b_first")
    ).otherwise(F.col("a_first") | F.col("b_first"))
    # The first shingle in common: no more than the weights from it on can be shared.
    needed = SIMILAR / (1 + SIMILAR) * (F.col("a_total") + F.col("b_total")) - 1e-6
    met = met.filter(
        (F.col("a_component") != F.col("b_component"))
        & once
        & shorter
        & (F.least("a_rest", "b_rest") >= needed)
    )
    names = ["", "_component", "_signature"]
    one, other = (F.struct(*[F.col(f"{c}{n}").alias(f"x{n}") for n in names]) for c in ("a", "b"))
    first = F.col("a") < F.col("b")
    close = (
        met.select(F.when(first, one).otherwise(other).alias("l"), F.when(first, other).otherwise(one).alias("r"))
        .select(
            F.col("l.x").alias("left"),
            F.col("r.x").alias("right"),
            F.col("l.x_component").alias("a"),
            F.col("r.x_component").alias("b"),
            F.col("l.x_signature").alias("left_signature"),
            F.col("r.x_signature").alias("right_signature"),
        )
        .mapInArrow(estimated, "left long, right long, a long, b long, same double")
    )
    return close.groupBy("left", "right", "a", "b").agg(F.max("same").alias("same"))


def _settled(stage: Stage, labels: DataFrame, close: DataFrame, texts: DataFrame) -> DataFrame:
    """`labels` after all links among the close pairs. First only the closest pair of every two
    components is compared, and again after these were joined, so that few of the many pairs within
    what belongs together are left when all are."""
    for turn in range(CLOSEST_TURNS + 1):
        pairs = close.select("left", "right", "same")
        if turn < CLOSEST_TURNS:
            closest = F.max_by(F.struct("left", "right", "same"), F.struct("same", "left", "right"))
            two = close.groupBy(F.least("a", "b"), F.greatest("a", "b"))
            pairs = stage.put(two.agg(closest.alias("pair")).select("pair.*"), f"closest_{turn}")
        found = _verified(stage, pairs, texts, f"rest_{turn}")
        labels = merged(stage, labels, found, f"third_{turn}")
        if turn < CLOSEST_TURNS:
            # A component's number is a node, which has the number of the component it is in now.
            lab = labels.select("node", "component")
            close = (
                close.join(pairs.select("left", "right"), ["left", "right"], "left_anti")
                .join(lab.toDF("a", "now_a"), "a", "left")
                .join(lab.toDF("b", "now_b"), "b", "left")
                .select("left", "right", "same", F.coalesce("now_a", "a").alias("a"), F.coalesce("now_b", "b").alias("b"))
                .filter("a != b")
            )
            close = stage.put(close, f"apart_{turn}")
    return labels


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): each row's id, text digest and node; each node's class with the smallest id
    of the class and its number of rows."""
    stage = Stage(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))
    rows = rows.withColumn("node", F.xxhash64("text"))
    kind = rows.schema["id"].dataType.simpleString()
    signed = spread(rows).mapInArrow(
        signatures, f"id {kind}, node long, signature binary, bands array<long>"
    )
    nodes = stage.put(
        signed.groupBy("node").agg(
            F.min("id").alias("first_id"),
            F.count("*").alias("n_rows"),
            F.first("signature").alias("signature"),
            F.first("bands").alias("bands"),
        ),
        "nodes",
    )
    ids, texts = nodes.select("node", "first_id", "n_rows"), rows.select("node", "text")
    members = nodes.select("node", F.explode("bands").alias("key"))
    bands = members.groupBy("key").agg(
        F.count("*").alias("n"), F.array(F.min("node"), F.max("node")).alias("leaders")
    )
    bands = stage.put(bands.filter("n > 1"), "bands")
    of_two = bands.filter("n = 2").select(
        F.col("leaders")[0].alias("node"), F.col("leaders")[1].alias("leader")
    )
    of_more = members.join(bands.filter("n > 2"), "key").select(
        "node", F.explode(F.array_distinct("leaders")).alias("leader")
    )
    pairs = (
        of_two.unionAll(of_more)
        .filter("node != leader")
        .select(*_ordered("node", "leader"))
        .groupBy("left", "right")
        .agg(F.count("*").alias("shared"))
    )
    pairs = stage.put(pairs, "pairs")
    # First each document with one partner, the one with the smallest number among those that share
    # most bands; then what lies apart; then the larger bands that still hold several components.
    half = F.when(F.col("shared") >= 8, 1).otherwise(0)
    best = (
        pairs.select("left", "right", "shared", half.alias("half"))
        .groupBy("right")
        .agg(F.max_by("left", F.struct("half", -F.col("left"))).alias("left"))
        .select("left", "right")
    )
    links = _compared(stage, best, nodes, texts, "best")
    labels = components(stage, links, "first")
    more = _compared(stage, _apart(pairs, labels), nodes, texts, "more")
    labels = merged(stage, labels, more, "second")
    unsettled = _unsettled(stage, members, bands, labels)
    if not unsettled.isEmpty():
        met = stage.put(_meeting(stage, unsettled, nodes, texts), "met")
        labels = _settled(stage, labels, met, texts)
    classes = ids.join(labels, "node", "left").select(
        "node", F.coalesce("component", "node").alias("class"), "first_id", "n_rows"
    )
    heads = classes.groupBy("class").agg(
        F.min("first_id").alias("class_id"),
        F.min(F.struct(F.isnull("first_id").alias("none"), "first_id", "node")).alias("head"),
        F.sum("n_rows").alias("class_size"),
    )
    classes = classes.join(heads, "class").select(
        "node",
        "class_id",
        "class_size",
        "first_id",
        "n_rows",
        (F.col("head.node") == F.col("node")).alias("head"),
    )
    return rows.select("id", "node"), stage.put(classes, "classes")


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
    """One row per row of `docs`: its id, the smallest id of its class and the class's rows."""
    rows, classes = near_duplicates(docs, id_col, text_col)
    return rows.join(classes, "node").select(
        F.col("id").alias(id_col), "class_id", "class_size"
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row with the smallest id of each class, with all its columns; equal rows leave one."""
    _, classes = near_duplicates(docs, id_col, text_col)
    heads = classes.filter("head").select("node", F.col("first_id").alias("head_id"), "n_rows")
    # The columns of `docs` stay in a struct, so that their names can't clash.
    rows = docs.select(
        F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(whole(text_col)).alias("of")
    )
    kept = rows.join(heads, (F.col("of") == F.col("node")) & F.col("id").eqNullSafe(F.col("head_id")))
    once = kept.filter("n_rows = 1").select("row")
    repeated = kept.filter("n_rows > 1").dropDuplicates(["of"]).select("row")
    return once.unionAll(repeated).select("row.*")
