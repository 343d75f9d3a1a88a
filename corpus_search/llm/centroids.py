"""Centroid clustering (k-means with integer vectors) by column expressions alone.

The centroids are literals of the plan: `zip_with` and `aggregate` give a vector's squared distance
from each, `array_min` over (distance, number) structs chooses, and 64 column sums and a count per
cluster, added up in the tasks before they are shuffled, give the next centroids. A round moves one
row per cluster and task, whatever a cluster holds; the driver sees 16 rows of sums.

Rows
    vectors that are null, of another width, or hold a null or non-finite component are left out; so
    are those whose squared length in integers is 2**60 or more, since distances would leave the
    range of a long. Rows with a null id are clustered, but start as centroids only where there are
    too few others. Repeated rows count each. Fewer vectors than clusters give fewer centroids; an
    empty table gives no row. Ties go to the smaller cluster, equal hashes to the smaller vector.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_search.llm.tables import Stage, spread

CLUSTERS = 16
ROUNDS = 3
WIDTH = 64
SCALE = 64
LONGEST = 2.0**60


def integers(
    vector: Column, width: int | None, scale: int, longest: float = LONGEST
) -> Column:
    """floor(scale * x) of each component, or null if the vector is left out. Any width is right if
    none is given."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    scaled = F.transform(vector, lambda v: F.floor(v.cast("double") * scale))
    length = F.aggregate(
        vector, F.lit(0.0), lambda s, v: s + (v.cast("double") * scale) * (v.cast("double") * scale)
    )
    there = vector.isNotNull() if width is None else F.size(vector) == width
    return F.when(there & fine & (length < longest), scaled)


def squared_distance(vector: Column, centroid: Sequence[int]) -> Column:
    literal = F.expr(f"array({', '.join(f'{c}L' for c in centroid)})")
    return F.aggregate(
        F.zip_with(vector, literal, lambda a, b: (a - b) * (a - b)),
        F.lit(0).cast("long"),
        lambda total, square: total + square,
    )


def nearest(vector: Column, centroids: Sequence[Sequence[int]]) -> Column:
    """Struct of the smallest squared distance and the smallest cluster that has it."""
    return F.array_min(
        F.array(
            *[
                F.struct(squared_distance(vector, c).alias("distance"), F.lit(i).alias("cluster"))
                for i, c in enumerate(centroids)
            ]
        )
    )


def first_centroids(kept: DataFrame, clusters: int) -> list[list[int]]:
    """The vectors whose ids have the smallest hashes; a task hands on `clusters` rows at most."""
    seed = F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256)
    rows = kept.select(seed.alias("seed"), "v").orderBy(F.asc_nulls_last("seed"), "v").limit(clusters)
    return [list(row["v"]) for row in rows.collect()]


def moved(kept: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Every non-empty centroid replaced by the floor of its vectors' mean."""
    width = len(centroids[0])
    sums = (
        kept.select(nearest(F.col("v"), centroids)["cluster"].alias("cluster"), "v")
        .groupBy("cluster")
        .agg(F.count("*").alias("n"), *[F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(width)])
    )
    out = list(centroids)
    for row in sums.collect():  # a row per cluster
        out[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(width)]
    return out


def digest(centroid: Sequence[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def clustered(
    vectors: DataFrame,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    width: int = WIDTH,
    scale: int = SCALE,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector kept."""
    spark = vectors.sparkSession
    stage = Stage(spark)
    rows = vectors.select(
        F.col(id_col).alias("id"), integers(F.col(vector_col), width, scale).alias("v")
    )
    kept = stage.put(spread(rows).filter("v is not null"), "kept")
    centroids = first_centroids(kept, clusters)
    if centroids:
        for _ in range(rounds):
            centroids = moved(kept, centroids)
        found = kept.select("id", nearest(F.col("v"), centroids).alias("to")).select(
            "id", F.col("to.cluster").alias("cluster"), F.col("to.distance").alias("distance")
        )
    else:
        found = kept.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
    found = stage.put(found, "found")
    sums = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()
    total = sum(row["cluster_inertia"] for row in sums)
    of = spark.createDataFrame(
        [(r["cluster"], r["cluster_inertia"], total, digest(centroids[r["cluster"]])) for r in sums],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return found.join(F.broadcast(of), "cluster").select(
        F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def oracle_sql() -> str:
    """The same over `embeddings` in SQL."""
    parts = [
        f"""
v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {WIDTH}
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
c0 AS (
  SELECT CAST(row_number() OVER (ORDER BY h) AS INTEGER) - 1 AS cluster, e FROM (
    SELECT sha256('1:' || CAST(vec_id AS VARCHAR)) AS h, e FROM v ORDER BY h LIMIT {CLUSTERS}
  )
)"""
    ]

    def assigned(i):
        return f"""
d{i} AS (
  SELECT v.vec_id, c.cluster,
    CAST(list_sum(list_transform(range(1, {WIDTH + 1}), lambda j: (v.e[j] - c.e[j]) * (v.e[j] - c.e[j]))) AS BIGINT) AS distance
  FROM v CROSS JOIN c{i} AS c
),
a{i} AS (
  SELECT vec_id, cluster, distance FROM (
    SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) AS r FROM d{i}
  ) WHERE r = 1
)"""

    for i in range(ROUNDS):
        parts.append(assigned(i))
        parts.append(
            f"""
m{i} AS (
  SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY j) AS e FROM (
    SELECT a.cluster, j.j, CAST(sum(v.e[j.j]) AS BIGINT) AS s, CAST(count(*) AS BIGINT) AS n
    FROM a{i} AS a JOIN v ON v.vec_id = a.vec_id CROSS JOIN (SELECT unnest(range(1, {WIDTH + 1})) AS j) AS j
    GROUP BY ALL
  ) GROUP BY cluster
),
c{i + 1} AS (
  SELECT c.cluster, coalesce(m.e, c.e) AS e FROM c{i} AS c LEFT JOIN m{i} AS m ON m.cluster = c.cluster
)"""
        )
    parts.append(assigned(ROUNDS))
    return f"""
WITH {",".join(parts)}
SELECT a.vec_id, a.cluster, a.distance,
  CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM a{ROUNDS} AS a JOIN c{ROUNDS} AS c ON c.cluster = a.cluster
"""
