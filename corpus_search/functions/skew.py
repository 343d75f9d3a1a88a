"""Lookups by keys of very uneven frequency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is heavy when it holds more than one part in HEAVY_KEYS of all rows. The weights add up to
# the number of rows, so fewer than HEAVY_KEYS keys can be heavy, whatever the data.
HEAVY_KEYS = 20_000

# Parts that the rows of one heavy key are dealt out over.
SALTS = 64


def join_by_weight(
    rows: DataFrame,
    lookup: DataFrame,
    key: str,
    weight: str,
    heavy_keys: int = HEAVY_KEYS,
) -> DataFrame:
    """Inner join of `rows` with one `lookup` row per key, where `weight` is the number of `rows`
    that hold the key.

    Heavy keys are broadcast (fewer than `heavy_keys` of them), so their rows are joined where they
    are. Only rows of the other keys are shuffled, and no such key holds more than one part in
    `heavy_keys` of all rows.
    """
    total = lookup.agg(F.sum(weight)).scalar()
    heavy = F.col(weight) * F.lit(heavy_keys) > total
    heavy_lookup = F.broadcast(lookup.filter(heavy))
    light_lookup = lookup.filter(~heavy)
    in_place = rows.join(heavy_lookup, key)
    shuffled = rows.join(heavy_lookup.select(key), key, "left_anti").join(light_lookup, key)
    return in_place.unionByName(shuffled)


def join_salted(
    rows: DataFrame,
    others: DataFrame,
    key: str,
    spread_by: list[str],
    heavy_keys: int = HEAVY_KEYS,
    salts: int = SALTS,
) -> DataFrame:
    """Inner join where a key may be frequent in `rows` and occur many times in `others` as well.

    The rows of a heavy key are dealt out over `salts` parts by the columns `spread_by`, and the
    other side has a copy of that key's rows for every part. Other keys are joined as they are.
    """
    weights = rows.groupBy(key).agg(F.count("*").alias("weight"))
    total = weights.agg(F.sum("weight")).scalar()
    heavy = F.broadcast(
        weights.filter(F.col("weight") * F.lit(heavy_keys) > total).select(
            key, F.lit(True).alias("is_heavy")
        )
    )
    part = F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")
    salted = rows.join(heavy, key, "left").withColumn(
        "salt", F.when(F.col("is_heavy"), part).otherwise(0)
    )
    every_part = F.sequence(F.lit(0), F.lit(salts - 1))
    copied = others.join(heavy, key, "left").withColumn(
        "salt", F.explode(F.when(F.col("is_heavy"), every_part).otherwise(F.array(F.lit(0))))
    )
    return salted.drop("is_heavy").join(copied.drop("is_heavy"), [key, "salt"]).drop("salt")


def broadcast_if_bounded(rows: DataFrame, row_bound: int, limit: int) -> DataFrame:
    """`rows` with a broadcast hint when they are known to be at most `limit`, else unchanged, which
    leaves the join to a shuffle."""
    return F.broadcast(rows) if row_bound <= limit else rows
