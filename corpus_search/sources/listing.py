"""Landed channel listings, and the records among them that cannot be read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpus_search.operators.ingest import parse_timestamp
from corpus_search.sources.schemas import LISTING, REJECTS

CORRUPT = "_corrupt_record"


def listing_items(listings: DataFrame) -> DataFrame:
    """One row per listed item: channel_id, video_id, published_at, title, kind. Absent fields are
    empty strings."""
    item = F.col("item")
    return listings.select("channel_id", F.explode("items").alias("item")).select(
        "channel_id",
        F.coalesce(item["id"]["videoId"], F.lit("")).alias("video_id"),
        F.coalesce(item["snippet"]["publishedAt"], F.lit("")).alias("published_at"),
        F.coalesce(item["snippet"]["title"], F.lit("")).alias("title"),
        F.coalesce(item["id"]["kind"], F.lit("unknown")).alias("kind"),
    )


def read_listings(spark: SparkSession, path: str) -> DataFrame:
    return listing_items(spark.read.schema(LISTING).json(path))


def landed_records(lines: DataFrame) -> DataFrame:
    """channel_id, items, record, source, reason of landed lines (`value`, `source`). The reason is
    null for a record that was read as a whole; of others, what could be read is there."""
    schema = T.StructType([*LISTING.fields, T.StructField(CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    parsed = F.from_json("value", schema, options)
    broken = F.col("parsed").isNull() | F.col(f"parsed.{CORRUPT}").isNotNull()
    reason = F.when(F.try_parse_json("value").isNull(), "malformed_json").otherwise("wrong_type")
    return (
        lines.filter(F.trim("value") != "")
        .withColumn("parsed", parsed)
        .select(
            "parsed.channel_id",
            "parsed.items",
            F.col("value").alias("record"),
            "source",
            F.when(broken, reason).alias("reason"),
        )
    )


def rejected(records: DataFrame) -> DataFrame:
    """channel_id, video_id, reason, record, source: a row for every record that was not read as a
    whole, and for every item that can't become a transcript. An item has its first reason."""
    unreadable = records.filter(F.col("reason").isNotNull()).select(
        "channel_id", F.lit(None).cast("string").alias("video_id"), "reason", "record", "source"
    )
    item = F.col("item")
    fields = {
        "missing_video_id": item["id"]["videoId"],
        "missing_published_at": item["snippet"]["publishedAt"],
        "missing_title": item["snippet"]["title"],
    }
    reason = F.coalesce(
        *[F.when(F.coalesce(value, F.lit("")) == "", name) for name, value in fields.items()],
        F.when(parse_timestamp(item["snippet"]["publishedAt"]).isNull(), "bad_date"),
    )
    items = (
        records.select("channel_id", "source", F.explode("items").alias("item"))
        .select(
            "channel_id",
            item["id"]["videoId"].alias("video_id"),
            reason.alias("reason"),
            F.to_json("item").alias("record"),
            "source",
        )
        .filter(F.col("reason").isNotNull())
    )
    return unreadable.unionByName(items).select(*REJECTS.fieldNames())


def read_landed(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(items, rejects) of landed files with a JSON record a line. No record is lost: what is not
    among the items is among the rejects."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("source"))
    records = landed_records(lines)
    return listing_items(records), rejected(records)
