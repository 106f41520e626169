"""Crawled postings as a stream: each address once within the watermark, and weekly counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from jobweave.sources.schema import POSTING


def read(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(POSTING).json(folder)


def first_seen(postings: DataFrame, delay: str = "14 days") -> DataFrame:
    """The first row of each address within the delay; rows without a readable time or address are left out."""
    t = F.try_to_timestamp(F.regexp_replace("crawl_timestamp", r"^(\d{4}-\d{2}-\d{2}) ", "$1T"))
    return postings.withColumn("crawled_at", t).filter("crawled_at IS NOT NULL AND trim(source_url) <> ''").withWatermark("crawled_at", delay).dropDuplicatesWithinWatermark(["source_url"])


def weekly(postings: DataFrame) -> DataFrame:
    """(week, source, n) in tumbling weeks that begin on Mondays."""
    w = F.window("crawled_at", "7 days", "7 days", "4 days")
    return postings.groupBy(w.alias("w"), "source").agg(F.count("*").alias("n")).select(F.col("w.start").alias("week"), "source", "n")


def write(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
