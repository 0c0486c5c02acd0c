"""Incremental runs: new files through a stream, results kept by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import sections as S


def page_stream(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    """New Parquet files of a folder, at most so many a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def quality_stream(pages: DataFrame) -> DataFrame:
    """Text quality of each arriving page; repeated deliveries within a week count once."""
    once = pages.withWatermark("scanned_at", "7 days").dropDuplicatesWithinWatermark(["page_id"])
    lined = S.with_lines(once, ["page_id", "club", "company_number", "year"])
    return S.page_quality(lined, ["page_id", "club", "company_number", "year"])


def scan_counts(pages: DataFrame, window: str = "30 days", late: str = "7 days") -> DataFrame:
    """(start, club, n): pages scanned per club and window, with late scans up to ``late``."""
    w = F.window("scanned_at", window)
    return pages.withWatermark("scanned_at", late).groupBy(w, "club").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "club", "n")


def run_available(stream: DataFrame, out: str, state: str) -> StreamingQuery:
    """Everything that has arrived, once, appended to Parquet; the next run goes on from there."""
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
