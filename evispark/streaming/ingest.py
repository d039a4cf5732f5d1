"""Incremental page ingestion by Structured Streaming (an engine extension).

Arriving page files become cleaned pages in batches; a batch that runs again overwrites its own folder, so a lost
executor or a restart leaves no duplicates. Late or repeated pages of a version keep the last write by file time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.text_etl import clean_pages
from ..schemas import PAGES


def ingest(spark: SparkSession, landing: str, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Start (once: drain and stop) the stream from JSON pages in `landing` to Parquet under `out`/batch=N."""
    pages = spark.readStream.schema(PAGES).json(landing).withColumn("seen_at", F.col("_metadata.file_modification_time"))

    def write(batch: DataFrame, number: int) -> None:
        clean_pages(batch.where("paper_version_id is not null and text is not null")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def current_pages(spark: SparkSession, out: str) -> DataFrame:
    """The last write of each page."""
    rows = spark.read.parquet(out)
    last = F.row_number().over(Window.partitionBy("paper_version_id", "page_number").orderBy(F.desc("seen_at"), F.desc("batch")))
    return rows.withColumn("nth", last).where("nth = 1").drop("nth", "seen_at", "batch")


def hourly_counts(spark: SparkSession, landing: str, schema: str, late: str = "1 hour") -> DataFrame:
    """Events(ts, event_type) by hour and type, late ones within a watermark."""
    events = spark.readStream.schema(schema).parquet(landing).withWatermark("ts", late)
    return events.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("events"))
