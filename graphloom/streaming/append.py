"""Append mode as streams: files and answers that arrive are taken up once, and what they touch is merged."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def new_files(spark: SparkSession, batch: DataFrame, state: str) -> DataFrame:
    """Rows of a batch (source_file, content) that are new or altered against the manifest table at `state`, with their hash."""
    now = batch.withColumn("sha256", F.sha2(F.col("content").cast("binary"), 256)).dropDuplicates(["source_file", "sha256"])
    try:
        old = spark.read.parquet(state)
    except Exception as e:  # nothing was written yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return now
    last = old.groupBy("source_file").agg(F.max_by("sha256", "taken_at").alias("sha256"))
    return now.join(last, ["source_file", "sha256"], "left_anti")


def append_stream(spark: SparkSession, source: DataFrame, state: str, checkpoint: str) -> StreamingQuery:
    """Writes every new or altered file of a stream (source_file, content) to the manifest at `state`. A batch that runs again overwrites its own part, so each file is taken up once."""
    stream = hashlib.sha1(checkpoint.encode()).hexdigest()[:8]

    def upsert(batch: DataFrame, number: int) -> None:
        new_files(spark, batch, state).withColumn("taken_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{state}/batch={stream}-{number}")

    return source.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def answers_stream(spark: SparkSession, answers: DataFrame, tasks: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Joins a stream of answers (task_id, answer) with the table of tasks; unknown ones are left out."""
    joined = answers.join(tasks.select("task_id", "label"), "task_id")
    return joined.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Extension: events per type and window of event time, with a watermark. Works on streams and tables alike."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
