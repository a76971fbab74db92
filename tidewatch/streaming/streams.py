"""Streams: seen URLs, prediction logs, windows over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A stream of Parquet files; their times without zone become times of the session's zone."""
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(rows: DataFrame, size: str, late: str | None = None) -> DataFrame:
    r = rows.withWatermark("ts", late) if late else rows
    return r.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(rows: DataFrame, size: str, step: str, late: str | None = None) -> DataFrame:
    r = rows.withWatermark("ts", late) if late else rows
    return r.groupBy(F.window("ts", size, step)).agg(F.count("*").alias("n"), F.approx_count_distinct("user_id").alias("users")).select(F.col("window.start").alias("start"), "n", "users")


def sessions(rows: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    r = rows.withWatermark("ts", late) if late else rows
    return r.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def first_seen(rows: DataFrame, key: str = "url", late: str | None = None) -> DataFrame:
    """ST3: each key once; with a watermark its memory is bounded."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]) if late else rows.dropDuplicates([key])


def run_once(stream: DataFrame, to: str, checkpoint: str, mode: str = "append") -> None:
    """ST5: all that is there, in order, then the end; a rerun goes on where it stopped (ST2)."""
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    q.format("parquet").option("path", to).start().awaitTermination()


def prediction_log(stream: DataFrame, to: str, checkpoint: str) -> None:
    """ST4: scored rows are appended with their batch; a batch that is run again replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{to}/batch={batch_id}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
