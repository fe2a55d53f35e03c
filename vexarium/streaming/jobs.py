"""Queue consumers as Structured Streaming: messages of ids to jobs, jobs to versions, and run counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def id_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """(cve_id, received) from a folder of text files whose lines are JSON arrays of ids; a message is received when its file was written. Empty ids are dropped."""
    s = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    return s.select(F.explode(F.from_json("value", "array<string>")).alias("cve_id"), F.col("_metadata.file_modification_time").alias("received")).filter(F.col("cve_id") != "")


def version_stream(spark: SparkSession, path: str) -> DataFrame:
    """(vuln_version_id) from messages such as {"vulnVersionId": 7}."""
    return spark.readStream.text(path).select(F.from_json("value", "vulnVersionId bigint")["vulnVersionId"].alias("vuln_version_id")).filter("vuln_version_id is not null")


def distinct_jobs(stream: DataFrame, within: str = "1 day") -> DataFrame:
    """Each id once within the watermark, so the state doesn't grow without end."""
    return stream.withWatermark("received", within).dropDuplicatesWithinWatermark(["cve_id"])


def run_batches(stream: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Runs the batch operators of `work` on each micro-batch and writes its result under the batch's number.

    A batch that is repeated after a failure overwrites its own folder, so its effect is the same."""

    def each(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fan_out(stream: DataFrame, outs: list[str], checkpoint: str) -> StreamingQuery:
    """Each message to all of several queues (folders)."""

    def each(batch: DataFrame, number: int) -> None:
        for o in outs:
            batch.write.mode("overwrite").json(f"{o}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_counts(stream: DataFrame) -> DataFrame:
    """Jobs and distinct ids so far, for a complete-mode sink."""
    return stream.agg(F.count("*").alias("jobs"), F.approx_count_distinct("cve_id").alias("ids"))


def windowed_events(events: DataFrame, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """(window_start, event_type, n, total): tumbling windows over (ts, event_type, value), batch or stream alike."""
    g = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", size), "event_type")
    return g.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


def session_events(events: DataFrame, gap: str = "1 hour") -> DataFrame:
    """(user_id, session_start, n): sessions split by gaps."""
    g = events.withColumn("ts", F.col("ts").cast("timestamp")).groupBy("user_id", F.session_window("ts", gap))
    return g.agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("session_start"), "n")
