"""Event streams: typed sub-streams, deduplication, windows, heartbeats, outbox and persistence.

The event time is the column ts. Late events are those more than `late` behind the latest one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
#: Audit action and stage of each kind of event.
AUDIT = {"signup": ("Download", "Ingestion"), "view": ("Extraction", "Extraction"), "click": ("Classification", "DecisionLogic"), "purchase": ("Export", "Export"), "error": ("Review", "Extraction")}


def read(spark: SparkSession, path: str, schema: str = EVENTS, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def of_type(events: DataFrame, *types: str) -> DataFrame:
    return events.where(F.col("event_type").isin(*types))


def unique(events: DataFrame, *keys: str, late: str = "1 hour") -> DataFrame:
    """The first event of each key within the lateness: a guard against replays whose state is bounded."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))


def windows(events: DataFrame, size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """start, total, succeeded, mean_seconds of each window of time."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w.alias("w")).agg(F.count("*").alias("total"), F.count_if(F.col("event_type") != "error").alias("succeeded"), F.avg("value").alias("mean_seconds")).select(F.col("w.start").alias("start"), "total", "succeeded", "mean_seconds")


def heartbeats(beats: DataFrame, now: Column, timeout_seconds: int, threshold: int) -> DataFrame:
    """worker, last, missed of workers that missed at least `threshold` beats; the last beat counts."""
    last = beats.groupBy("worker").agg(F.max("ts").alias("last"))
    missed = F.floor((F.unix_seconds(now) - F.unix_seconds("last")) / timeout_seconds)
    return last.withColumn("missed", missed).where(F.col("missed") >= threshold)


def audit_rows(events: DataFrame) -> DataFrame:
    """Events as audit records."""
    action = F.create_map(*(F.lit(x) for k, v in AUDIT.items() for x in (k, v[0])))
    stage = F.create_map(*(F.lit(x) for k, v in AUDIT.items() for x in (k, v[1])))
    return events.select("event_id", F.try_element_at(action, F.col("event_type")).alias("action"), F.try_element_at(stage, F.col("event_type")).alias("stage"), (F.col("event_type") != "error").alias("success"), "ts")


def pending(outbox: DataFrame, batch: int = 50, most: int = 5) -> DataFrame:
    """The oldest events that are neither processed nor dead and have tries left."""
    return outbox.where(F.col("processed_at").isNull() & F.col("dead_at").isNull() & (F.col("tries") < most)).orderBy("occurred_at", "event_id").limit(batch)


def after_try(outbox: DataFrame, results: DataFrame, now: Column, most: int = 5) -> DataFrame:
    """The outbox after an attempt (event_id, ok): done, or one try more and dead at the last."""
    r = outbox.join(results, "event_id", "left")
    failed = F.col("ok") == F.lit(False)
    tries = F.col("tries") + failed.cast("int")
    return r.select("event_id", "occurred_at", F.when(F.col("ok"), now).otherwise(F.col("processed_at")).alias("processed_at"), F.coalesce(tries, F.col("tries")).alias("tries"), F.when(failed & (tries >= most), now).otherwise(F.col("dead_at")).alias("dead_at"))


def append_new(batch: DataFrame, path: str, key: str = "event_id") -> None:
    """Appends the rows of a micro-batch whose key isn't stored yet, so that a batch that comes again adds nothing."""
    spark = batch.sparkSession
    new = batch.dropDuplicates([key])
    try:
        new = new.join(spark.read.parquet(path).select(key), key, "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    new.write.mode("append").parquet(path)


def run_to_end(stream: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Everything there is now, in micro-batches."""
    stream.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def write_to_end(stream: DataFrame, path: str, checkpoint: str) -> None:
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def watch(spark: SparkSession, path: str, schema: str, handler: Callable[[DataFrame, int], None], checkpoint: str, every: str = "30 seconds"):
    """The polling loop: new files of a folder go to the handler every so often."""
    return read(spark, path, schema).writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def observed(rows: DataFrame, name: str) -> DataFrame:
    """rows, with counters that a listener gets as they pass."""
    return rows.observe(name, F.count("*").alias("rows"), F.count_if(F.col("event_type") == "error").alias("errors"))
