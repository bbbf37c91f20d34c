"""Statistics of downloads, processing, sessions and models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def download_statistics(files: DataFrame, start: Column, end: Column) -> DataFrame:
    """format, files, bytes in a time range; a null format is the total."""
    return files.where((F.col("ts") >= start) & (F.col("ts") <= end)).rollup("format").agg(F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def session_statistics(sessions: DataFrame) -> DataFrame:
    """One row: totals, reviewed and training sessions, mean rating and gain, 0 where there is none."""
    return sessions.agg(
        F.count("*").alias("sessions"),
        F.count_if("reviewed").alias("reviewed"),
        F.count_if("training").alias("training"),
        F.coalesce(F.avg("rating"), F.lit(0.0)).alias("mean_rating"),
        F.coalesce(F.avg("improvement"), F.lit(0.0)).alias("mean_improvement"),
    )


def histograms(rows: DataFrame, *columns: str) -> DataFrame:
    """name, value, n: a histogram of each column, in one pass."""
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns)))
    return rows.select(cells.alias("c")).groupBy("c.name", "c.value").agg(F.count("*").alias("n"))


def processing(events: DataFrame) -> DataFrame:
    """One row of all processing events (seconds, success)."""
    return events.agg(F.count("*").alias("total"), F.count_if("success").alias("succeeded"), F.count_if(~F.col("success")).alias("failed"), F.coalesce(F.avg("seconds"), F.lit(0.0)).alias("mean_seconds"))


def latest(events: DataFrame, n: int, time: str = "ts", key: str = "event_id") -> DataFrame:
    """The n latest events: a top-n, not a sort of all."""
    return events.orderBy(F.col(time).desc(), F.col(key).desc()).limit(n)


def throughput(events: DataFrame, now: Column, hours: float) -> DataFrame:
    """One row of the trailing hours: counts, mean seconds, documents an hour and success rate; zeros if empty."""
    some = events.where((F.col("ts") > now - F.expr(f"interval {int(hours * 3600)} seconds")) & (F.col("ts") <= now))
    return processing(some).withColumn("per_hour", F.col("total") / hours).withColumn("success_rate", F.when(F.col("total") > 0, F.col("succeeded") / F.col("total")).otherwise(0.0))


def shortfalls(stats: DataFrame, concurrency: Column) -> DataFrame:
    """The requirements not met: 100 documents an hour, 30 seconds on average, 5 at a time, 99 of 100 successful."""
    reasons = F.array_compact(F.array(F.when(F.col("per_hour") < 100, "throughput"), F.when(F.col("mean_seconds") > 30, "latency"), F.when(concurrency < 5, "concurrency"), F.when(F.col("success_rate") < 0.99, "success")))
    return stats.select(reasons.alias("reasons"), (F.size(reasons) == 0).alias("met"))


def daily(events: DataFrame) -> DataFrame:
    return events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("total"), F.count_if("success").alias("succeeded"), F.avg("seconds").alias("mean_seconds"))


def hourly(events: DataFrame) -> DataFrame:
    return events.groupBy(F.date_format("ts", "HH:00").alias("hour")).agg(F.count("*").alias("total"), F.avg("seconds").alias("mean_seconds"))


def top_errors(events: DataFrame, n: int = 5) -> DataFrame:
    """The most frequent messages of failures."""
    return events.where(~F.col("success")).groupBy("message").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "message").limit(n)


def model_summary(runs: DataFrame) -> DataFrame:
    """By model: runs, mean, least, greatest and deviation of the score and the seconds."""
    parts = [f(c).alias(f"{name}_{c}") for c in ("score", "seconds") for name, f in (("mean", F.avg), ("min", F.min), ("max", F.max), ("sd", F.stddev_samp))]
    return runs.groupBy("model").agg(F.count("*").alias("runs"), *parts)


def word_confidence(words: DataFrame, *keys: str) -> DataFrame:
    """keys, mean and median of the confidences that aren't negative; 0 and 0 where there is none."""
    good = F.when(F.col("confidence") >= 0, F.col("confidence"))
    return words.groupBy(*keys).agg(F.coalesce(F.avg(good), F.lit(0.0)).alias("mean"), F.coalesce(F.median(good), F.lit(0.0)).alias("median"))


def level_counts(rows: DataFrame) -> DataFrame:
    """One row: cases by level, and those not breached."""
    return rows.agg(*(F.count_if(F.col("level") == i).alias(n) for i, n in enumerate(("none", "warning", "critical", "breached"))), F.count_if(~F.col("breached")).alias("active"))
