"""Deadlines, escalation and retention. The time that counts as now is always given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workers import kept

#: Levels of escalation, and the hours left at which they begin.
NONE, WARNING, CRITICAL, BREACHED = 0, 1, 2, 3
CRITICAL_HOURS, WARNING_HOURS = 4, 24
ARCHIVE_DAYS, DELETE_DAYS = 365, 2555


def seconds_left(deadline: Column, now: Column) -> Column:
    return F.greatest(F.unix_seconds(deadline) - F.unix_seconds(now), F.lit(0))


def level(deadline: Column, now: Column) -> Column:
    left = seconds_left(deadline, now)
    return F.when(deadline <= now, BREACHED).when(left <= CRITICAL_HOURS * 3600, CRITICAL).when(left <= WARNING_HOURS * 3600, WARNING).otherwise(NONE)


def status(rows: DataFrame, now: Column, deadline: str = "deadline") -> DataFrame:
    """rows with seconds_left, breached, at_risk and level."""
    d = F.col(deadline)
    breached = d <= now
    return rows.withColumns({"seconds_left": seconds_left(d, now), "breached": breached, "at_risk": ~breached & (seconds_left(d, now) <= CRITICAL_HOURS * 3600), "level": level(d, now)})


def refresh(old: DataFrame, now: Column) -> DataFrame:
    """Statuses (deadline, level, escalated_at) as of now. The time of escalation changes only when the level changes
    to one that isn't none."""
    new = level(F.col("deadline"), now)
    return old.withColumn("new_level", new).withColumn("escalated_at", F.when((F.col("new_level") != F.col("level")) & (F.col("new_level") != NONE), now).otherwise(F.col("escalated_at"))).withColumn("level", F.col("new_level")).drop("new_level")


def escalate(rows: DataFrame, orders: DataFrame, now: Column, key: str = "case_id") -> DataFrame:
    """rows with the levels that orders (key, to_level) set by hand."""
    found = rows.join(orders, key, "left")
    changed = F.col("to_level").isNotNull()
    return found.withColumn("escalated_at", F.when(changed, now).otherwise(F.col("escalated_at"))).withColumn("level", F.coalesce("to_level", "level")).drop("to_level")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new, a new row taking an old one's place."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"))


def intake(received: Column, published: Column, now: Column) -> Column:
    return F.coalesce(received, published, now)


def retention(rows: DataFrame, now: Column, time: str = "ts", archive_days: int = ARCHIVE_DAYS, delete_days: int = DELETE_DAYS) -> DataFrame:
    """rows with what is to be done with them: keep, archive or delete."""
    age = F.unix_seconds(now) - F.unix_seconds(F.col(time))
    return rows.withColumn("fate", F.when(age > delete_days * 86400, "delete").when(age > archive_days * 86400, "archive").otherwise("keep"))


def batches(rows: DataFrame, size: int, order: str) -> DataFrame:
    """rows with the number of their batch of `size` in order, numbered within ranges of the order so that no task sees
    all rows: ranks by range are summed up to offsets first."""
    ranged = kept(rows.repartitionByRange(F.col(order)).withColumn("_p", F.spark_partition_id()))
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    offsets = sizes.select("_p", F.expr("coalesce(sum(_n) over (order by _p rows between unbounded preceding and 1 preceding), 0)").alias("_o"))
    numbered = ranged.withColumn("_r", F.expr(f"row_number() over (partition by _p order by {order})"))
    return numbered.join(F.broadcast(offsets), "_p").withColumn("batch", F.floor((F.col("_o") + F.col("_r") - 1) / size)).drop("_p", "_r", "_o")
