"""Working days, as a table of days with their rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _monday(day: Column, month: int, nth: int) -> Column:
    """The nth Monday of a month."""
    return (F.month(day) == month) & (F.dayofweek(day) == 2) & (F.ceil(F.dayofmonth(day) / 7) == nth)


def is_holiday(day: Column) -> Column:
    """Mexican federal holidays: 1 January, first Monday of February, third of March, 1 May, 16 September, third Monday
    of November, 25 December and, each sixth year from 2024, 1 October."""
    fixed = F.date_format(day, "MM-dd").isin("01-01", "05-01", "09-16", "12-25")
    change = (F.date_format(day, "MM-dd") == "10-01") & (F.year(day) >= 2024) & ((F.year(day) - 2024) % 6 == 0)
    return fixed | _monday(day, 2, 1) | _monday(day, 3, 3) | _monday(day, 11, 3) | change


def working_days(spark: SparkSession, first: str, last: str, holidays: bool = True) -> DataFrame:
    """day, working, rank: the number of working days up to and including the day. One row a day, so a century is
    36,525 rows; that bounds what is broadcast."""
    days = spark.sql(f"select explode(sequence(date'{first}', date'{last}')) as day")
    free = F.dayofweek("day").isin(1, 7) | (is_holiday(F.col("day")) if holidays else F.lit(False))
    return days.withColumn("working", ~free).withColumn("rank", F.expr("sum(cast(working as int)) over (order by day)"))


def add_working_days(rows: DataFrame, start: str, n: str, calendar: DataFrame, out: str = "due") -> DataFrame:
    """rows with the day n working days after the start; the start itself for 0."""
    here = calendar.select(F.col("day").alias("_day"), F.col("rank").alias("_rank"))
    there = calendar.where("working").select(F.col("day").alias("_due"), F.col("rank").alias("_target"))
    found = rows.join(F.broadcast(here), F.col(start) == F.col("_day"), "left").join(F.broadcast(there), F.col("_rank") + F.col(n) == F.col("_target"), "left")
    return found.withColumn(out, F.when(F.col(n) == 0, F.col(start)).otherwise(F.col("_due"))).drop("_day", "_rank", "_due", "_target")


def count_working_days(rows: DataFrame, start: str, end: str, calendar: DataFrame, out: str = "days") -> DataFrame:
    """rows with the working days from the start to before the end; 0 if the end isn't after the start."""
    before = calendar.select(F.col("day").alias("_d"), (F.col("rank") - F.col("working").cast("int")).alias("_n"))
    a, b = before.select(F.col("_d").alias("_d1"), F.col("_n").alias("_n1")), before.select(F.col("_d").alias("_d2"), F.col("_n").alias("_n2"))
    found = rows.join(F.broadcast(a), F.col(start) == F.col("_d1"), "left").join(F.broadcast(b), F.col(end) == F.col("_d2"), "left")
    return found.withColumn(out, F.when(F.col(end) <= F.col(start), 0).otherwise(F.col("_n2") - F.col("_n1"))).drop("_d1", "_n1", "_d2", "_n2")
