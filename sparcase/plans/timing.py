"""Working days, deadlines and retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calendar as C
from ..operators import deadlines as D
from .registry import query, table

FIRST, LAST = "1991-01-01", "2005-12-31"
_HOLIDAY = """(strftime(day, '%m-%d') IN ('01-01', '05-01', '09-16', '12-25') OR (month(day) = 2 AND dayofweek(day) = 1 AND ceil(day(day) / 7.0) = 1) OR (month(day) = 3 AND dayofweek(day) = 1 AND ceil(day(day) / 7.0) = 3)
  OR (month(day) = 11 AND dayofweek(day) = 1 AND ceil(day(day) / 7.0) = 3) OR (strftime(day, '%m-%d') = '10-01' AND year(day) >= 2024 AND (year(day) - 2024) % 6 = 0))"""


def _days(holidays: bool) -> str:
    free = "dayofweek(day) IN (0, 6)" + (f" OR {_HOLIDAY}" if holidays else "")
    return f"cal AS (SELECT day, NOT ({free}) AS working, sum((NOT ({free}))::int) OVER (ORDER BY day) AS rank FROM (SELECT unnest(generate_series(date '{FIRST}', date '{LAST}', interval 1 day))::date AS day))"


_SLA = "sla AS (SELECT o_orderkey AS case_id, o_orderdate + to_days((1 + o_orderkey % 20)::int) AS deadline, timestamp '1995-06-15 12:00:00' AS now FROM orders)"


def _now():
    return F.lit("1995-06-15 12:00:00").cast("timestamp_ntz").cast("timestamp")


def _sla(spark, d):
    k = F.col("o_orderkey")
    day = F.col("o_orderdate").cast("timestamp")
    return table(spark, d, "orders").select(k.alias("case_id"), (day + F.make_dt_interval((1 + k % 20).cast("int"))).alias("deadline"))


def _due(holidays):
    return f"""WITH {_days(holidays)}, o AS (SELECT o_orderkey AS case_id, o_orderdate::date AS start, (o_orderkey % 12)::int AS n FROM orders)
    SELECT case_id, CASE WHEN n = 0 THEN start ELSE t.day END AS due FROM o LEFT JOIN cal h ON h.day = start LEFT JOIN cal t ON t.working AND t.rank = h.rank + n"""


def _add(spark, d, holidays):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), F.to_date("o_orderdate").alias("start"), (F.col("o_orderkey") % 12).cast("int").alias("n"))
    return C.add_working_days(o, "start", "n", C.working_days(spark, FIRST, LAST, holidays)).select("case_id", "due")


@query(_due(True))
def tim01_fus08_add_working_days(spark, d):
    return _add(spark, d, True)


@query(
    f"""WITH {_days(True)}, o AS (SELECT o_orderkey AS case_id, o_orderdate::date AS a, o_orderdate::date + (o_orderkey % 40 - 5)::int AS b FROM orders)
    SELECT case_id, CASE WHEN b <= a THEN 0 ELSE (SELECT count(*) FROM cal WHERE working AND day >= a AND day < b) END AS days FROM o"""
)
def tim02_count_working_days(spark, d):
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select(k.alias("case_id"), F.to_date("o_orderdate").alias("a"), F.date_add(F.to_date("o_orderdate"), (k % 40 - 5).cast("int")).alias("b"))
    return C.count_working_days(o, "a", "b", C.working_days(spark, FIRST, LAST)).select("case_id", F.col("days").cast("long").alias("days"))


@query(_due(False))
def tim03_weekends_only(spark, d):
    return _add(spark, d, False)


_LEVEL = "CASE WHEN deadline <= now THEN 3 WHEN epoch(deadline) - epoch(now) <= 4 * 3600 THEN 2 WHEN epoch(deadline) - epoch(now) <= 24 * 3600 THEN 1 ELSE 0 END"


@query(f"WITH {_SLA} SELECT case_id, greatest(epoch(deadline) - epoch(now), 0)::bigint AS seconds_left, deadline <= now AS breached, deadline > now AND epoch(deadline) - epoch(now) <= 4 * 3600 AS at_risk, {_LEVEL} AS level FROM sla")
def tim04_status(spark, d):
    return D.status(_sla(spark, d), _now()).select("case_id", "seconds_left", "breached", "at_risk", "level")


@query(f"WITH {_SLA}, o AS (SELECT *, (case_id % 4)::int AS level, {_LEVEL} AS new FROM sla) SELECT case_id, new AS level, CASE WHEN new <> level AND new <> 0 THEN 'now' ELSE 'old' END AS escalated FROM o")
def tim05_str08_refresh(spark, d):
    old = _sla(spark, d).withColumn("level", (F.col("case_id") % 4).cast("int")).withColumn("escalated_at", F.lit("1990-01-01").cast("timestamp"))
    return D.refresh(old, _now()).select("case_id", "level", F.when(F.year("escalated_at") == 1995, "now").otherwise("old").alias("escalated"))


@query(f"WITH {_SLA} SELECT case_id, CASE WHEN case_id % 50 = 0 THEN 2 ELSE {_LEVEL} END AS level, case_id % 50 = 0 AS by_hand FROM sla")
def tim06_escalate(spark, d):
    rows = D.status(_sla(spark, d), _now()).withColumn("escalated_at", F.lit(None).cast("timestamp"))
    orders = _sla(spark, d).where("case_id % 50 = 0").select("case_id", F.lit(2).alias("to_level"))
    return D.escalate(rows, orders, _now()).select("case_id", "level", F.col("escalated_at").isNotNull().alias("by_hand"))


@query("SELECT o_orderkey AS case_id, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderdate + interval 1 day)::date WHEN o_orderkey % 3 = 1 THEN o_orderdate::date ELSE date '1995-06-15' END AS intake FROM orders")
def tim07_intake(spark, d):
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    return table(spark, d, "orders").select(k.alias("case_id"), D.intake(F.when(k % 3 == 0, F.date_add(day, 1)), F.when(k % 3 == 1, day), F.to_date(F.lit("1995-06-15"))).alias("intake"))


@query("SELECT CASE WHEN epoch(timestamp '2024-02-01') - epoch(ts) > 20 * 86400 THEN 'delete' WHEN epoch(timestamp '2024-02-01') - epoch(ts) > 10 * 86400 THEN 'archive' ELSE 'keep' END AS fate, count(*) AS n FROM events GROUP BY 1")
def tim08_retention(spark, d):
    now = F.lit("2024-02-01").cast("timestamp")
    e = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return D.retention(e, now, "ts", 10, 20).groupBy("fate").agg(F.count("*").alias("n"))


@query(f"WITH {_SLA} SELECT case_id, ((row_number() OVER (ORDER BY case_id) - 1) // 100)::bigint AS batch FROM sla")
def str08_batches(spark, d):
    return D.batches(_sla(spark, d), 100, "case_id").select("case_id", "batch")


@query(f"WITH {_SLA} SELECT case_id, {_LEVEL} AS level FROM sla")
def tim09_snk09_upsert(spark, d):
    """New statuses taking the place of old ones by case."""
    new = D.status(_sla(spark, d), _now()).select("case_id", "level")
    return D.upsert(new.where("case_id % 2 = 0").withColumn("level", F.lit(9)), new, "case_id")
