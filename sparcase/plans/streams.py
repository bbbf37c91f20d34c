"""Streams run over the events there are, and their batch counterparts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import deadlines
from ..streaming import events as E
from ..workers import shared_folder
from .registry import query, table


def scratch(spark: SparkSession) -> str:
    """A folder of its own in the shared one."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table(spark, sf_dir, "events").schema)
    rows = E.read(spark, f"{sf_dir}/events.parque[t]", schema)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _written(spark: SparkSession, stream: DataFrame) -> DataFrame:
    folder = scratch(spark)
    E.write_to_end(stream, f"{folder}/out", f"{folder}/state")
    return spark.read.parquet(f"{folder}/out")


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('view', 'error') GROUP BY 1")
def str01_02_of_type(spark, d):
    return _written(spark, E.of_type(_stream(spark, d), "view", "error")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT count(DISTINCT event_id) AS n FROM events")
def str04_12_unique(spark, d):
    """Events that come twice counted once, by state that lives as long as the lateness."""
    twice = _stream(spark, d).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return _written(spark, E.unique(twice, "event_id", late="60 days")).agg(F.count("*").alias("n"))


@query("SELECT strftime(time_bucket(interval 6 hours, ts), '%Y-%m-%d %H:%M') AS start, count(*) AS total, count(*) FILTER (event_type <> 'error') AS succeeded, round(avg(value), 6) AS mean_seconds FROM events GROUP BY time_bucket(interval 6 hours, ts) HAVING time_bucket(interval 6 hours, ts) + interval 6 hours <= (SELECT max(ts) - interval 1 hour FROM events)")
def str10_windows(spark, d):
    """Six-hour windows as a stream writes them: those that the watermark has passed."""
    w = _written(spark, E.windows(_stream(spark, d), "6 hours"))
    return w.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "total", "succeeded", F.round("mean_seconds", 6).alias("mean_seconds"))


@query("SELECT strftime(time_bucket(interval 6 hours, ts), '%Y-%m-%d %H:%M') AS start, count(*) AS total, count(*) FILTER (event_type <> 'error') AS succeeded FROM events GROUP BY 1")
def str10_windows_batch(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = E.windows(e, "6 hours")
    return w.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "total", "succeeded")


_AUDIT = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in E.AUDIT.items()) + " END"


@query(f"SELECT event_id, {_AUDIT} AS action, event_type <> 'error' AS success FROM events")
def str05_07_persistence(spark, d):
    """Events written as audit rows in micro-batches, the same batch twice: nothing is stored twice."""
    folder = scratch(spark)

    def save(batch: DataFrame, _: int) -> None:
        rows = E.audit_rows(batch)
        E.append_new(rows, f"{folder}/audit")
        E.append_new(rows, f"{folder}/audit")

    E.run_to_end(_stream(spark, d), save, f"{folder}/state")
    return spark.read.parquet(f"{folder}/audit").select("event_id", "action", "success")


def _outbox(spark, d):
    k = F.col("event_id")
    return table(spark, d, "events").select("event_id", F.col("ts").alias("occurred_at"), F.when(k % 3 == 0, F.col("ts")).alias("processed_at"), (k % 6).cast("int").alias("tries"), F.when(k % 11 == 0, F.col("ts")).alias("dead_at"))


@query("SELECT event_id FROM events WHERE event_id % 3 <> 0 AND event_id % 11 <> 0 AND event_id % 6 < 5 ORDER BY ts, event_id LIMIT 50")
def str06_pending(spark, d):
    return E.pending(_outbox(spark, d)).select("event_id")


@query("SELECT event_id, event_id % 3 = 0 OR event_id % 4 = 1 AS done, CASE WHEN event_id % 4 = 0 THEN (event_id % 6 + 1)::int ELSE (event_id % 6)::int END AS tries, event_id % 11 = 0 OR (event_id % 4 = 0 AND event_id % 6 + 1 >= 5) AS dead FROM events")
def str06_after_try(spark, d):
    box = _outbox(spark, d)
    results = box.where("event_id % 4 < 2").select("event_id", (F.col("event_id") % 4 == 1).alias("ok"))
    out = E.after_try(box, results, F.lit("2024-02-01").cast("timestamp_ntz"))
    return out.select("event_id", F.col("processed_at").isNotNull().alias("done"), "tries", F.col("dead_at").isNotNull().alias("dead"))


@query("WITH l AS (SELECT user_id AS worker, max(ts) AS last FROM events GROUP BY 1) SELECT worker, floor((floor(epoch(timestamp '2024-01-30')) - floor(epoch(last))) / 21600)::bigint AS missed FROM l WHERE floor((floor(epoch(timestamp '2024-01-30')) - floor(epoch(last))) / 21600) >= 3")
def str09_heartbeats(spark, d):
    beats = table(spark, d, "events").select(F.col("user_id").alias("worker"), F.col("ts").cast("timestamp").alias("ts"))
    return E.heartbeats(beats, F.lit("2024-01-30").cast("timestamp"), 21600, 3).select("worker", "missed")


@query("SELECT e.event_id, c.c_name FROM events e JOIN customer c ON c.c_custkey = e.user_id WHERE e.event_type = 'purchase'")
def str11_13_enriched(spark, d):
    """Approvals joined to cases as they come: a stream joined to a table, then a second stage that reads the first's files."""
    cases = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    first = _written(spark, E.of_type(_stream(spark, d), "purchase").join(cases, "user_id"))
    return first.select("event_id", "c_name")


@query("SELECT ts::date AS day, count(*) AS cases FROM events GROUP BY 1")
def str03_watch(spark, d):
    """What the watch loop's micro-batches see, by day."""
    folder = scratch(spark)

    def save(batch: DataFrame, _: int) -> None:
        batch.select("event_id", F.to_date("ts").alias("day")).write.mode("append").parquet(f"{folder}/seen")

    E.run_to_end(_stream(spark, d), save, f"{folder}/state")
    return spark.read.parquet(f"{folder}/seen").groupBy("day").agg(F.count("*").alias("cases"))


@query("SELECT count(*) AS rows, count(*) FILTER (event_type = 'error') AS errors FROM events")
def str15_observed(spark, d):
    return E.observed(table(spark, d, "events"), "sla").agg(F.count("*").alias("rows"), F.count_if(F.col("event_type") == "error").alias("errors"))


def refreshed(spark: SparkSession, rows: DataFrame, now: str, path: str) -> None:
    """The periodic refresh of deadlines: one scheduled batch, written beside the last."""
    deadlines.refresh(rows, F.lit(now).cast("timestamp")).write.mode("overwrite").parquet(path)
