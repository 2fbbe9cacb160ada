"""Streams run to their end (ST1-ST11)."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from recollect.plans.registry import query
from recollect.runtime import shared_dir, table
from recollect.streaming import streams as S


def events(spark, d):
    return S.stream_of(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("ST1_source_to_sink", "SELECT event_id, user_id FROM events")
def _(spark, d):
    return S.drained(events(spark, d).select("event_id", "user_id"))


@query("ST3_exactly_once", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1")
def _(spark, d):
    path = f"{shared_dir(spark)}/upsert-{uuid.uuid4().hex}"
    one = events(spark, d).groupBy("user_id").agg(F.max("event_id").alias("event_id"))
    q = one.writeStream.foreachBatch(S.idempotent_upsert(path, ["user_id"])).option("checkpointLocation", path + "-state").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    return S.latest(spark, path, ["user_id"])


@query("ST6_time_range", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12'")
def _(spark, d):
    a, b = (F.lit(f"2024-01-{x}").cast("timestamp_ntz") for x in (10, 12))
    return table(spark, d, "events").where((F.col("ts") >= a) & (F.col("ts") < b)).select("event_id")


@query("ST9_value_state", "SELECT user_id, round(sum(0.3 * value * pow(0.7, later)), 6) AS q, count(*) AS visits FROM (SELECT user_id, value, count(*) OVER (PARTITION BY user_id ORDER BY event_id DESC ROWS UNBOUNDED PRECEDING) - 1 AS later FROM events) GROUP BY 1")
def _(spark, d):
    return S.drained(S.value_keeper(events(spark, d)), "update").select("user_id", F.round("q", 6).alias("q"), "visits")


@query("ST11_tumbling_batch", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS began, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def _(spark, d):
    e = table(spark, d, "events").groupBy(F.date_trunc("day", "ts").alias("began"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return e
