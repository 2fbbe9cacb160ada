"""Structured Streaming: event-time windows with watermarks, and keyed state for evaluation units and values."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from recollect.runtime import shared_dir, table


def stream_of(spark: SparkSession, d: str, name: str, files: int = 1) -> DataFrame:
    """The table's files as a stream, ``files`` of them a micro-batch. A pattern, as a stream takes no single file."""
    return spark.readStream.schema(table(spark, d, name).schema).option("maxFilesPerTrigger", files).parquet(f"{d}/[{name[0]}]{name[1:]}.parquet")


def drained(stream: DataFrame, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Runs a stream over all that is there and returns what it wrote. Files are written exactly once by batch.

    A batch of mode update holds only the keys that it changed, so each is kept and the newest row of each key returned;
    the key is the first column, as in ``stateful``, unless ``keys`` names others.
    """
    spark, path = stream.sparkSession, f"{shared_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", path + "-state").outputMode(mode).trigger(availableNow=True).start()
    else:
        whole = lambda df, epoch: df.write.mode("overwrite").parquet(path)
        keys = keys or stream.columns[:1]
        write = idempotent_upsert(path, keys) if mode == "update" else whole
        q = stream.writeStream.foreachBatch(write).option("checkpointLocation", path + "-state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return latest(spark, path, keys).select(*stream.columns) if mode == "update" else spark.read.schema(stream.schema).parquet(path)


def windowed(events: DataFrame, length: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums by type in tumbling or sliding windows; rows later than the watermark are dropped."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    g = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("began"), "event_type", "n", F.round("total", 6).alias("total"))


def user_sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    g = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("began"), F.col("w.end").alias("ended"), "n")


def stateful(df: DataFrame, key: str, step: Callable[[tuple, tuple], tuple], start: tuple, state: str, output: str, order: str) -> DataFrame:
    """Folds each key's rows, in order within a micro-batch, into a state that is kept between batches; emits it per batch."""
    names = [c.strip().split(" ")[0] for c in output.split(",")]

    def run(k, batches: Iterator[pd.DataFrame], s: GroupState) -> Iterator[pd.DataFrame]:
        now = s.get if s.exists else start
        rows = pd.concat(batches).sort_values(order)
        for r in rows.itertuples(index=False):
            now = step(now, r)
        s.update(tuple(now))
        yield pd.DataFrame([(k[0], *now)], columns=names)

    return df.groupBy(key).applyInPandasWithState(run, output, state, "update", GroupStateTimeout.NoTimeout)


def unit_builder(sessions: DataFrame, interval: int) -> DataFrame:
    """persona_id, clean, pending, units: count-based units of each persona, as its sessions arrive."""

    def step(s, r):
        clean, pending, units = s
        if r.is_noise:
            return clean, pending + 1, units
        clean += 1
        return (clean, 0, units + 1) if clean % interval == 0 else (clean, pending + 1, units)

    return stateful(sessions, "persona_id", step, (0, 0, 0), "clean long, pending long, units long", "persona_id long, clean long, pending long, units long", "session_id")


def value_keeper(events: DataFrame, alpha: float = 0.3) -> DataFrame:
    """user_id, q, visits: the running value of each user."""
    return stateful(events, "user_id", lambda s, r: (s[0] + alpha * (r.value - s[0]), s[1] + 1), (0.0, 0), "q double, visits long", "user_id long, q double, visits long", "event_id")


def idempotent_upsert(target: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: writes a batch as its own partition, so that a batch written again after a failure replaces itself.

    ``latest`` reads the newest version of each key.
    """

    def write(df: DataFrame, epoch: int) -> None:
        df.dropDuplicates(keys).write.mode("overwrite").parquet(f"{target}/batch={epoch}")

    return write


def latest(spark: SparkSession, target: str, keys: list[str]) -> DataFrame:
    df = spark.read.parquet(target)
    rest = [c for c in df.columns if c not in keys and c != "batch"]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, *(F.col("_r")[c].alias(c) for c in rest))


def kafka(spark: SparkSession, servers: str, topic: str, schema: str, per_trigger: int = 1_000_000) -> DataFrame:
    """Messages of a topic parsed from JSON, with their key. Needs the connector on the class path."""
    raw = spark.readStream.format("kafka").options(**{"kafka.bootstrap.servers": servers, "subscribe": topic, "maxOffsetsPerTrigger": per_trigger}).load()
    return raw.select(F.col("key").cast("string").alias("key"), F.from_json(F.col("value").cast("string"), schema).alias("v")).select("key", "v.*")


def fair_rounds(events: DataFrame, key: str, order: str, quota: int) -> DataFrame:
    """key, order, round: the poll in which each row is read if every poll takes at most ``quota`` rows of a key; counted on between batches."""
    schema = events.schema
    output = f"{key} {schema[key].dataType.simpleString()}, {order} {schema[order].dataType.simpleString()}, round long"

    def run(k, batches: Iterator[pd.DataFrame], s: GroupState) -> Iterator[pd.DataFrame]:
        n = s.get[0] if s.exists else 0
        for rows in batches:
            rows = rows.sort_values(order)
            yield pd.DataFrame({key: k[0], order: rows[order], "round": (n + pd.RangeIndex(len(rows))) // quota})
            n += len(rows)
        s.update((n,))

    return events.select(key, order).groupBy(key).applyInPandasWithState(run, output, "n long", "append", GroupStateTimeout.NoTimeout)


def refresher(events: DataFrame, key: str, at: str, interval: int) -> DataFrame:
    """key, last, refreshes: a refresh at a key's first row and at the first one ``interval`` seconds or more after the last refresh. ``at``: seconds."""

    def step(s, r):
        last, n = s
        t = getattr(r, at)
        return (t, n + 1) if n == 0 or t - last >= interval else s

    return stateful(events, key, step, (0, 0), "last long, refreshes long", f"{key} long, last long, refreshes long", at)


def reclaimable(log: DataFrame, task: str, at: str, acked: Column, idle: int) -> DataFrame:
    """task, deliveries, idle_seconds: tasks delivered but not acknowledged since, whose last delivery is ``idle`` seconds or more before the log's end.

    One aggregation with map-side combination; the end of the log is one row.
    """
    g = log.groupBy(task).agg(F.max(F.when(~acked, F.col(at))).alias("sent"), F.max(F.when(acked, F.col(at))).alias("done"), F.count_if(~acked).alias("deliveries"))
    end = log.agg(F.max(at).alias("end"))
    g = g.join(F.broadcast(end)).where(F.col("sent").isNotNull() & (F.col("done").isNull() | (F.col("sent") > F.col("done"))) & (F.col("end") - F.col("sent") >= idle))
    return g.select(task, "deliveries", (F.col("end") - F.col("sent")).alias("idle_seconds"))
