"""Aggregations of evaluation results: summaries, efficiency, statistics and percentiles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _r(c: Column) -> Column:
    return F.round(c, 6)


def summary_columns() -> list[Column]:
    right = F.sum(F.col("is_correct").cast("long"))
    return [F.count("*").alias("total"), right.alias("correct"), _r(right / F.count("*")).alias("accuracy"), _r(F.avg(F.col("is_correct").cast("double"))).alias("avg_score")]


def overall(results: DataFrame) -> DataFrame:
    return results.agg(*summary_columns())


def by(results: DataFrame, *keys: str) -> DataFrame:
    return results.groupBy(*keys).agg(*summary_columns())


def with_overall(results: DataFrame, key: str, label: str = "all") -> DataFrame:
    """One row per key and one over all, in a single pass."""
    g = results.rollup(key).agg(*summary_columns(), F.grouping(key).alias("g"))
    return g.select(F.when(F.col("g") == 1, label).otherwise(F.col(key)).alias(key), "total", "correct", "accuracy", "avg_score")


def statistics(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """count, mean, sample standard deviation (0 for one row), median, min, max."""
    v = F.col(value)
    cols = [F.count(v).alias("n"), _r(F.avg(v)).alias("mean"), _r(F.coalesce(F.stddev_samp(v), F.lit(0.0))).alias("std"), _r(F.percentile(v, F.lit(0.5))).alias("median"), _r(F.min(v)).alias("low"), _r(F.max(v)).alias("high")]
    return df.groupBy(*keys).agg(*cols) if keys else df.agg(*cols)


def latency(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """mean and exact percentiles with linear interpolation."""
    v = F.col(value)
    return df.groupBy(*keys).agg(_r(F.avg(v)).alias("mean"), _r(F.percentile(v, F.lit(0.5))).alias("p50"), _r(F.percentile(v, F.lit(0.95))).alias("p95"))


def run_means(df: DataFrame, run: str, value: str) -> DataFrame:
    """Mean of the runs' means and its population standard deviation (0 for one run)."""
    return df.groupBy(run).agg(F.avg(value).alias("m")).agg(F.count("*").alias("runs"), _r(F.avg("m")).alias("mean"), _r(F.coalesce(F.stddev_pop("m"), F.lit(0.0))).alias("std"))


def best_per_key(df: DataFrame, keys: list[str], score: str, tie: str) -> DataFrame:
    """The row of the best score of each key; ties go to the least ``tie``."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(-F.col(score), F.col(tie))).alias("_b")).select(*keys, *(F.col("_b")[c].alias(c) for c in rest))


def bootstrap(df: DataFrame, value: str, resamples: int = 10_000, seed: int = 7) -> DataFrame:
    """Percentile interval of the mean by a Poisson bootstrap.

    k equal values weigh Poisson(k) in a resample, drawn from a generator that value and seed determine, so that a retried task draws
    alike. Equal values are counted first; a task adds its values up into one sum and weight per resample, and only these are shuffled.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("k"))

    def draw(batches):
        total, weight = np.zeros(resamples), np.zeros(resamples)
        for batch in batches:
            for v, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = np.random.default_rng((seed, np.float64(v).view(np.uint64).item())).poisson(k, resamples)
                total += w * v
                weight += w
        if weight.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(resamples)), pa.array(total), pa.array(weight)], names=["b", "s", "w"])

    sums = counts.mapInArrow(draw, "b long, s double, w double").groupBy("b").agg((F.sum("s") / F.greatest(F.sum("w"), F.lit(1.0))).alias("m"))
    return sums.agg(_r(F.avg("m")).alias("mean"), _r(F.percentile("m", F.lit(0.025))).alias("low"), _r(F.percentile("m", F.lit(0.975))).alias("high"))


def with_total(report, df: DataFrame, key: str, label: str = "overall") -> DataFrame:
    """A report by key and, under ``label``, over all rows. ``report`` takes a frame and keys.

    Each row goes to its group and to the total, as for a rollup; exact percentiles keep one counter per distinct value.
    """
    both = df.withColumn("_g", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn(key, F.when(F.col("_g") == 1, label).otherwise(F.col(key)))
    return report(both, "_g", key).drop("_g")


def chain_rates(rows: DataFrame, key: str) -> DataFrame:
    """Mean scores of reasoning chains (ncr, crc, cc), and over all their nodes the shares mentioned and causal; null without nodes."""
    share = lambda c: _r(F.try_divide(F.sum(c).cast("double"), F.sum("nodes")))
    return rows.groupBy(key).agg(
        _r(F.avg("ncr")).alias("avg_ncr"), _r(F.avg("crc")).alias("avg_crc"), _r(F.avg("cc")).alias("avg_cc"), F.sum("nodes").alias("nodes"), share("mentioned").alias("node_mention_rate"), share("causal").alias("node_causal_rate")
    )


def build_summary(builds: DataFrame, unit: str) -> DataFrame:
    """Memory builds (method, time_cost, passages, entries) by method and, as method all, together."""
    g = builds.rollup("method").agg(
        F.grouping("method").alias("g"), F.countDistinct(unit).alias("units"), F.count("*").alias("count"), _r(F.sum("time_cost")).alias("time_cost"), _r(F.sum("time_cost") / F.count("*")).alias("avg_time_per_session"),
        F.sum("passages").alias("passages"), F.sum("entries").alias("entries"),
    )
    return g.withColumn("method", F.when(F.col("g") == 1, "all").otherwise(F.col("method"))).drop("g")


def recordings(df: DataFrame, keys: list[str], ts: str, interval: str) -> DataFrame:
    """How many intervals recorded each key, once each however often it came up in one, and when it was last seen."""
    slots = df.groupBy(*keys, F.date_trunc(interval, ts).alias("_slot")).agg(F.max(ts).alias("last_seen"))
    return slots.groupBy(*keys).agg(F.count("*").alias("recordings"), F.max("last_seen").alias("last_seen"))
