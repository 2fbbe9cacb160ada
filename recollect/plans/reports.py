"""Aggregations and reports (A, S)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from recollect.functions import text as T
from recollect.operators import aggregates as A
from recollect.plans.registry import key_points, query, results, sessions, turns
from recollect.runtime import table

SUMMARY = "count(*) AS total, CAST(sum(is_correct::INT) AS BIGINT) AS correct, round(sum(is_correct::INT) / count(*), 6) AS accuracy, round(avg(is_correct::INT), 6) AS avg_score"


@query("A1_summary", f"SELECT {SUMMARY} FROM results", uses="results")
def _(spark, d):
    return A.overall(results(spark, d))


@query("A2_summary_by_type", f"SELECT CASE WHEN grouping(query_type) = 1 THEN 'all' ELSE query_type END AS query_type, {SUMMARY} FROM results GROUP BY ROLLUP (query_type)", uses="results")
def _(spark, d):
    return A.with_overall(results(spark, d), "query_type")


@query("A4_efficiency", "SELECT round(sum(query_time), 6) AS total_query_time, round(avg(query_time), 6) AS avg_query_time, CAST(sum(retrieved_count) AS BIGINT) AS retrieved FROM results", uses="results")
def _(spark, d):
    return results(spark, d).agg(F.round(F.sum("query_time"), 6).alias("total_query_time"), F.round(F.avg("query_time"), 6).alias("avg_query_time"), F.sum("retrieved_count").alias("retrieved"))


@query("A5_by_context", f"SELECT context_id, {SUMMARY}, array_to_string(list_sort(list(query_id)), ',') AS query_ids FROM results GROUP BY 1", uses="results")
def _(spark, d):
    return results(spark, d).groupBy("context_id").agg(*A.summary_columns(), F.array_join(F.array_sort(F.collect_list("query_id")), ",").alias("query_ids"))


@query("A6_query_summary", "SELECT count(*) AS total, round(avg(query_time), 6) AS avg_query_time, round(avg(retrieved_count), 6) AS avg_retrieved_count FROM results", uses="results")
def _(spark, d):
    return results(spark, d).agg(F.count("*").alias("total"), F.round(F.avg("query_time"), 6).alias("avg_query_time"), F.round(F.avg("retrieved_count"), 6).alias("avg_retrieved_count"))


@query("A9_amortized_time", "SELECT query_id, question, context_id, round(sum(query_time) OVER (PARTITION BY context_id) / count(*) OVER (PARTITION BY context_id), 6) AS memory_time FROM results", uses="results")
def _(spark, d):
    w = Window.partitionBy("context_id")
    return results(spark, d).select("query_id", "question", "context_id", F.round(F.sum("query_time").over(w) / F.count("*").over(w), 6).alias("memory_time"))


@query(
    "A10_tokens_by_phase",
    """
    SELECT CASE WHEN grouping(phase) = 1 THEN 'total' ELSE phase END AS phase, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens, round(avg(tokens), 3) AS avg_tokens
    FROM (SELECT CASE WHEN role IN ('user', 'assistant') THEN role ELSE 'query' END AS phase, CAST(floor(length(coalesce(content, '')) / 4) AS BIGINT) AS tokens FROM turns) GROUP BY ROLLUP (phase)
    """,
    uses="turns",
)
def _(spark, d):
    t = turns(spark, d).select(F.when(F.col("role").isin("user", "assistant"), F.col("role")).otherwise("query").alias("phase"), T.estimated_tokens(F.coalesce("content", F.lit(""))).alias("tokens"))
    g = t.rollup("phase").agg(F.grouping("phase").alias("g"), F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.round(F.avg("tokens"), 3).alias("avg_tokens"))
    return g.select(F.when(F.col("g") == 1, "total").otherwise(F.col("phase")).alias("phase"), "calls", "tokens", "avg_tokens")


@query(
    "A11_tokens_by_stage",
    "SELECT coalesce(event_type, 'total') AS stage, CAST(sum(value) AS BIGINT) AS tokens, count(*) AS calls FROM (SELECT event_type, floor(value) AS value FROM events) GROUP BY ROLLUP (event_type)",
)
def _(spark, d):
    g = table(spark, d, "events").select("event_type", F.floor("value").alias("value")).rollup("event_type").agg(F.sum("value").cast("long").alias("tokens"), F.count("*").alias("calls"))
    return g.select(F.coalesce("event_type", F.lit("total")).alias("stage"), "tokens", "calls")


@query("A12_type_distribution", "SELECT query_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM results GROUP BY 1", uses="results")
def _(spark, d):
    g = results(spark, d).groupBy("query_type").agg(F.count("*").alias("n"))
    return g.select("query_type", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share"))


@query(
    "A13_injection_stats",
    """
    SELECT persona_id, count(*) AS total, CAST(sum(is_noise::INT) AS BIGINT) AS noise, round(avg(is_noise::INT), 6) AS ratio,
        round(avg(CASE WHEN is_noise THEN gap END), 6) AS avg_gap
    FROM (SELECT *, pos - lag(pos, 1, -1) OVER (PARTITION BY persona_id, is_noise ORDER BY pos) - 1 AS gap
          FROM (SELECT persona_id, is_noise, row_number() OVER (PARTITION BY persona_id ORDER BY original_index, session_id) - 1 AS pos FROM sess WHERE persona_id IS NOT NULL)) GROUP BY 1
    """,
    uses="sess",
)
def _(spark, d):
    w = Window.partitionBy("persona_id")
    s = sessions(spark, d).where("persona_id is not null").withColumn("pos", F.row_number().over(w.orderBy(F.col("original_index").asc_nulls_last(), "session_id")) - 1)
    s = s.withColumn("gap", F.col("pos") - F.lag("pos", 1, -1).over(Window.partitionBy("persona_id", "is_noise").orderBy("pos")) - 1)
    return s.groupBy("persona_id").agg(
        F.count("*").alias("total"), F.sum(F.col("is_noise").cast("int")).alias("noise"), F.round(F.avg(F.col("is_noise").cast("int")), 6).alias("ratio"), F.round(F.avg(F.when(F.col("is_noise"), F.col("gap"))), 6).alias("avg_gap")
    )


@query(
    "A14_difficulty",
    """
    SELECT CASE WHEN grouping(context_id) = 1 THEN -2 ELSE context_id END AS context_id, CASE WHEN grouping(query_type) = 1 THEN 'all' ELSE query_type END AS query_type,
        count(*) AS n, round(avg(is_correct::INT), 6) AS rate FROM results GROUP BY ROLLUP (context_id, query_type)
    """,
    uses="results",
)
def _(spark, d):
    g = results(spark, d).rollup("context_id", "query_type").agg(F.grouping("context_id").alias("gc"), F.grouping("query_type").alias("gt"), F.count("*").alias("n"), F.round(F.avg(F.col("is_correct").cast("int")), 6).alias("rate"))
    return g.select(F.when(F.col("gc") == 1, -2).otherwise(F.col("context_id")).alias("context_id"), F.when(F.col("gt") == 1, "all").otherwise(F.col("query_type")).alias("query_type"), "n", "rate")


@query("A15_category_accuracy", "SELECT query_type AS category, count(*) AS n, round(sum(is_correct::INT) / count(*), 6) AS accuracy, round(sum(retrieved_count) / count(*), 6) AS recall FROM results GROUP BY 1", uses="results")
def _(spark, d):
    return results(spark, d).groupBy(F.col("query_type").alias("category")).agg(
        F.count("*").alias("n"), F.round(F.sum(F.col("is_correct").cast("int")) / F.count("*"), 6).alias("accuracy"), F.round(F.sum("retrieved_count") / F.count("*"), 6).alias("recall")
    )


STATS = "count({v}) AS n, round(avg({v}), 6) AS mean, round(coalesce(stddev_samp({v}), 0), 6) AS std, round(quantile_cont({v}, 0.5), 6) AS median, round(min({v}), 6) AS low, round(max({v}), 6) AS high"


@query("A19_run_means", "SELECT count(*) AS runs, round(avg(m), 6) AS mean, round(coalesce(stddev_pop(m), 0), 6) AS std FROM (SELECT avg(value) AS m FROM events GROUP BY event_id % 5)")
def _(spark, d):
    return A.run_means(table(spark, d, "events").withColumn("run", F.col("event_id") % 5), "run", "value")


@query("A20_bootstrap")
def _(spark, d):
    return A.bootstrap(results(spark, d).select("query_id", F.col("is_correct").cast("double").alias("score")), "score")


@query("A21_keyword_counts", "SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(content), '[a-z]{4,}')) AS word FROM turns) GROUP BY 1", uses="turns")
def _(spark, d):
    return turns(spark, d).select(F.explode(F.regexp_extract_all(F.lower("content"), F.lit("[a-z]{4,}"), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query("A22_json_groups", "SELECT props->>'k' AS k, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, d):
    return table(spark, d, "events").groupBy(F.get_json_object("props", "$.k").alias("k"), "event_type").agg(F.count("*").alias("n"))


@query("A24_best_per_text", "SELECT name, arg_min(kp_id, (-coalesce(trap_score, -1), kp_id)) AS kp_id, max(coalesce(trap_score, -1)) AS score FROM kps GROUP BY 1", uses="kps")
def _(spark, d):
    k = key_points(spark, d).select("name", "kp_id", F.coalesce("trap_score", F.lit(-1.0)).alias("score"))
    return A.best_per_key(k, ["name"], "score", "kp_id")


@query("A27_progress", "SELECT context_id, count(*) AS queries, count(*) FILTER (WHERE model_output IS NOT NULL) AS answered FROM results GROUP BY 1", uses="results")
def _(spark, d):
    return results(spark, d).groupBy("context_id").agg(F.count("*").alias("queries"), F.count("model_output").alias("answered"))


@query(
    "S10_comparison",
    f"""
    SELECT 'first_answer' AS method, {SUMMARY} FROM results
    UNION ALL SELECT 'longest' AS method, count(*) AS total, CAST(sum(ok::INT) AS BIGINT) AS correct, round(avg(ok::INT), 6) AS accuracy, round(avg(ok::INT), 6) AS avg_score
    FROM (SELECT is_correct AND length(model_output) > 60 AS ok FROM results WHERE model_output IS NOT NULL)
    """,
    uses="results",
)
def _(spark, d):
    r = results(spark, d)
    other = r.where("model_output is not null").withColumn("is_correct", F.col("is_correct") & (F.length("model_output") > 60))
    return A.overall(r).withColumn("method", F.lit("first_answer")).unionByName(A.overall(other).withColumn("method", F.lit("longest")))
