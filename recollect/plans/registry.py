"""Registration of queries with the SQL that states their result, and the frames they share.

The frames derive evaluation facts from the driver's tables: the first answer of a query stands for a model's output, its
correct answers for the expected ones. ``CTES`` states the same in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.runtime import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *, uses: str = ""):
    """Register a query under a name; ``uses`` names the shared frames that its SQL refers to."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ctes = [CTES[n] for n in uses.split()]
            SQL[name] = (f"WITH {', '.join(ctes)} " if ctes else "") + sql.strip()
        return f

    return add


CTES = {
    "results": """results AS (
        SELECT DISTINCT query_id, coalesce(lower(trim(query_type)), 'unknown') AS query_type, coalesce(persona_id, -1) AS context_id, session_id,
            question, answers[1].content AS model_output, coalesce(answers[1].is_correct, false) AS is_correct,
            list_transform(list_filter(answers, lambda a: a.is_correct), lambda a: a.content) AS expected,
            coalesce(length(question), 0) / 100.0 AS query_time, coalesce(len(source_key_points), 0) AS retrieved_count
        FROM queries WHERE answers IS NOT NULL)""",
    "turns": """turns AS (
        SELECT DISTINCT session_id, persona_id, original_index, m.turn AS turn, m.role AS role, m.content AS content
        FROM (SELECT session_id, persona_id, original_index, unnest(messages) AS m FROM sessions))""",
    "sess": """sess AS (
        SELECT DISTINCT session_id, persona_id, original_index, event_id, turn_count, kp_count, noise_id, noise_family_id, noise_type, created_at,
            (noise_id IS NOT NULL OR noise_family_id IS NOT NULL) AS is_noise FROM sessions)""",
    "kps": """kps AS (
        SELECT DISTINCT kp_id, persona_id, session_id, category, name, content, trap_score, "time" FROM key_points)""",
    "nodes": """nodes AS (
        SELECT DISTINCT graph_id, persona_id, start_date, time_span_days, event_id, event, type, event_date, triggered_by FROM event_nodes)""",
    "vecs": """vecs AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)""",
}


def results(spark: SparkSession, d: str) -> DataFrame:
    return (
        table(spark, d, "queries")
        .where("answers is not null")
        .select(
            "query_id",
            F.coalesce(F.lower(F.trim("query_type")), F.lit("unknown")).alias("query_type"),
            F.coalesce("persona_id", F.lit(-1)).alias("context_id"),
            "session_id",
            "question",
            F.get("answers", 0)["content"].alias("model_output"),
            F.coalesce(F.get("answers", 0)["is_correct"], F.lit(False)).alias("is_correct"),
            F.transform(F.filter("answers", lambda a: a.is_correct), lambda a: a.content).alias("expected"),
            (F.coalesce(F.length("question"), F.lit(0)) / 100.0).alias("query_time"),
            F.coalesce(F.size("source_key_points"), F.lit(0)).alias("retrieved_count"),
        )
        .distinct()
    )


def turns(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sessions").select("session_id", "persona_id", "original_index", F.explode("messages").alias("m"))
    return s.select("session_id", "persona_id", "original_index", F.col("m.turn").alias("turn"), F.col("m.role").alias("role"), F.col("m.content").alias("content")).distinct()


def sessions(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sessions").select("session_id", "persona_id", "original_index", "event_id", "turn_count", "kp_count", "noise_id", "noise_family_id", "noise_type", "created_at")
    return s.distinct().withColumn("is_noise", F.col("noise_id").isNotNull() | F.col("noise_family_id").isNotNull())


def key_points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "key_points").select("kp_id", "persona_id", "session_id", "category", "name", "content", "trap_score", "time").distinct()


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "event_nodes").select("graph_id", "persona_id", "start_date", "time_span_days", "event_id", "event", "type", "event_date", "triggered_by").distinct()


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
