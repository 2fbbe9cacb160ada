"""Queries of the training-data problems, each over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm import defects, encoding, leakage, neardup, reading, splitting, totals, truncation
from recollect.runtime import materialize, table

#: Folder of the public tokenizers' files.
TOKENIZERS = "/opt/tokenizers"


def records(spark: SparkSession, d: str) -> DataFrame:
    kp = table(spark, d, "key_points").select(F.lit("key_points").alias("tbl"), F.col("kp_id").alias("id"), F.col("content").alias("text"))
    q = table(spark, d, "queries").select(F.lit("queries").alias("tbl"), F.col("query_id").alias("id"), F.col("question").alias("text"))
    return kp.union(q)


def messages(spark: SparkSession, d: str) -> DataFrame:
    """session_id, source, lang, persona_id, turn, content of every message of every session row."""
    s = table(spark, d, "sessions").select("session_id", "source", "lang", "persona_id", F.explode("messages").alias("m"))
    return s.select("session_id", "source", "lang", "persona_id", F.col("m.turn").alias("turn"), F.col("m.content").alias("content"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.pairs(*neardup.near_duplicates(records(spark, d)))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.groups(*neardup.near_duplicates(records(spark, d), closed=False), counted=False)


def p2_tokens(spark: SparkSession, d: str) -> DataFrame:
    return totals.estimate(table(spark, d, "sessions"), table(spark, d, "personas"), f"{TOKENIZERS}/byte_bpe_50k.json")[0]


def p2_holdout(spark: SparkSession, d: str) -> DataFrame:
    return totals.estimate(table(spark, d, "sessions"), table(spark, d, "personas"), f"{TOKENIZERS}/byte_bpe_50k.json")[1]


def p3_texts(spark: SparkSession, d: str) -> DataFrame:
    kp = table(spark, d, "key_points").select(F.lit("key_points").alias("tbl"), F.col("kp_id").alias("rec_id"), F.lit(0).alias("turn"), "source", F.col("content").alias("text"))
    m = messages(spark, d).select(F.lit("sessions").alias("tbl"), F.col("session_id").cast("string").alias("rec_id"), "turn", "source", F.col("content").alias("text"))
    return kp.union(m).withColumn("source", truncation.source_key(F.col("source")))


def p3_scored(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(p3_texts(spark, d), ["tbl", "rec_id", "turn"], "text", ["tbl", "source"])


def p3_holdout(spark: SparkSession, d: str) -> DataFrame:
    """Of artificial cuts that took no part in the fit, how many are found, per table and source."""
    return truncation.holdout(p3_texts(spark, d), ["tbl", "rec_id", "turn"], "text", ["tbl", "source"])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_scored(spark, d).where("truncated").select("tbl", "rec_id", F.col("turn").cast("int").alias("turn")).distinct()


def p3_share(spark: SparkSession, d: str) -> DataFrame:
    """How often each source truncates."""
    s = p3_scored(spark, d).groupBy("tbl", "source").agg(F.count("*").alias("records"), F.sum(F.col("truncated").cast("int")).alias("truncated"))
    return s.select("tbl", "source", "records", "truncated", F.round(F.col("truncated") / F.col("records"), 6).alias("share"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return defects.defective(table(spark, d, "queries"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_pieces(spark, d).select("session_id", "turn").distinct()


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(messages(spark, d), ["session_id", "turn"])


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode_documents(table(spark, d, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json")


def p7_matches(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "heldout_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_matches(spark, d).select("doc_id", "item_id")


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Which held-out items leaked, into how many documents."""
    hit = materialize(p7_matches(spark, d), "leaks")
    return hit.groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.round(F.max(F.col("covered") / F.col("passage_words")), 6).alias("most_covered"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return reading.reading_levels(table(spark, d, "documents"), table(spark, d, "level_ratings"))


def p8_holdout(spark: SparkSession, d: str) -> DataFrame:
    """How the levels agree with ratings that took no part in the fit."""
    return reading.agreement(table(spark, d, "documents"), table(spark, d, "level_ratings"))


QUERIES = {f.__name__: f for f in (p1_found, p1_groups, p2_tokens, p2_holdout, p3_found, p3_share, p3_holdout, p4_found, p5_found, p5_pieces, p6_ids, p7_found, p7_matches, p7_items, p8_found, p8_holdout)}

SQL = {
    "p5_found": """
        SELECT DISTINCT session_id, m.turn AS turn
        FROM (SELECT session_id, unnest(messages) AS m FROM sessions) WHERE length(m.content) > 1200
    """,
}
