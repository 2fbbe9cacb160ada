"""Filters, joins on tags and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from recollect.functions import text as T
from recollect.operators.filters import compile_filter, in_scopes
from recollect.plans.registry import key_points, query, results, sessions, turns
from recollect.runtime import table


@query("F10_tag_filter", "SELECT event_id FROM events WHERE props->>'k' IN ('1', '2', '3') AND props->>'k' IS NOT NULL AND event_type IN ('click', 'view')")
def _(spark, d):
    return table(spark, d, "events").where(compile_filter({"k": {"$in": [1, 2, 3], "$exists": True}}, "props") & in_scopes(F.col("event_type"), ["click", "view"])).select("event_id")


@query("F11_payload_filter", "SELECT vec_id FROM vecs WHERE label = 3 OR label IN (5, 7)", uses="vecs")
def _(spark, d):
    return table(spark, d, "embeddings").where(compile_filter({"or": [{"label": 3}, {"label": {"in": [5, 7]}}]})).select("vec_id")


@query("F12_tenant", "SELECT event_id FROM events WHERE user_id = 7 AND event_type <> 'error'")
def _(spark, d):
    return table(spark, d, "events").where("user_id = 7 and event_type <> 'error'").select("event_id")


@query("F13_date_ranges", "SELECT count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-10') AS inside, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-10') AS inclusive FROM events")
def _(spark, d):
    a, b = (F.lit(f"2024-01-{x}").cast("timestamp_ntz") for x in ("05", "10"))
    return table(spark, d, "events").agg(F.count_if((F.col("ts") > a) & (F.col("ts") < b)).alias("inside"), F.count_if((F.col("ts") >= a) & (F.col("ts") <= b)).alias("inclusive"))


@query("F14_contains", "SELECT kp_id FROM kps WHERE contains(lower(content), 'blood pressure')", uses="kps")
def _(spark, d):
    return key_points(spark, d).where(F.contains(F.lower("content"), F.lit("blood pressure"))).select("kp_id")


@query("F15_message_search", "SELECT DISTINCT session_id FROM sessions WHERE len(list_filter(messages, lambda m: m.role = 'user' AND contains(lower(m.content), 'thank'))) > 0")
def _(spark, d):
    return table(spark, d, "sessions").where(F.exists("messages", lambda m: (m.role == "user") & F.contains(F.lower(m.content), F.lit("thank")))).select("session_id").distinct()


@query("F16_relativity", "SELECT kp_id FROM kps WHERE coalesce(trap_score, 1.0) >= 0.8", uses="kps")
def _(spark, d):
    return key_points(spark, d).where(F.coalesce("trap_score", F.lit(1.0)) >= 0.8).select("kp_id")


@query("F17_intermediate", "SELECT doc_id FROM documents WHERE text IS NOT NULL AND NOT contains(text, 'File URL:') AND NOT contains(text, 'File ID:') AND NOT contains(text, 'Filename:')")
def _(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").where(t.isNotNull() & ~F.contains(t, F.lit("File URL:")) & ~F.contains(t, F.lit("File ID:")) & ~F.contains(t, F.lit("Filename:"))).select("doc_id")


@query("F18_too_short", r"SELECT doc_id FROM documents WHERE text IS NOT NULL AND CASE WHEN length(regexp_replace(text, '[^\x{4e00}-\x{9fff}]', '', 'g')) / greatest(length(text), 1) > 0.3 THEN length(text) ELSE len(list_filter(regexp_split_to_array(text, '[\s\p{Z}\x{0b}\x{85}]+'), lambda w: w <> '')) END < 20")
def _(spark, d):
    size = F.when(T.han_share(F.col("text")) > 0.3, F.length("text")).otherwise(F.size(T.tokens(F.col("text"))))
    return table(spark, d, "documents").where(F.col("text").isNotNull() & (size < 20)).select("doc_id")


@query("J10_source_passages", "SELECT p.id AS persona_id, count(*) AS passages FROM personas p JOIN documents d ON d.persona_id = p.id GROUP BY 1")
def _(spark, d):
    return table(spark, d, "personas").select(F.col("id").alias("persona_id")).join(table(spark, d, "documents").select("persona_id"), "persona_id").groupBy("persona_id").agg(F.count("*").alias("passages"))


@query("J11_tags_any_all", "SELECT persona_id, bool_or(true) AS any_tag, count(DISTINCT category) = 2 AS all_tags FROM kps WHERE category IN ('lab', 'allergy') AND persona_id IS NOT NULL GROUP BY 1", uses="kps")
def _(spark, d):
    k = key_points(spark, d).where(F.col("category").isin("lab", "allergy") & F.col("persona_id").isNotNull())
    return k.groupBy("persona_id").agg(F.lit(True).alias("any_tag"), (F.countDistinct("category") == 2).alias("all_tags"))


@query("J13_suppressed_raw", "SELECT session_id FROM (SELECT DISTINCT session_id FROM turns) WHERE session_id NOT IN (SELECT session_id FROM kps WHERE session_id IS NOT NULL)", uses="turns kps")
def _(spark, d):
    return turns(spark, d).select("session_id").distinct().join(key_points(spark, d).select("session_id"), "session_id", "left_anti")


@query("J16_distance_lookup", "SELECT k.kp_id, CAST(coalesce(w.w, 1.0) AS DOUBLE) AS distance FROM kps k LEFT JOIN (VALUES ('lab', 0.2), ('allergy', 0.4), ('habit', 0.7)) w(category, w) USING (category)", uses="kps")
def _(spark, d):
    w = spark.createDataFrame([("lab", 0.2), ("allergy", 0.4), ("habit", 0.7)], "category string, w double")
    return key_points(spark, d).join(w, "category", "left").select("kp_id", F.coalesce("w", F.lit(1.0)).alias("distance"))


@query("U1_padded_union", "SELECT doc_id AS id, source, NULL AS category FROM documents UNION ALL SELECT session_id, NULL, category FROM kps", uses="kps")
def _(spark, d):
    a = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source")
    return a.unionByName(key_points(spark, d).select(F.col("session_id").alias("id"), "category"), allowMissingColumns=True)


@query("U2_relation_union", "SELECT DISTINCT persona_id AS a, session_id AS b FROM sess WHERE persona_id IS NOT NULL UNION SELECT session_id, persona_id FROM kps WHERE session_id IS NOT NULL AND persona_id IS NOT NULL", uses="sess kps")
def _(spark, d):
    a = sessions(spark, d).where("persona_id is not null").select(F.col("persona_id").alias("a"), F.col("session_id").alias("b"))
    b = key_points(spark, d).where("session_id is not null and persona_id is not null").select(F.col("session_id").alias("a"), F.col("persona_id").alias("b"))
    return a.union(b).distinct()


@query("U3_merge_recalls", "SELECT event_id, arg_max(src, p) AS src FROM (SELECT event_id, 'type' AS src, 1 AS p FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, 'value', 2 FROM events WHERE value > 50) GROUP BY 1")
def _(spark, d):
    e = table(spark, d, "events")
    a = e.where("event_type = 'click'").select("event_id", F.lit("type").alias("src"), F.lit(1).alias("p"))
    b = e.where("value > 50").select("event_id", F.lit("value").alias("src"), F.lit(2).alias("p"))
    return a.union(b).groupBy("event_id").agg(F.max_by("src", "p").alias("src"))


@query("U6_subsets", "SELECT query_id, len(a) > 0 AND len(list_filter(a, lambda x: NOT list_contains(b, x))) = 0 AS subset FROM (SELECT DISTINCT query_id, list_transform(coalesce(source_key_points, []), lambda k: k.session_id) AS a, list_transform(coalesce(metadata.reasoning_chain, []), lambda n: n.session_id) AS b FROM queries)")
def _(spark, d):
    ids = lambda c: F.coalesce(F.transform(c, lambda k: k["session_id"]), F.array().cast("array<bigint>"))
    t = table(spark, d, "queries").select("query_id", ids(F.col("source_key_points")).alias("a"), ids(F.col("metadata.reasoning_chain")).alias("b")).distinct()
    inside = F.forall("a", lambda x: F.coalesce(F.array_contains("b", x), F.lit(False)))
    return t.select("query_id", ((F.size("a") > 0) & inside).alias("subset"))


@query("Q25_tag_list", "SELECT DISTINCT name FROM kps WHERE name ILIKE '%pressure%' ORDER BY 1 LIMIT 20", uses="kps")
def _(spark, d):
    return key_points(spark, d).where(F.col("name").ilike("%pressure%")).select("name").distinct().orderBy("name").limit(20)


@query("Q26_count_subquery", "SELECT count(*) AS n FROM (SELECT DISTINCT persona_id, category FROM kps)", uses="kps")
def _(spark, d):
    return key_points(spark, d).select("persona_id", "category").distinct().agg(F.count("*").alias("n"))


@query("Q27_detached_messages", "SELECT session_id, turn, role FROM turns WHERE session_id NOT IN (SELECT unnest(source_key_points).session_id AS s FROM queries WHERE len(source_key_points) > 0)", uses="turns")
def _(spark, d):
    used = table(spark, d, "queries").select(F.explode("source_key_points.session_id").alias("session_id")).where("session_id is not null")
    return turns(spark, d).join(used, "session_id", "left_anti").select("session_id", "turn", "role")


@query("Q21_memory_kind_list", "SELECT kp_id, content FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY session_id DESC NULLS LAST, kp_id) AS n FROM kps WHERE content IS NOT NULL) WHERE n <= 5", uses="kps")
def _(spark, d):
    w = Window.partitionBy("category").orderBy(F.col("session_id").desc_nulls_last(), "kp_id")
    return key_points(spark, d).where("content is not null").withColumn("n", F.row_number().over(w)).where("n <= 5").select("kp_id", "content")


@query("Q23_recent_scoped", "SELECT event_id FROM events WHERE user_id IN (1, 2, 3) AND ts BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-20' ORDER BY ts DESC, event_id LIMIT 30")
def _(spark, d):
    a, b = (F.lit(f"2024-01-{x}").cast("timestamp_ntz") for x in ("02", "20"))
    return table(spark, d, "events").where(in_scopes(F.col("user_id"), [1, 2, 3]) & F.col("ts").between(a, b)).orderBy(F.desc("ts"), "event_id").limit(30).select("event_id")


@query("Q24_statistics", "SELECT count(*) AS files, coalesce(CAST(sum(n_chars) AS BIGINT), 0) AS size, count(DISTINCT source) AS sources FROM documents")
def _(spark, d):
    return table(spark, d, "documents").agg(F.count("*").alias("files"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("size"), F.countDistinct("source").alias("sources"))
