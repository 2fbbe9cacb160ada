"""Loading, curation, units and joins of dialogues, knowledge points and events (S, F, J, W, T9-T12)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from recollect.operators import curation as C
from recollect.operators.retrieval import ranked
from recollect.plans.registry import key_points, nodes, query, results, sessions, turns
from recollect.runtime import table

ROW = "row_number() OVER (PARTITION BY persona_id ORDER BY original_index, session_id)"
TRAP = " OR ".join(
    [f"contains(coalesce({c}, ''), '{w}')" for c in ("category", "name") for w in C.TRAP_KEYWORDS] + [f"contains(coalesce(content, ''), '{w}')" for w in C.TRAP_INDICATORS]
)


@query("S2_session_head", "SELECT session_id, persona_id, original_index, is_noise FROM sess WHERE original_index < 5", uses="sess")
def _(spark, d):
    return sessions(spark, d).where("original_index < 5").select("session_id", "persona_id", "original_index", "is_noise")


@query("S3_query_index", "SELECT session_id, count(*) AS n, string_agg(query_id, ',' ORDER BY query_id) AS ids FROM results WHERE query_type IN ('entity_exact_match', 'temporal_localization') GROUP BY 1", uses="results")
def _(spark, d):
    r = results(spark, d).where(F.col("query_type").isin("entity_exact_match", "temporal_localization"))
    return r.groupBy("session_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("query_id")), ",").alias("ids"))


@query("S5_dynamic_keys")
def _(spark, d):
    # a map with keys session_N, as conversation files have, unpivoted and put in order of N
    m = turns(spark, d).where("content is not null").groupBy("persona_id", "session_id").agg(F.count("*").alias("n"))
    as_map = m.groupBy("persona_id").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("session_"), F.col("session_id").cast("string")), F.col("n")))).alias("conversation"))
    e = as_map.select("persona_id", F.explode(F.map_filter("conversation", lambda k, v: k.rlike(r"^session_\d+$"))).alias("key", "n"))
    return e.select("persona_id", F.regexp_extract("key", r"(\d+)$", 1).cast("long").alias("session"), "n")


@query("S6_qa_parse", "SELECT query_id, question, CASE WHEN query_type = 'multiple_choice' THEN 5 WHEN query_type = 'temporal_localization' THEN 2 ELSE 1 END AS category, coalesce(expected[1], '') AS answer FROM results", uses="results")
def _(spark, d):
    category = F.when(F.col("query_type") == "multiple_choice", 5).when(F.col("query_type") == "temporal_localization", 2).otherwise(1)
    return results(spark, d).select("query_id", "question", category.alias("category"), F.coalesce(F.get("expected", 0), F.lit("")).alias("answer"))


@query("F1_noise_kind", "SELECT session_id, CASE WHEN noise_family_id IS NOT NULL THEN 'family' WHEN noise_id IS NOT NULL THEN 'health' ELSE 'none' END AS kind FROM sess", uses="sess")
def _(spark, d):
    return sessions(spark, d).select("session_id", F.when(F.col("noise_family_id").isNotNull(), "family").when(F.col("noise_id").isNotNull(), "health").otherwise("none").alias("kind"))


@query("F2_correct_answers", "SELECT query_id, question, coalesce(array_to_string(expected, '|'), '') AS expected FROM results", uses="results")
def _(spark, d):
    return results(spark, d).select("query_id", "question", F.array_join("expected", "|").alias("expected"))


@query("F3_type_filter", "SELECT query_id, question FROM results WHERE query_type IN ('state_update', 'multiple_choice')", uses="results")
def _(spark, d):
    return results(spark, d).where(F.col("query_type").isin("state_update", "multiple_choice")).select("query_id", "question")


@query("F4_category_filter", "SELECT kp_id, category FROM kps WHERE category IN ('lab', 'allergy')", uses="kps")
def _(spark, d):
    return key_points(spark, d).where(F.col("category").isin("lab", "allergy")).select("kp_id", "category")


@query(
    "F5_memory_filter",
    f"""
    SELECT kp_id, trap_score FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(CAST(persona_id AS VARCHAR), ''), coalesce(category, ''), coalesce(name, ''), coalesce(content, '') ORDER BY session_id NULLS FIRST, kp_id) AS n
        FROM kps WHERE ({TRAP}) OR coalesce(trap_score, 0.5) > 0.5) WHERE n = 1
    """,
    uses="kps",
)
def _(spark, d):
    return C.memory_points(key_points(spark, d)).select("kp_id", "trap_score")


@query("F6_trap_points", f"SELECT kp_id FROM kps WHERE {TRAP}", uses="kps")
def _(spark, d):
    return key_points(spark, d).where(C.is_trap()).select("kp_id")


@query("F7_latest_points", "SELECT kp_id, session_id FROM (SELECT *, max(session_id) OVER (PARTITION BY persona_id, category, name) AS last FROM kps) WHERE session_id = last", uses="kps")
def _(spark, d):
    return C.latest_points(key_points(spark, d)).select("kp_id", "session_id")


TYPES = ", ".join(f"'{t}'" for t in C.EVENT_TYPES)


@query(
    "F8_normalized_events",
    f"""
    SELECT event_id, CASE WHEN type IN ({TYPES}) THEN type ELSE 'health' END AS type, CASE WHEN length(event_date) = 10 AND length(event_date) - length(replace(event_date, '-', '')) = 2 THEN event_date ELSE coalesce(start_date, '1970-01-01') END AS event_date,
        coalesce(len(list_filter(triggered_by, lambda x: x IS NOT NULL)), 0) AS causes FROM nodes
    """,
    uses="nodes",
)
def _(spark, d):
    good = (F.length("event_date") == 10) & (F.length("event_date") - F.length(F.replace("event_date", F.lit("-"), F.lit(""))) == 2)
    return nodes(spark, d).select(
        "event_id", F.when(F.col("type").isin(*C.EVENT_TYPES), F.col("type")).otherwise("health").alias("type"), F.when(good, F.col("event_date")).otherwise(F.coalesce("start_date", F.lit("1970-01-01"))).alias("event_date"),
        F.coalesce(F.size(F.filter("triggered_by", lambda x: x.isNotNull())), F.lit(0)).cast("long").alias("causes"),
    )


EDGES = "edges AS (SELECT DISTINCT src, dst FROM (SELECT unnest(triggered_by) AS src, event_id AS dst FROM nodes) WHERE src IS NOT NULL AND src <> dst)"


@query("F19_linked_events", f"SELECT event_id FROM (SELECT DISTINCT event_id FROM nodes) WHERE event_id IN (SELECT dst FROM (WITH {EDGES} SELECT * FROM edges)) OR event_id IN (SELECT src FROM (WITH {EDGES} SELECT * FROM edges))", uses="nodes")
def _(spark, d):
    n = nodes(spark, d)
    e = C.edges(n)
    ends = e.select(F.col("src").alias("event_id")).union(e.select(F.col("dst").alias("event_id")))
    return n.select("event_id").distinct().join(ends, "event_id", "left_semi")


@query("F20_isolated_nodes", f"SELECT event_id FROM (SELECT DISTINCT event_id FROM nodes) WHERE event_id NOT IN (SELECT dst FROM (WITH {EDGES} SELECT * FROM edges)) AND event_id NOT IN (SELECT src FROM (WITH {EDGES} SELECT * FROM edges))", uses="nodes")
def _(spark, d):
    n = nodes(spark, d)
    e = C.edges(n)
    return n.select("event_id").distinct().join(e.select(F.col("src").alias("event_id")), "event_id", "left_anti").join(e.select(F.col("dst").alias("event_id")), "event_id", "left_anti")


@query("F21_skip_done", "SELECT query_id FROM (SELECT DISTINCT query_id FROM results) WHERE query_id NOT IN (SELECT query_id FROM results WHERE is_correct)", uses="results")
def _(spark, d):
    r = results(spark, d)
    return r.select("query_id").distinct().join(r.where("is_correct").select("query_id"), "query_id", "left_anti")


@query("F22_blank_facts", "SELECT kp_id, content FROM kps WHERE content IS NOT NULL AND trim(content) <> ''", uses="kps")
def _(spark, d):
    return key_points(spark, d).where("content is not null and trim(content) <> ''").select("kp_id", "content")


@query("J1_boundary_queries", f"""
    SELECT u.persona_id, u.unit, count(DISTINCT q.query_id) AS queries FROM (
        SELECT *, coalesce(sum(boundary::INT) OVER (PARTITION BY persona_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS unit FROM (
            SELECT *, c % 2 = 0 AND NOT is_noise AS boundary FROM (SELECT persona_id, session_id, is_noise, {ROW} AS pos,
                sum((NOT is_noise)::INT) OVER (PARTITION BY persona_id ORDER BY original_index, session_id ROWS UNBOUNDED PRECEDING) AS c FROM sess WHERE persona_id IS NOT NULL))) u
    JOIN results q ON u.boundary AND q.context_id = u.persona_id AND q.session_id = u.session_id GROUP BY 1, 2
    """, uses="sess results")
def _(spark, d):
    u = C.units(sessions(spark, d).where("persona_id is not null"), 2).where("boundary")
    q = results(spark, d).select(F.col("context_id").alias("persona_id"), "session_id", "query_id")
    return u.join(q, ["persona_id", "session_id"]).groupBy("persona_id", "unit").agg(F.countDistinct("query_id").alias("queries"))


@query("J2_persona_events", "SELECT p.id AS persona_id, p.type_name, n.graph_id, n.event_id, n.event FROM personas p JOIN nodes n ON n.persona_id = p.id", uses="nodes")
def _(spark, d):
    p = table(spark, d, "personas").select(F.col("id").alias("persona_id"), "type_name")
    return p.join(nodes(spark, d), "persona_id").select("persona_id", "type_name", "graph_id", "event_id", "event")


@query("J3_session_event", "SELECT s.session_id, coalesce(n.event, '') AS event FROM sess s LEFT JOIN (SELECT event_id, min(event) AS event FROM nodes GROUP BY 1) n USING (event_id)", uses="sess nodes")
def _(spark, d):
    n = nodes(spark, d).groupBy("event_id").agg(F.min("event").alias("event"))
    return sessions(spark, d).join(n, "event_id", "left").select("session_id", F.coalesce("event", F.lit("")).alias("event"))


@query("J4_point_event", "SELECT k.kp_id, coalesce(e.event, '') AS event FROM kps k LEFT JOIN (SELECT s.session_id, min(n.event) AS event FROM sess s JOIN nodes n USING (event_id) GROUP BY 1) e USING (session_id)", uses="kps sess nodes")
def _(spark, d):
    e = sessions(spark, d).join(nodes(spark, d).select("event_id", "event"), "event_id").groupBy("session_id").agg(F.min("event").alias("event"))
    return key_points(spark, d).join(e, "session_id", "left").select("kp_id", F.coalesce("event", F.lit("")).alias("event"))


@query("J12_trigger_sources", f"SELECT e.src, e.dst, s.event AS source_event FROM (WITH {EDGES} SELECT * FROM edges) e JOIN (SELECT event_id, min(event) AS event FROM nodes GROUP BY 1) s ON s.event_id = e.src", uses="nodes")
def _(spark, d):
    n = nodes(spark, d)
    s = n.groupBy(F.col("event_id").alias("src")).agg(F.min("event").alias("source_event"))
    return C.edges(n).join(s, "src").select("src", "dst", "source_event")


@query("J15_known_points", """
    SELECT s.persona_id, s.session_id, count(k.kp_id) AS known FROM (SELECT DISTINCT persona_id, session_id FROM sess WHERE persona_id IS NOT NULL) s
    LEFT JOIN kps k ON k.persona_id = s.persona_id AND k.session_id <= s.session_id GROUP BY 1, 2
    """, uses="sess kps")
def _(spark, d):
    # the inequality join per persona is a running count over both sides in one order
    s = sessions(spark, d).where("persona_id is not null").select("persona_id", "session_id").distinct().withColumn("k", F.lit(0))
    k = key_points(spark, d).where("persona_id is not null and session_id is not null").groupBy("persona_id", "session_id").agg(F.count("*").alias("k"))
    both = s.withColumn("is_session", F.lit(1)).unionByName(k.withColumn("is_session", F.lit(0)))
    w = Window.partitionBy("persona_id").orderBy("session_id", "is_session").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("known", F.sum("k").over(w)).where("is_session = 1").select("persona_id", "session_id", "known")


UNITS = f"""
    SELECT persona_id, session_id, pos, CASE WHEN max(boundary::INT) OVER (PARTITION BY persona_id, unit) = 1 THEN unit END AS unit, boundary FROM (
        SELECT *, coalesce(sum(boundary::INT) OVER (PARTITION BY persona_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS unit FROM (
            SELECT *, c % 3 = 0 AND NOT is_noise AS boundary FROM (SELECT persona_id, session_id, is_noise, {ROW} - 1 AS pos,
                sum((NOT is_noise)::INT) OVER (PARTITION BY persona_id ORDER BY original_index, session_id ROWS UNBOUNDED PRECEDING) AS c FROM sess WHERE persona_id IS NOT NULL)))
"""


@query("W1_units", UNITS, uses="sess")
def _(spark, d):
    return C.units(sessions(spark, d).where("persona_id is not null"), 3)


@query("W3_keep_latest", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 5")
def _(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, d, "events").withColumn("n", F.row_number().over(w)).where("n <= 5").select("user_id", "event_id")


@query("W4_rank", "SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events")
def _(spark, d):
    return ranked(table(spark, d, "events").select("event_type", "event_id", "value"), "event_type", [F.desc("value"), F.col("event_id")], "rank").select("event_type", "event_id", "rank")


@query("W5_conversation_offsets", "SELECT session_id, turn, role, CAST(sum(length(coalesce(content, ''))) OVER (PARTITION BY session_id ORDER BY turn, role, content NULLS FIRST ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM turns", uses="turns")
def _(spark, d):
    w = Window.partitionBy("session_id").orderBy("turn", "role", "content").rowsBetween(Window.unboundedPreceding, 0)
    return turns(spark, d).select("session_id", "turn", "role", F.sum(F.length(F.coalesce("content", F.lit("")))).over(w).alias("upto"))


@query("W6_session_packing")
def _(spark, d):
    return C.packed(turns(spark, d), 600)


@query("W7_cumulative_dedup", "SELECT persona_id, session_id, count(*) AS fresh FROM (SELECT persona_id, session_id, row_number() OVER (PARTITION BY persona_id, category, name ORDER BY session_id NULLS FIRST, kp_id) AS n FROM kps) WHERE n = 1 GROUP BY 1, 2", uses="kps")
def _(spark, d):
    w = Window.partitionBy("persona_id", "category", "name").orderBy("session_id", "kp_id")
    return key_points(spark, d).withColumn("n", F.row_number().over(w)).where("n = 1").groupBy("persona_id", "session_id").agg(F.count("*").alias("fresh"))


@query("W8_interval_sampling", f"SELECT persona_id, session_id, n FROM (SELECT persona_id, session_id, {ROW} AS n FROM sess WHERE persona_id IS NOT NULL) WHERE n % 4 = 0", uses="sess")
def _(spark, d):
    w = Window.partitionBy("persona_id").orderBy(F.col("original_index").asc_nulls_last(), "session_id")
    return sessions(spark, d).where("persona_id is not null").withColumn("n", F.row_number().over(w)).where("n % 4 = 0").select("persona_id", "session_id", "n")


@query("W9_noise_gaps", f"SELECT session_id, pos - lag(pos, 1, -1) OVER (PARTITION BY persona_id ORDER BY pos) - 1 AS gap FROM (SELECT persona_id, session_id, is_noise, {ROW} - 1 AS pos FROM sess WHERE persona_id IS NOT NULL) WHERE is_noise", uses="sess")
def _(spark, d):
    w = Window.partitionBy("persona_id")
    s = sessions(spark, d).where("persona_id is not null").withColumn("pos", F.row_number().over(w.orderBy(F.col("original_index").asc_nulls_last(), "session_id")) - 1).where("is_noise")
    return s.select("session_id", (F.col("pos") - F.lag("pos", 1, -1).over(w.orderBy("pos")) - 1).alias("gap"))


@query("W14_recent_facts", "SELECT persona_id, kp_id FROM (SELECT persona_id, kp_id, row_number() OVER (PARTITION BY persona_id ORDER BY session_id DESC NULLS LAST, kp_id DESC) AS n FROM kps) WHERE n <= 4", uses="kps")
def _(spark, d):
    w = Window.partitionBy("persona_id").orderBy(F.col("session_id").desc_nulls_last(), F.desc("kp_id"))
    return key_points(spark, d).withColumn("n", F.row_number().over(w)).where("n <= 4").select("persona_id", "kp_id")


@query("T9_top_points", "SELECT persona_id, kp_id FROM (SELECT *, row_number() OVER (PARTITION BY persona_id ORDER BY coalesce(trap_score, 0.5) DESC, session_id NULLS FIRST, kp_id) AS n FROM kps) WHERE n <= 3", uses="kps")
def _(spark, d):
    w = Window.partitionBy("persona_id").orderBy(F.coalesce("trap_score", F.lit(0.5)).desc(), "session_id", "kp_id")
    return key_points(spark, d).withColumn("n", F.row_number().over(w)).where("n <= 3").select("persona_id", "kp_id")


@query("T10_timed_points")
def _(spark, d):
    k = key_points(spark, d)
    half = k.groupBy("persona_id").agg(F.percentile("trap_score", F.lit(0.5)).alias("mid"), F.max(F.col("time").isNotNull().cast("int")).alias("timed"))
    k = k.join(half, k.persona_id.eqNullSafe(half.persona_id)).select(k["*"], "mid", "timed")
    rank = F.when(F.col("time").isNotNull() & (F.col("trap_score") >= F.col("mid")), 0).when(F.col("time").isNotNull(), 1).otherwise(2)
    best = Window.partitionBy("persona_id")
    k = k.withColumn("tier", rank).withColumn("least", F.min("tier").over(best)).where("tier = least")
    return k.withColumn("n", F.row_number().over(best.orderBy(F.xxhash64("kp_id", F.lit(42)), "kp_id"))).where("n <= 3").select("persona_id", "kp_id")


@query("T12_first_events", "SELECT persona_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY persona_id ORDER BY coalesce(event_date, '9999-12-31'), event_id) AS n FROM nodes) WHERE n <= 2", uses="nodes")
def _(spark, d):
    w = Window.partitionBy("persona_id").orderBy(F.coalesce("event_date", F.lit("9999-12-31")), "event_id")
    return nodes(spark, d).withColumn("n", F.row_number().over(w)).where("n <= 2").select("persona_id", "event_id")


@query("U7_unused_points", "SELECT k.kp_id FROM kps k ANTI JOIN (SELECT DISTINCT p.category AS category, p.name AS name, p.content AS content FROM (SELECT unnest(source_key_points) AS p FROM queries)) u ON k.category = u.category AND k.name = u.name AND k.content = u.content", uses="kps")
def _(spark, d):
    used = table(spark, d, "queries").select(F.explode("source_key_points").alias("p")).select("p.category", "p.name", "p.content")
    return key_points(spark, d).join(used, ["category", "name", "content"], "left_anti").select("kp_id")
