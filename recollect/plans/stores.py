"""Stores, histories, checkpoints and logs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from recollect.operators import stores as S
from recollect.plans.registry import key_points, nodes, query, results, sessions, turns
from recollect.runtime import materialize, table
from recollect.sources import files

OP = "CASE WHEN event_type = 'click' THEN 'ADD' WHEN event_type = 'view' THEN 'UPDATE' WHEN event_type = 'error' THEN 'DELETE' ELSE 'NONE' END"


def log(spark, d):
    op = F.when(F.col("event_type") == "click", "ADD").when(F.col("event_type") == "view", "UPDATE").when(F.col("event_type") == "error", "DELETE").otherwise("NONE")
    return table(spark, d, "events").select((F.col("event_id") % 500).alias("memory_id"), "event_id", op.alias("op"), F.round("value", 6).alias("fact"))


@query("R28_fold_operations", f"""
    SELECT memory_id, arg_max(fact, event_id) FILTER (WHERE op IN ('ADD', 'UPDATE')) AS fact, count(*) FILTER (WHERE op IN ('ADD', 'UPDATE')) AS version
    FROM (SELECT event_id % 500 AS memory_id, event_id, {OP} AS op, round(value, 6) AS fact FROM events) GROUP BY 1
    HAVING max(event_id) FILTER (WHERE op IN ('ADD', 'UPDATE')) > coalesce(max(event_id) FILTER (WHERE op = 'DELETE'), -1)
    """)
def _(spark, d):
    return S.fold_log(log(spark, d), "memory_id", ["event_id"], "op", "fact")


@query("R30_eviction", "SELECT event_id FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS c, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE c < 48 OR n <= 60")
def _(spark, d):
    return S.evicted(table(spark, d, "events"), "user_id", [F.desc("ts"), F.desc("event_id")], 60).select("event_id")


@query("R35_valid_at", "SELECT event_id, start_date, coalesce(lead(start_date) OVER (PARTITION BY persona_id, type ORDER BY start_date NULLS FIRST, event_id), 'present') AS invalid_at FROM nodes", uses="nodes")
def _(spark, d):
    w = Window.partitionBy("persona_id", "type").orderBy("start_date", "event_id")
    return nodes(spark, d).select("event_id", "start_date", F.coalesce(F.lead("start_date").over(w), F.lit("present")).alias("invalid_at"))


@query("S18_checkpoint_upsert", "SELECT query_id, question, is_correct, 'new' AS state FROM results WHERE query_type = 'state_update' UNION ALL SELECT query_id, question, is_correct, 'old' FROM results WHERE query_type <> 'state_update' AND query_id NOT IN (SELECT query_id FROM results WHERE query_type = 'state_update')", uses="results")
def _(spark, d):
    r = results(spark, d).select("query_id", "question", "is_correct", "query_type")
    old, new = r.withColumn("state", F.lit("old")), r.where("query_type = 'state_update'").withColumn("state", F.lit("new"))
    return S.upsert(old, new, ["query_id"]).drop("query_type")


@query("X40_q_learning", "SELECT user_id, count(*) AS visits, round(sum(0.3 * value * pow(0.7, later)), 6) AS q, round(sum(0.2 * value * pow(0.8, later)), 6) AS average FROM (SELECT user_id, value, count(*) OVER (PARTITION BY user_id ORDER BY event_id DESC ROWS UNBOUNDED PRECEDING) - 1 AS later FROM events) GROUP BY 1")
def _(spark, d):
    q = S.q_learning(table(spark, d, "events"), "user_id", "event_id", "value")
    return q.select("user_id", F.col("visits").cast("long").alias("visits"), F.round("q", 6).alias("q"), F.round("average", 6).alias("average"))


@query("Q10_exact_dedup", "SELECT kp_id FROM (SELECT kp_id, row_number() OVER (PARTITION BY persona_id, md5(content) ORDER BY (trap_score IS NOT NULL) DESC, kp_id) AS n FROM kps WHERE content IS NOT NULL) WHERE n = 1", uses="kps")
def _(spark, d):
    w = Window.partitionBy("persona_id", F.md5("content")).orderBy(F.col("trap_score").isNotNull().desc(), "kp_id")
    return key_points(spark, d).where("content is not null").withColumn("n", F.row_number().over(w)).where("n = 1").select("kp_id")


@query("Q11_session_gaps", "SELECT user_id, segment, count(*) AS n, min(ts) AS began FROM (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM (SELECT *, coalesce((epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 7200)::INT, 0) AS new FROM events)) GROUP BY 1, 2")
def _(spark, d):
    return S.sessionized(table(spark, d, "events").select("user_id", "event_id", "ts"), ["user_id"], "ts", 7200).groupBy("user_id", "segment").agg(F.count("*").alias("n"), F.min("ts").alias("began"))


@query("Q12_turn_groups", "SELECT session_id, grp, count(*) AS messages FROM (SELECT session_id, CAST(sum((role = 'user')::INT) OVER (PARTITION BY session_id ORDER BY turn, role, content NULLS FIRST ROWS UNBOUNDED PRECEDING) AS BIGINT) AS grp FROM turns) GROUP BY 1, 2", uses="turns")
def _(spark, d):
    w = Window.partitionBy("session_id").orderBy("turn", "role", "content").rowsBetween(Window.unboundedPreceding, 0)
    return turns(spark, d).withColumn("grp", F.sum((F.col("role") == "user").cast("int")).over(w)).groupBy("session_id", "grp").agg(F.count("*").alias("messages"))


@query("Q13_daily_buckets", "SELECT CAST(ts AS DATE) AS day, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'purchase') AS purchase, count(*) FILTER (WHERE event_type = 'view') AS view FROM events GROUP BY 1")
def _(spark, d):
    p = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).pivot("event_type", ["click", "purchase", "view"]).agg(F.count(F.lit(1)))
    return p.fillna(0)


@query("S1_persona_scan", "SELECT persona_id FROM (SELECT DISTINCT persona_id FROM sess WHERE persona_id IS NOT NULL ORDER BY 1 LIMIT 20)", uses="sess")
def _(spark, d):
    return sessions(spark, d).where("persona_id is not null").select("persona_id").distinct().orderBy("persona_id").limit(20)


@query("S4_filtered_head", "SELECT doc_id FROM documents WHERE source = 'leaflets' ORDER BY doc_id LIMIT 10")
def _(spark, d):
    return table(spark, d, "documents").where("source = 'leaflets'").orderBy("doc_id").limit(10).select("doc_id")


@query("S9_json_report")
def _(spark, d):
    summary = results(spark, d).groupBy("query_type").agg(F.count("*").alias("total"), F.avg(F.col("is_correct").cast("int")).alias("accuracy"))
    return files.json_round_trip(summary)


@query("S14_csv_report")
def _(spark, d):
    return files.csv_round_trip(results(spark, d).groupBy("query_type").agg(F.count("*").alias("total")))


@query("S13_check_report")
def _(spark, d):
    r = results(spark, d).groupBy("query_type").agg(F.count("*").alias("n"), F.round(F.avg(F.col("is_correct").cast("int")), 4).alias("rate"))
    return r.select(F.format_string("| %s | %d | %.4f |", "query_type", "n", "rate").alias("line")).orderBy("line")


@query("S19_index_persisted", "SELECT vec_id, label FROM vecs", uses="vecs")
def _(spark, d):
    return materialize(table(spark, d, "embeddings"), "index").select("vec_id", "label")


@query("S11_relational_join", "SELECT p.id AS persona_id, count(DISTINCT s.session_id) AS sessions, count(DISTINCT t.turn) AS turns FROM personas p LEFT JOIN sess s ON s.persona_id = p.id LEFT JOIN turns t ON t.session_id = s.session_id GROUP BY 1", uses="sess turns")
def _(spark, d):
    p = table(spark, d, "personas").select(F.col("id").alias("persona_id"))
    s = sessions(spark, d).select("persona_id", "session_id")
    t = turns(spark, d).select("session_id", "turn")
    return p.join(s, "persona_id", "left").join(t, "session_id", "left").groupBy("persona_id").agg(F.countDistinct("session_id").alias("sessions"), F.countDistinct("turn").alias("turns"))


@query("S17_migrated_tables", "SELECT n_name, r_name, count(c_custkey) AS customers FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2")
def _(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.join(table(spark, d, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("n_name", "r_name").agg(F.count("c_custkey").alias("customers"))
