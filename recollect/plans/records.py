"""Units, injection, stores, histories, graphs that change and streams with state (W2, W10, W11, T11, C15, C16, S12, S15, F9, Q22, R26, R27, R29, R31, ST2-ST11)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from recollect.operators import curation as C
from recollect.operators import graph as G
from recollect.operators import stores as S
from recollect.operators.filters import compile_filter
from recollect.plans.graphs import E, graph, wrap
from recollect.plans.registry import key_points, nodes, query, results, sessions, vectors
from recollect.plans.stores import OP, log
from recollect.plans.streams import events
from recollect.runtime import table
from recollect.streaming import streams as T


@query(
    "W2_merged_units",
    """
    SELECT row_number() OVER (ORDER BY block) - 1 AS unit, persona_id, eval_session_id, sessions, queries FROM (
        SELECT block, count(*) AS sessions, max(session_id) FILTER (WHERE clean = 1 AND c % 10 = 0) AS eval_session_id, max(persona_id) FILTER (WHERE clean = 1 AND c % 10 = 0) AS persona_id FROM (
            SELECT *, CAST(c - clean AS BIGINT) // 10 AS block FROM (SELECT *, sum(clean) OVER (ORDER BY persona_id, original_index NULLS LAST, session_id, is_noise ROWS UNBOUNDED PRECEDING) AS c
                FROM (SELECT DISTINCT persona_id, session_id, original_index, is_noise, (NOT is_noise)::INT AS clean FROM sess WHERE persona_id IS NOT NULL))) GROUP BY 1)
    JOIN (SELECT session_id AS eval_session_id, count(DISTINCT query_id) AS queries FROM queries GROUP BY 1) USING (eval_session_id)
    """,
    uses="sess",
)
def _(spark, d):
    return C.merged_units(sessions(spark, d).where("persona_id is not null"), table(spark, d, "queries"), 10)


@query(
    "W10_recent_events",
    """
    SELECT DISTINCT event_id, context FROM (
        SELECT event_id, unnest([lag(event_id, 1) OVER w, lag(event_id, 2) OVER w, lag(event_id, 3) OVER w]) AS context FROM (SELECT DISTINCT persona_id, event_id, event_date FROM nodes WHERE event_date IS NOT NULL) WINDOW w AS (PARTITION BY persona_id ORDER BY event_date, event_id)
        UNION ALL SELECT event_id, unnest(triggered_by) FROM nodes) WHERE context IS NOT NULL AND context <> event_id
    """,
    uses="nodes",
)
def _(spark, d):
    n = nodes(spark, d)
    w = Window.partitionBy("persona_id").orderBy("event_date", "event_id")
    recent = n.where("event_date is not null").select("persona_id", "event_id", "event_date").distinct().select("event_id", F.array(*(F.lag("event_id", k).over(w) for k in (1, 2, 3))).alias("before")).select("event_id", F.explode("before").alias("context"))
    return recent.union(n.select("event_id", F.explode("triggered_by").alias("context"))).where("context is not null and context <> event_id").distinct()


TRAPS = tuple(t for t in C.EVENT_TYPES if t not in ("health", "life", "work")) + ("trap",)


@query("W11_first_trap_event", f"SELECT persona_id, type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY persona_id, type ORDER BY event_date NULLS LAST, event_id) AS n FROM nodes WHERE lower(type) IN {TRAPS}) WHERE n = 1", uses="nodes")
def _(spark, d):
    n = nodes(spark, d).where(F.lower("type").isin(*TRAPS)).select("persona_id", "type", F.struct(F.coalesce("event_date", F.lit("\U0010ffff")).alias("at"), "event_id").alias("first"))
    return n.groupBy("persona_id", "type").agg(F.min("first").alias("first")).select("persona_id", "type", "first.event_id")


@query(
    "T11_category_choice",
    """
    SELECT persona_id, category, points, used, row_number() OVER (PARTITION BY persona_id ORDER BY used, category NULLS FIRST) AS choice FROM (
        SELECT k.persona_id, k.category, k.points, coalesce(u.used, 0) AS used FROM (SELECT persona_id, category, count(*) AS points FROM kps WHERE persona_id IS NOT NULL AND session_id <= (SELECT quantile_disc(session_id, 0.9) FROM kps) GROUP BY 1, 2 HAVING count(*) >= 2 AND count(DISTINCT session_id) >= 2) k
        LEFT JOIN (SELECT persona_id, category, count(DISTINCT query_id) AS used FROM (SELECT persona_id, query_id, unnest(source_key_points).category AS category FROM queries) GROUP BY 1, 2) u ON u.persona_id = k.persona_id AND u.category = k.category)
    """,
    uses="kps",
)
def _(spark, d):
    k = key_points(spark, d)
    current = k.agg(F.expr("percentile_disc(0.9) within group (order by session_id)").alias("current"))  # one row: the session up to which points count
    g = k.join(F.broadcast(current)).where("persona_id is not null and session_id <= current").groupBy("persona_id", "category").agg(F.count("*").alias("points"), F.countDistinct("session_id").alias("s")).where("points >= 2 and s >= 2")
    u = table(spark, d, "queries").select("persona_id", "query_id", F.explode("source_key_points.category").alias("category")).groupBy("persona_id", "category").agg(F.countDistinct("query_id").alias("used"))
    c = g.join(u, ["persona_id", "category"], "left").select("persona_id", "category", "points", F.coalesce("used", F.lit(0)).alias("used"))
    return c.withColumn("choice", F.row_number().over(Window.partitionBy("persona_id").orderBy("used", F.col("category").asc_nulls_first())))


def drawn_sql(x: str) -> str:
    return f"('0x' || md5({x})[1:8])::BIGINT"


@query(
    "C15_noise_injection",
    f"""
    , o AS (SELECT persona_id, session_id, row_number() OVER (PARTITION BY persona_id ORDER BY session_id) - 1 AS spot FROM (SELECT DISTINCT persona_id, session_id FROM sess WHERE NOT is_noise AND persona_id IS NOT NULL)),
    n AS (SELECT persona_id, session_id, row_number() OVER (PARTITION BY persona_id ORDER BY session_id) - 1 AS i, count(*) OVER (PARTITION BY persona_id) AS M FROM (SELECT DISTINCT persona_id, session_id FROM sess WHERE is_noise AND persona_id IS NOT NULL)),
    b AS (SELECT n.*, N, CASE WHEN i < M * 3 // 10 THEN 1 WHEN i < M * 3 // 10 * 2 THEN 2 WHEN i < M * 3 // 10 * 2 + M * 2 // 10 THEN 3 WHEN i < M * 3 // 10 * 2 + M * 2 // 10 + M // 10 THEN 4 ELSE 5 END AS k FROM n JOIN (SELECT persona_id, count(*) AS N FROM o GROUP BY 1) USING (persona_id)),
    p AS (SELECT persona_id, place, row_number() OVER (PARTITION BY persona_id ORDER BY place, i) - 1 AS i FROM (SELECT persona_id, i, {drawn_sql("persona_id || ':' || i || ':42'")} % (greatest(1, N * k // 5) + 1) AS place FROM b))
    SELECT persona_id, session_id, kind = 0 AS is_noise, row_number() OVER (PARTITION BY persona_id ORDER BY place, kind, i) - 1 AS position FROM (
        SELECT persona_id, session_id, spot AS place, spot AS i, 1 AS kind FROM o UNION ALL SELECT n.persona_id, n.session_id, p.place, n.i, 0 FROM n JOIN p USING (persona_id, i))
    """,
    uses="sess",
)
def _(spark, d):
    s = sessions(spark, d).where("persona_id is not null").select("persona_id", "session_id", "is_noise").distinct()
    o = s.where("not is_noise").withColumn("at", F.row_number().over(Window.partitionBy("persona_id").orderBy("session_id")) - 1)
    return C.interleaved(o, s.where("is_noise"), "persona_id", "session_id", "42")


DAYS = "regexp_matches(event_date, '^\\d{4}-\\d{2}-\\d{2}$') AND persona_id IS NOT NULL"


@query(
    "C16_trap_insertion",
    f"""
    , o AS (SELECT persona_id, event_id, event_date, row_number() OVER (PARTITION BY persona_id ORDER BY event_date, event_id) - 1 AS spot FROM (SELECT DISTINCT persona_id, event_id, event_date FROM nodes WHERE {DAYS} AND lower(type) NOT IN {TRAPS})),
    h AS (SELECT persona_id, min(event_date)::DATE AS a, date_diff('day', min(event_date)::DATE, max(event_date)::DATE) AS days, count(*) AS N FROM o GROUP BY 1),
    t AS (SELECT persona_id, event_id, CAST(a + CAST({drawn_sql("event_id || ':date'")} % (days + 1) AS INT) AS VARCHAR) AS event_date, {drawn_sql("event_id || ':place'")} % (N + 1) AS place FROM (SELECT DISTINCT persona_id, event_id FROM nodes WHERE persona_id IS NOT NULL AND lower(type) IN {TRAPS}) JOIN h USING (persona_id))
    SELECT persona_id, event_id, event_date, kind = 0 AS is_trap, row_number() OVER (PARTITION BY persona_id ORDER BY place, kind, event_id) - 1 AS position FROM (SELECT persona_id, event_id, event_date, spot AS place, 1 AS kind FROM o UNION ALL SELECT persona_id, event_id, event_date, place, 0 FROM t)
    """,
    uses="nodes",
)
def _(spark, d):
    n = nodes(spark, d).where("persona_id is not null")
    trap = F.coalesce(F.lower("type").isin(*TRAPS), F.lit(False))
    o = n.where(~trap & F.col("type").isNotNull() & F.col("event_date").rlike(r"^\d{4}-\d{2}-\d{2}$")).select("persona_id", "event_id", "event_date").distinct()
    return C.traps_inserted(o, n.where(trap).select("persona_id", "event_id").distinct(), "persona_id")


@query(
    "S12_nested_export",
    "SELECT persona_id, to_json(list({'event_id': event_id, 'event': event, 'type': type, 'event_date': event_date} ORDER BY event_id, event, type, event_date)) AS events FROM (SELECT DISTINCT persona_id, event_id, event, type, event_date FROM nodes WHERE persona_id IS NOT NULL) GROUP BY 1",
    uses="nodes",
)
def _(spark, d):
    # one document per persona is what is exported, so a persona's events form one array
    n = nodes(spark, d).where("persona_id is not null").select("persona_id", "event_id", "event", "type", "event_date").distinct()
    g = n.groupBy("persona_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event", "type", "event_date"))).alias("e"))
    return g.select("persona_id", F.to_json("e", {"ignoreNullFields": "false"}).alias("events"))


@query(
    "S15_collection",
    """
    , c AS (SELECT vec_id, v, CASE WHEN vec_id % 10 = 0 THEN 99 ELSE label END AS label FROM vecs WHERE vec_id % 7 <> 0 AND vec_id % 13 <> 0)
    SELECT query_id, vec_id, label FROM (SELECT q.vec_id AS query_id, c.vec_id, c.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.v, c.v), 9) DESC, c.vec_id) AS n FROM vecs q, c WHERE q.vec_id % 50 = 0 AND c.label <> 1) WHERE n <= 3
    """,
    uses="vecs",
)
def _(spark, d):
    v = vectors(spark, d)
    c = S.Collection(v.where("vec_id % 7 <> 0 and vec_id % 2 = 0")).insert(v.where("vec_id % 7 <> 0"))
    c = c.update(v.where("vec_id % 10 = 0").withColumn("label", F.lit(99))).delete(F.col("vec_id") % 13 == 0).save("collection")
    hits = c.search(v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "v"), 3, F.col("label") != 1)
    return hits.join(c.list().select("vec_id", "label"), "vec_id").select("query_id", "vec_id", "label")


@query(
    "F9_filter_tree",
    """
    SELECT id FROM personas WHERE (coalesce(list_contains(health_goals, 'painting the fence'), false) OR coalesce(list_has_any(health_goals, ['hanging laundry', '粉刷围栏']), false) OR coalesce(enriched.lifestyle.diet_habits ILIKE '%egg%', false))
        AND NOT coalesce(gender IN ('M', 'm'), false) AND coalesce(id >= 5, false)
    """,
)
def _(spark, d):
    tree = {"and": [{"or": [{"health_goals": {"contains": "painting the fence"}}, {"health_goals": {"in": ["hanging laundry", "粉刷围栏"]}}, {"enriched.lifestyle.diet_habits": {"like": "%egg%"}}]}, {"not": {"gender": {"in": ["M", "m"]}}}, {"id": {"gte": 5}}]}
    return table(spark, d, "personas").where(compile_filter(tree, arrays=("health_goals",))).select("id")


@query("Q22_all_users", "SELECT kp_id, persona_id FROM kps WHERE contains(lower(content), 'pressure') OR contains(content, '血压') ORDER BY session_id DESC NULLS LAST, kp_id LIMIT 30", uses="kps")
def _(spark, d):
    # the search of one user's memory without its owner predicate
    hit = F.contains(F.lower("content"), F.lit("pressure")) | F.contains("content", F.lit("血压"))
    return key_points(spark, d).where(hit).orderBy(F.col("session_id").desc_nulls_last(), "kp_id").limit(30).select("kp_id", "persona_id")


VERDICT = "CASE event_type WHEN 'click' THEN 'neutral' WHEN 'view' THEN 'entailment' ELSE 'contradiction' END"


@query(
    "R26_history_verdicts",
    f"""
    SELECT memory_id, round(arg_max(value, event_id) FILTER (WHERE v <> 'entailment'), 6) AS current, count(*) FILTER (WHERE v = 'entailment') AS duplicates, greatest(count(*) FILTER (WHERE v <> 'entailment') - 1, 0) AS archived,
        arg_max(event_id, event_id) FILTER (WHERE v = 'contradiction') AS last_conflict FROM (SELECT event_id % 500 AS memory_id, event_id, value, {VERDICT} AS v FROM events) GROUP BY 1
    """,
)
def _(spark, d):
    v = F.when(F.col("event_type") == "click", "neutral").when(F.col("event_type") == "view", "entailment").otherwise("contradiction")
    e = table(spark, d, "events").select((F.col("event_id") % 500).alias("memory_id"), "event_id", F.round("value", 6).alias("value"), v.alias("verdict"))
    return S.resolved(e, "memory_id", "event_id", "value", "verdict").withColumnRenamed("value", "current")


@query(
    "R27_graph_changes",
    wrap(
        f"{E}, k AS (SELECT src, dst FROM e WHERE src % 11 <> 0 AND dst % 11 <> 0), m AS (SELECT DISTINCT CASE WHEN src % 7 = 1 THEN src - 1 ELSE src END AS src, CASE WHEN dst % 7 = 1 THEN dst - 1 ELSE dst END AS dst FROM k), c AS (SELECT src, dst FROM m WHERE src <> dst UNION SELECT 0, 5), n AS (SELECT DISTINCT CASE WHEN event_id % 7 = 1 THEN event_id - 1 ELSE event_id END AS node FROM nodes WHERE event_id % 11 <> 0 UNION SELECT unnest([0, 5]))",
        "SELECT node, (SELECT count(*) FROM c WHERE dst = node) AS predecessors, (SELECT count(*) FROM c WHERE src = node) AS successors FROM n",
    ),
    uses="nodes",
)
def _(spark, d):
    n, e = graph(spark, d)
    g = G.Graph(n, e).delete_nodes(F.col("node") % 11 == 0).merge(F.when(F.col("node") % 7 == 1, F.col("node") - 1).otherwise(F.col("node")))
    return g.add_edges(spark.createDataFrame([(0, 5)], "src long, dst long")).degrees()


@query(
    "R29_history",
    f"""
    SELECT memory_id, event_id, op, CASE WHEN last.op <> 'DELETE' THEN last.fact END AS old_fact FROM (
        SELECT *, last_value(CASE WHEN op <> 'NONE' THEN {{'op': op, 'fact': fact}} END IGNORE NULLS) OVER (PARTITION BY memory_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last
        FROM (SELECT event_id % 500 AS memory_id, event_id, {OP} AS op, round(value, 6) AS fact FROM events))
    """,
)
def _(spark, d):
    return S.history(log(spark, d), "memory_id", "event_id", "op", "fact").select("memory_id", "event_id", "op", F.col("old").alias("old_fact"))


@query(
    "R29_replay",
    f"""
    SELECT memory_id, arg_max(fact, event_id) FILTER (WHERE op IN ('ADD', 'UPDATE')) AS fact, count(*) FILTER (WHERE op IN ('ADD', 'UPDATE')) AS version
    FROM (SELECT event_id % 500 AS memory_id, event_id, {OP} AS op, round(value, 6) AS fact FROM events WHERE ts <= TIMESTAMP '2024-01-12') GROUP BY 1
    HAVING max(event_id) FILTER (WHERE op IN ('ADD', 'UPDATE')) > coalesce(max(event_id) FILTER (WHERE op = 'DELETE'), -1)
    """,
)
def _(spark, d):
    """The state of the memory as it was at a time: the log up to then, folded."""
    e = table(spark, d, "events").where(F.col("ts") <= F.lit("2024-01-12").cast("timestamp_ntz")).select("event_id")
    return S.fold_log(log(spark, d).join(e, "event_id", "left_semi"), "memory_id", ["event_id"], "op", "fact")


@query(
    "R31_monitor_update",
    """
    , old AS (SELECT user_id, event_type, round(max(value), 6) AS score, count(*) AS recordings FROM events WHERE ts < TIMESTAMP '2024-01-29' GROUP BY 1, 2), new AS (SELECT user_id, event_type, round(max(value), 6) AS score FROM events WHERE ts >= TIMESTAMP '2024-01-29' GROUP BY 1, 2),
    s AS (SELECT n.user_id, n.event_type, n.score, coalesce(o.recordings, 0) + 1 AS recordings FROM new n LEFT JOIN old o USING (user_id, event_type)),
    g AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_type) AS n FROM old o WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.user_id = o.user_id AND new.event_type = o.event_type))
    SELECT user_id, event_type, score, recordings FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, recordings DESC, event_type) AS n FROM (SELECT * FROM s UNION ALL SELECT user_id, event_type, 0.0, 1 FROM g WHERE n <= 2)) WHERE n <= 4
    """.replace(", old AS", "WITH old AS", 1),
)
def _(spark, d):
    e, cut = table(spark, d, "events"), F.lit("2024-01-29").cast("timestamp_ntz")
    score = F.round(F.max("value"), 6).alias("score")
    old = e.where(F.col("ts") < cut).groupBy("user_id", "event_type").agg(score, F.count("*").alias("recordings"))
    return S.retained(old, e.where(F.col("ts") >= cut).groupBy("user_id", "event_type").agg(score), "user_id", "event_type", 2, 4).select("user_id", "event_type", "score", "recordings")


@query("ST2_fair_share", "SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 5 AS round FROM events")
def _(spark, d):
    return T.drained(T.fair_rounds(events(spark, d), "user_id", "event_id", 5))


@query("ST3_reclaimed", "SELECT task, deliveries, e - sent AS idle_seconds FROM (SELECT event_id % 700 AS task, max(sec) FILTER (WHERE event_type <> 'purchase') AS sent, max(sec) FILTER (WHERE event_type = 'purchase') AS done, count(*) FILTER (WHERE event_type <> 'purchase') AS deliveries FROM (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events) GROUP BY 1), (SELECT CAST(floor(max(epoch(ts))) AS BIGINT) AS e FROM events) WHERE sent IS NOT NULL AND (done IS NULL OR sent > done) AND e - sent >= 3600")
def _(spark, d):
    e = T.drained(events(spark, d).select("event_id", "event_type", F.unix_seconds("ts").alias("at")))
    return T.reclaimable(e.withColumn("task", F.col("event_id") % 700), "task", "at", F.col("event_type") == "purchase", 3600)


@query("ST4_routing", "SELECT event_id, user_id % 4 AS lane, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position FROM events")
def _(spark, d):
    """A lane by the user, so that a user's events keep their order within it."""
    e = T.drained(events(spark, d).select("event_id", "user_id", "ts", (F.col("user_id") % 4).alias("lane")))
    return e.select("event_id", "lane", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("position"))


@query(
    "ST7_periodic_refresh",
    """
    SELECT user_id, max(sec) AS last, count(*) AS refreshes FROM (
        WITH RECURSIVE ev AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events), r(user_id, sec) AS (SELECT user_id, min(sec) FROM ev GROUP BY 1 UNION ALL SELECT r.user_id, min(ev.sec) FROM r JOIN ev ON ev.user_id = r.user_id AND ev.sec >= r.sec + 86400 GROUP BY 1) SELECT * FROM r) GROUP BY 1
    """,
)
def _(spark, d):
    e = events(spark, d).select("user_id", F.unix_seconds("ts").alias("at"))
    return T.drained(T.refresher(e, "user_id", "at", 86400), "update")


@query(
    "ST8_unit_builder",
    """
    SELECT persona_id, clean, units, total - coalesce(ended, 0) AS pending FROM (
        SELECT persona_id, CAST(max(c) AS BIGINT) AS clean, CAST(max(c) AS BIGINT) // 3 AS units, count(*) AS total, min(n) FILTER (WHERE c = top // 3 * 3 AND top >= 3) AS ended FROM (
            SELECT persona_id, n, c, CAST(max(c) OVER (PARTITION BY persona_id) AS BIGINT) AS top FROM (
                SELECT persona_id, row_number() OVER w AS n, sum((noise_id IS NULL AND noise_family_id IS NULL)::INT) OVER w AS c FROM sessions WHERE persona_id IS NOT NULL WINDOW w AS (PARTITION BY persona_id ORDER BY session_id ROWS UNBOUNDED PRECEDING))) GROUP BY 1)
    """,
)
def _(spark, d):
    s = T.stream_of(spark, d, "sessions").where("persona_id is not null")
    s = s.select("persona_id", "session_id", (F.col("noise_id").isNotNull() | F.col("noise_family_id").isNotNull()).alias("is_noise"))
    return T.drained(T.unit_builder(s, 3), "update").select("persona_id", "clean", "units", "pending")


@query(
    "ST10_resume",
    """
    SELECT query_id, count(*) AS runs FROM (SELECT query_id FROM (SELECT query_id, context_id, row_number() OVER (PARTITION BY context_id ORDER BY query_id) AS n FROM r) WHERE context_id < 40 OR context_id = 40 AND n <= 2 UNION ALL SELECT query_id FROM r WHERE context_id >= 40) GROUP BY 1
    """.replace("SELECT query_id, count(*)", ", r AS (SELECT DISTINCT query_id, context_id FROM results) SELECT query_id, count(*)", 1),
    uses="results",
)
def _(spark, d):
    return S.resumed(results(spark, d).select("query_id", "context_id").distinct(), "context_id", "query_id", 40, 2)


CLOSED = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


@query("ST11_tumbling", f"SELECT began, event_type, count(*) AS n, round(sum(value), 6) AS total FROM (SELECT *, time_bucket(INTERVAL 1 DAY, ts) AS began FROM events) WHERE began + INTERVAL 1 DAY <= {CLOSED} GROUP BY 1, 2")
def _(spark, d):
    return T.drained(T.windowed(events(spark, d), "1 day"))


@query("ST11_sliding", f"SELECT began, event_type, count(*) AS n, round(sum(value), 6) AS total FROM (SELECT *, time_bucket(INTERVAL 6 HOUR, ts) - to_hours(6 * k) AS began FROM events, range(4) t(k)) WHERE began + INTERVAL 1 DAY <= {CLOSED} GROUP BY 1, 2")
def _(spark, d):
    return T.drained(T.windowed(events(spark, d), "1 day", "6 hours"))


@query("ST11_sessions", f"SELECT user_id, min(ts) AS began, max(ts) + INTERVAL 2 HOUR AS ended, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, coalesce((ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 2 HOUR)::INT, 0) AS new FROM events)) GROUP BY user_id, g HAVING max(ts) + INTERVAL 2 HOUR <= {CLOSED}")
def _(spark, d):
    return T.drained(T.user_sessions(events(spark, d), "2 hours"))
