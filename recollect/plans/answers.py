"""Answer metrics and reports over whole result sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from recollect.functions import evaluation as E
from recollect.functions import text as T
from recollect.functions import vectors as V
from recollect.operators import aggregates as A
from recollect.operators import chunking as C
from recollect.plans.metrics import LETTERS, PAIRS, SAYS, f1, pairs, toks
from recollect.plans.registry import query, results, sessions, turns, vectors
from recollect.plans.reports import STATS
from recollect.runtime import table


@query("U4_letter_sets", f"SELECT query_id, question, {LETTERS.format(x='upper(o)')} = {LETTERS.format(x='upper(e)')} AS same FROM ({PAIRS})", uses="results")
def _(spark, d):
    return pairs(spark, d).select("query_id", "question", (T.option_letters(F.col("o")) == T.option_letters(F.col("e"))).alias("same"))


PARTS = "list_filter(list_transform(string_split({x}, ','), lambda s: trim(s)), lambda s: s <> '')"


def best_sql(source: str) -> str:
    """For each part of the expected answer the best F1 with a part of the output; ``source`` has query_id, question, o, e."""
    return f"""SELECT query_id, question, o, e, i, max({f1('a', 'b')}) AS best FROM (
        SELECT *, {toks('p')} AS a, {toks('g')} AS b FROM (
            SELECT query_id, question, o, e, unnest(CASE WHEN len(ps) > 0 THEN ps ELSE [o] END) AS p, g, i FROM (
                SELECT query_id, question, o, e, {PARTS.format(x='o')} AS ps, unnest(CASE WHEN len(gs) > 0 THEN gs ELSE [e] END) AS g, generate_subscripts(CASE WHEN len(gs) > 0 THEN gs ELSE [e] END, 1) AS i
                FROM (SELECT *, {PARTS.format(x='e')} AS gs FROM ({source}))))) GROUP BY ALL"""


@query("J14_best_match", f"SELECT query_id, question, CAST(i AS INT) AS part, round(best, 6) AS best FROM ({best_sql(PAIRS)})", uses="results")
def _(spark, d):
    parts = lambda c: E.parts_of(F.col(c))
    p = pairs(spark, d).select("query_id", "question", F.posexplode(parts("e")).alias("i", "g"), parts("o").alias("ps"))
    return p.select("query_id", "question", (F.col("i") + 1).alias("part"), F.round(F.array_max(F.transform("ps", lambda x: T.f1_of(T.answer_tokens(x), T.answer_tokens(F.col("g"))))), 6).alias("best"))


GRADED = "SELECT query_id, query_type, question, coalesce(model_output, '') AS o, CASE WHEN query_type = 'inference_generation' THEN trim(string_split(expected[1], ';')[1]) ELSE expected[1] END AS e FROM results"
SAID = f"(SELECT *, lower(trim(o)) AS lo, lower(trim(e)) AS le FROM ({GRADED} WHERE expected[1] IS NOT NULL))"


@query(
    "X12_f1_by_category",
    f"""
    SELECT query_id, query_type, question, round(f, 6) AS f1, f >= 0.5 AS is_correct FROM (
        SELECT query_id, query_type, question, CASE WHEN f >= 0.5 THEN f WHEN {SAYS} THEN greatest(f, 0.5) ELSE f END AS f FROM (
            SELECT *, {f1(toks('o'), toks('e'))} AS f FROM {SAID} WHERE query_type <> 'multi_hop_clinical_deduction'
            UNION ALL SELECT s.*, b.f FROM {SAID} s JOIN (SELECT query_id, question, o, e, avg(best) AS f FROM ({best_sql(f"{GRADED} WHERE expected[1] IS NOT NULL AND query_type = 'multi_hop_clinical_deduction'")}) GROUP BY ALL) b
                ON b.query_id = s.query_id AND b.question IS NOT DISTINCT FROM s.question AND b.o = s.o AND b.e = s.e WHERE query_type = 'multi_hop_clinical_deduction')
        UNION ALL SELECT query_id, query_type, question, 0.0 FROM ({GRADED}) WHERE e IS NULL)
    """,
    uses="results",
)
def _(spark, d):
    r = results(spark, d).select("query_id", "query_type", "question", F.coalesce("model_output", F.lit("")).alias("o"), F.get("expected", 0).alias("e"))
    r = r.withColumn("f", E.category_f1(F.col("o"), F.col("e"), F.col("query_type") == "multi_hop_clinical_deduction", F.col("query_type") == "inference_generation"))
    return r.select("query_id", "query_type", "question", F.round("f", 6).alias("f1"), (F.col("f") >= 0.5).alias("is_correct"))


#: A judge's reply as text: prose around an object, an object cut off, or none.
JUDGED = """SELECT query_id, question, model_output, CASE CAST(query_id[2:] AS BIGINT) % 4 WHEN 0 THEN 'Verdict: {"is_correct": ' || is_correct || ', "reason": "ok"} end' WHEN 1 THEN '{"is_correct": ' || is_correct || '}' WHEN 2 THEN '{"is_correct": tr' ELSE 'no verdict' END AS reply FROM results"""


@query(
    "X24_binary_judge",
    rf"""
    SELECT query_id, question, CASE WHEN NOT regexp_matches(coalesce(model_output, ''), '[^\s\p{{Z}}]') THEN 0.0 WHEN verdict = 'true' THEN 1.0 ELSE 0.0 END::DOUBLE AS score,
        CASE WHEN NOT regexp_matches(coalesce(model_output, ''), '[^\s\p{{Z}}]') THEN 'Empty output' WHEN verdict IS NULL THEN 'Judge failed' ELSE coalesce(reason, '') END AS reason
    FROM (SELECT *, CASE WHEN obj <> '' THEN coalesce(obj->>'is_correct', 'false') END AS verdict, CASE WHEN obj <> '' THEN obj->>'reason' END AS reason FROM (SELECT *, regexp_extract(reply, '\{{[^{{}}]*\}}') AS obj FROM ({JUDGED})))
    """,
    uses="results",
)
def _(spark, d):
    case = F.substring("query_id", 2, 20).cast("long") % 4
    flag = F.col("is_correct").cast("string")
    reply = F.when(case == 0, F.concat(F.lit('Verdict: {"is_correct": '), flag, F.lit(', "reason": "ok"} end'))).when(case == 1, F.concat(F.lit('{"is_correct": '), flag, F.lit("}"))).when(case == 2, F.lit('{"is_correct": tr')).otherwise(F.lit("no verdict"))
    v = E.binary_verdict(F.col("model_output"), reply)
    return results(spark, d).select("query_id", "question", v.getField("score").alias("score"), v.getField("reason").alias("reason"))


PHRASES = ("What happened today?", "Show me yesterday's notes", "events of the LAST 3 days", "last week please", "this week", "the last month", "so far this month", "over the last 2 weeks", "last 2 months", "whenever")
DAY = "date_trunc('day', ts)"


@query(
    "X31_temporal_phrase",
    rf"""
    SELECT event_id, CASE
        WHEN regexp_matches(p, '\btoday\b') THEN {DAY} WHEN regexp_matches(p, '\byesterday\b') THEN {DAY} - INTERVAL 1 DAY
        WHEN regexp_matches(p, '\blast\s+\d+\s+days?\b') THEN {DAY} - to_days(CAST(regexp_extract(p, '\blast\s+(\d+)\s+days?\b', 1) AS INT)) WHEN regexp_matches(p, '\blast\s+week\b') THEN {DAY} - INTERVAL 7 DAY
        WHEN regexp_matches(p, '\bthis\s+week\b') THEN date_trunc('week', ts) WHEN regexp_matches(p, '\blast\s+month\b') THEN {DAY} - INTERVAL 30 DAY WHEN regexp_matches(p, '\bthis\s+month\b') THEN date_trunc('month', ts)
        WHEN regexp_matches(p, '\blast\s+\d+\s+weeks?\b') THEN {DAY} - to_days(7 * CAST(regexp_extract(p, '\blast\s+(\d+)\s+weeks?\b', 1) AS INT))
        WHEN regexp_matches(p, '\blast\s+\d+\s+months?\b') THEN {DAY} - to_days(30 * CAST(regexp_extract(p, '\blast\s+(\d+)\s+months?\b', 1) AS INT)) END AS from_ts,
        CASE WHEN regexp_matches(p, '\byesterday\b') THEN {DAY} - INTERVAL 1 MICROSECOND WHEN p <> 'whenever' THEN {DAY} + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND END AS to_ts
    FROM (SELECT event_id, ts, lower(list_extract(['{"', '".join(x.replace("'", "''") for x in PHRASES)}'], CAST(event_id % 10 AS INT) + 1)) AS p FROM events)
    """.replace('", "', "', '"),
)
def _(spark, d):
    phrase = F.element_at(F.array(*map(F.lit, PHRASES)), (F.col("event_id") % 10).cast("int") + 1)
    r = T.date_range(phrase, F.col("ts"))
    return table(spark, d, "events").select("event_id", r.getField("from_ts").alias("from_ts"), r.getField("to_ts").alias("to_ts"))


TEMPLATES = {"temporal_localization": "When? {question}", "multiple_choice": "Choose: {question} ({type})", "default": "Question: {question}\nType: {type}"}


@query(
    "X34_prompt",
    "SELECT query_id, question, replace(replace(CASE query_type WHEN 'temporal_localization' THEN 'When? {question}' WHEN 'multiple_choice' THEN 'Choose: {question} ({type})' ELSE 'Question: {question}' || chr(10) || 'Type: {type}' END, '{type}', query_type), '{question}', coalesce(question, '-')) AS prompt FROM results",
    uses="results",
)
def _(spark, d):
    return results(spark, d).select("query_id", "question", T.filled_template(TEMPLATES, F.col("query_type"), {"type": F.col("query_type"), "question": F.col("question")}).alias("prompt"))


NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


@query(
    "X37_hashes",
    f"""
    SELECT doc_id, md5(text) AS content_hash, md5('{{"doc_id": ' || doc_id || ', "source": ' || coalesce('"' || source || '"', 'null') || '}}')[1:16] AS config_hash,
        h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || list_extract(['8', '9', 'a', 'b'], CAST((strpos('0123456789abcdef', h[17:17]) - 1) % 4 AS INT) + 1) || h[18:20] || '-' || h[21:32] AS chunk_id
    FROM (SELECT *, lower(sha1(unhex('{NAMESPACE}') || encode(doc_id || '-0'))) AS h FROM documents)
    """,
)
def _(spark, d):
    t = table(spark, d, "documents")
    return t.select("doc_id", F.md5("text").alias("content_hash"), T.config_hash({"source": F.col("source"), "doc_id": F.col("doc_id")}).alias("config_hash"), T.uuid5(NAMESPACE, F.concat(F.col("doc_id").cast("string"), F.lit("-0"))).alias("chunk_id"))


@query(
    "X41_edge_weight",
    """
    SELECT a.vec_id AS src, b.vec_id AS dst, round(0.7 * list_cosine_similarity(a.v, b.v) + 0.3 * CASE WHEN len(a.c) = 0 OR len(b.c) = 0 THEN 0 ELSE len(list_intersect(a.c, b.c)) / least(len(a.c), len(b.c))::DOUBLE END, 6) AS weight
    FROM (SELECT *, CASE WHEN vec_id % 9 = 0 THEN [] ELSE list_distinct([label, 100 + label % 2, 200 + vec_id % 3]) END AS c FROM vecs) a
    JOIN (SELECT *, CASE WHEN vec_id % 9 = 0 THEN [] ELSE list_distinct([label, 100 + label % 2, 200 + vec_id % 3]) END AS c FROM vecs) b ON b.vec_id = a.vec_id + 1
    """,
    uses="vecs",
)
def _(spark, d):
    some = F.array_distinct(F.array(F.col("label").cast("long"), (100 + F.col("label") % 2).cast("long"), (200 + F.col("vec_id") % 3).cast("long")))
    v = vectors(spark, d).select("vec_id", "v", F.when(F.col("vec_id") % 9 == 0, F.array().cast("array<bigint>")).otherwise(some).alias("c"))
    a, b = v.select(F.col("vec_id").alias("src"), F.col("v").alias("va"), F.col("c").alias("ca")), v.select((F.col("vec_id") - 1).alias("src"), F.col("vec_id").alias("dst"), F.col("v").alias("vb"), F.col("c").alias("cb"))
    return a.join(b, "src").select("src", "dst", F.round(V.edge_weight(V.cosine(F.col("va"), F.col("vb")), F.col("ca"), F.col("cb")), 6).alias("weight"))


@query("X44_url_protect", r"SELECT doc_id, len(regexp_extract_all(text, 'https?://\S+')) AS urls, md5(text) AS restored FROM documents WHERE text IS NOT NULL")
def _(spark, d):
    t = table(spark, d, "documents").where("text is not null").select("doc_id", C.protected(F.col("text")).alias("p"))
    return t.select("doc_id", F.size("p.urls").cast("long").alias("urls"), F.md5(C.restored(F.col("p.masked"), F.col("p.urls"))).alias("restored"))


@query(
    "J5_evidence_offsets",
    """
    SELECT DISTINCT q.query_id, q.evidence, t.upto FROM (SELECT query_id, 'D' || n.session_id || ':' || (n.node_id % 4 + 1) AS evidence FROM (SELECT query_id, unnest(metadata.reasoning_chain) AS n FROM queries) WHERE n.session_id IS NOT NULL) q
    JOIN (SELECT 'D' || session_id || ':' || turn AS evidence, min(upto) AS upto FROM (SELECT session_id, turn, CAST(sum(length(coalesce(content, ''))) OVER (PARTITION BY session_id ORDER BY turn, role, content NULLS FIRST ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM turns) GROUP BY 1) t USING (evidence)
    """,
    uses="turns",
)
def _(spark, d):
    n = table(spark, d, "queries").select("query_id", F.explode("metadata.reasoning_chain").alias("n")).where("n.session_id is not null")
    q = n.select("query_id", F.concat(F.lit("D"), F.col("n.session_id").cast("string"), F.lit(":"), (F.col("n.node_id") % 4 + 1).cast("string")).alias("evidence")).distinct()
    q = q.select("*", F.regexp_extract("evidence", r"^D(\d+):(\d+)$", 1).cast("long").alias("session_id"), F.regexp_extract("evidence", r"^D(\d+):(\d+)$", 2).cast("int").alias("turn"))
    w = Window.partitionBy("session_id").orderBy("turn", "role", "content").rowsBetween(Window.unboundedPreceding, 0)
    t = turns(spark, d).withColumn("upto", F.sum(F.length(F.coalesce("content", F.lit("")))).over(w)).groupBy("session_id", "turn").agg(F.min("upto").alias("upto"))
    return q.join(t, ["session_id", "turn"]).select("query_id", "evidence", "upto")


@query(
    "A3_chain_rates",
    """
    SELECT query_type, round(avg(n), 6) AS avg_ncr, round(avg(c), 6) AS avg_crc, round(avg(k), 6) AS avg_cc, CAST(sum(nodes) AS BIGINT) AS nodes,
        CASE WHEN sum(nodes) > 0 THEN round(sum(mentioned) / sum(nodes), 6) END AS node_mention_rate, CASE WHEN sum(nodes) > 0 THEN round(sum(causal) / sum(nodes), 6) END AS node_causal_rate
    FROM (SELECT DISTINCT query_id, lower(trim(query_type)) AS query_type, coalesce(len(metadata.reasoning_chain), 0) / 10.0 AS n, coalesce(metadata.hop_count, 0) / 10.0 AS c, coalesce(len(metadata.required_memory_nodes), 0) / 10.0 AS k,
        coalesce(len(metadata.reasoning_chain), 0) AS nodes, coalesce(len(list_filter(metadata.reasoning_chain, lambda x: x.session_id IS NOT NULL)), 0) AS mentioned, coalesce(len(list_filter(metadata.reasoning_chain, lambda x: x.role = 'intermediate')), 0) AS causal FROM queries) GROUP BY 1
    """,
)
def _(spark, d):
    chain = F.coalesce("metadata.reasoning_chain", F.array().cast(table(spark, d, "queries").schema["metadata"].dataType["reasoning_chain"].dataType))
    q = table(spark, d, "queries").select(
        "query_id", F.lower(F.trim("query_type")).alias("query_type"), (F.size(chain) / 10.0).alias("ncr"), (F.coalesce("metadata.hop_count", F.lit(0)) / 10.0).alias("crc"), (F.coalesce(F.size("metadata.required_memory_nodes"), F.lit(0)) / 10.0).alias("cc"),
        F.size(chain).alias("nodes"), F.size(F.filter(chain, lambda x: x.session_id.isNotNull())).alias("mentioned"), F.size(F.filter(chain, lambda x: x.role == "intermediate")).alias("causal"),
    ).distinct()
    return A.chain_rates(q, "query_type")


BUILDS = "builds AS (SELECT session_id, persona_id, CASE WHEN is_noise THEN 'noise' ELSE 'dialogue' END AS method, coalesce(turn_count, 0) * 0.5::DOUBLE AS time_cost, coalesce(turn_count, 0) AS passages, coalesce(kp_count, 0) AS entries FROM sess WHERE persona_id IS NOT NULL)"


def builds(spark, d):
    n = lambda c: F.coalesce(c, F.lit(0))
    s = sessions(spark, d).where("persona_id is not null")
    return s.select("session_id", "persona_id", F.when(F.col("is_noise"), "noise").otherwise("dialogue").alias("method"), (n("turn_count") * 0.5).alias("time_cost"), n("turn_count").alias("passages"), n("kp_count").alias("entries"))


@query(
    "A7_memory_builds",
    f"""
    SELECT * FROM (WITH {BUILDS} SELECT CASE WHEN grouping(method) = 1 THEN 'all' ELSE method END AS method, count(DISTINCT persona_id) AS units, count(*) AS count, round(sum(time_cost), 6) AS time_cost,
        round(sum(time_cost) / count(*), 6) AS avg_time_per_session, CAST(sum(passages) AS BIGINT) AS passages, CAST(sum(entries) AS BIGINT) AS entries FROM builds GROUP BY ROLLUP (method))
    """,
    uses="sess",
)
def _(spark, d):
    return A.build_summary(builds(spark, d), "persona_id")


@query(
    "A8_builds_per_unit",
    f"SELECT count(*) AS units, round(avg(t), 6) AS avg_time_per_unit, round(avg(n), 6) AS avg_chunks_per_unit FROM (WITH {BUILDS} SELECT persona_id, sum(time_cost) AS t, sum(passages) AS n FROM builds GROUP BY 1)",
    uses="sess",
)
def _(spark, d):
    b = builds(spark, d).groupBy("persona_id").agg(F.sum("time_cost").alias("t"), F.sum("passages").alias("n"))
    return b.agg(F.count("*").alias("units"), F.round(F.avg("t"), 6).alias("avg_time_per_unit"), F.round(F.avg("n"), 6).alias("avg_chunks_per_unit"))


@query(
    "A16_by_distance",
    """
    SELECT 'distance' AS kind, CAST(ceil((total - upto) / 1000) AS BIGINT) AS bucket, count(*) AS n, round(avg(is_correct::INT), 6) AS accuracy FROM ev JOIN off USING (session_id) GROUP BY 1, 2
    UNION ALL SELECT 'span', CAST(span AS BIGINT), count(*), round(avg(is_correct::INT), 6) FROM (SELECT query_id, is_correct, count(DISTINCT session_id) AS span FROM ev WHERE query_type = 'multi_hop_clinical_deduction' GROUP BY 1, 2) GROUP BY 1, 2
    """.replace(
        "SELECT 'distance'",
        """, ev AS (SELECT DISTINCT r.query_id, r.query_type, r.is_correct, q.session_id FROM results r JOIN (SELECT query_id, unnest(source_key_points).session_id AS session_id FROM queries) q USING (query_id) WHERE q.session_id IS NOT NULL),
        off AS (SELECT session_id, sum(len) OVER w AS upto, sum(len) OVER (PARTITION BY persona_id) AS total FROM (
            SELECT s.persona_id, s.session_id, s.original_index, coalesce(t.len, 0) AS len FROM (SELECT DISTINCT persona_id, session_id, original_index FROM sess WHERE persona_id IS NOT NULL) s LEFT JOIN (SELECT session_id, sum(length(content)) AS len FROM turns GROUP BY 1) t USING (session_id))
            WINDOW w AS (PARTITION BY persona_id ORDER BY original_index, session_id ROWS UNBOUNDED PRECEDING)) SELECT 'distance'""", 1,
    ),
    uses="results turns sess",
)
def _(spark, d):
    q = table(spark, d, "queries").select("query_id", F.explode("source_key_points.session_id").alias("session_id")).where("session_id is not null").distinct()
    ev = results(spark, d).select("query_id", "query_type", "is_correct").join(q, "query_id").distinct()
    size = turns(spark, d).groupBy("session_id").agg(F.sum(F.length("content")).alias("len"))
    s = sessions(spark, d).where("persona_id is not null").select("persona_id", "session_id", "original_index").distinct().join(size, "session_id", "left").withColumn("len", F.coalesce("len", F.lit(0)))
    w = Window.partitionBy("persona_id").orderBy(F.col("original_index").asc_nulls_last(), "session_id").rowsBetween(Window.unboundedPreceding, 0)
    total = s.groupBy("persona_id").agg(F.sum("len").alias("total"))
    off = s.withColumn("upto", F.sum("len").over(w)).join(total, "persona_id").select("session_id", (F.col("total") - F.col("upto")).alias("distance"))
    right = F.round(F.avg(F.col("is_correct").cast("int")), 6).alias("accuracy")
    far = ev.join(off, "session_id").groupBy(F.ceil(F.col("distance") / 1000).alias("bucket")).agg(F.count("*").alias("n"), right).withColumn("kind", F.lit("distance"))
    span = ev.where("query_type = 'multi_hop_clinical_deduction'").groupBy("query_id", "is_correct").agg(F.countDistinct("session_id").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"), right).withColumn("kind", F.lit("span"))
    return far.unionByName(span)


@query("A17_metric_stats", f"SELECT coalesce(event_type, 'overall') AS event_type, {STATS.format(v='value')} FROM events GROUP BY ROLLUP (event_type)")
def _(spark, d):
    return A.with_total(lambda df, *by: A.statistics(df, "value", *by), table(spark, d, "events"), "event_type")


@query("A18_latency", "SELECT coalesce(event_type, 'overall') AS event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY ROLLUP (event_type)")
def _(spark, d):
    return A.with_total(lambda df, *by: A.latency(df, "value", *by), table(spark, d, "events"), "event_type")


@query(
    "A25_error_types",
    r"""
    SELECT kind, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM (
        SELECT CASE WHEN v AND NOT a AND h THEN 'Preference-Unaware Violation' WHEN v AND a AND x AND h THEN 'Preference Hallucination Violation' WHEN v AND a AND NOT x AND h THEN 'Inconsistency Violation'
            WHEN NOT v AND NOT h THEN 'Unhelpful Response' ELSE 'Personalized Response' END AS kind
        FROM (SELECT NOT is_correct AS v, retrieved_count > 1 AS a, length(coalesce(model_output, '')) % 2 = 0 AS x, regexp_matches(coalesce(model_output, ''), '[^\s\p{Z}]') AS h FROM results)) GROUP BY 1
    """,
    uses="results",
)
def _(spark, d):
    o = F.coalesce("model_output", F.lit(""))
    kind = E.preference_error(~F.col("is_correct"), F.col("retrieved_count") > 1, F.length(o) % 2 == 0, T.has_text(o))
    g = results(spark, d).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))
    return g.select("kind", "n", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("percent"))  # five rows


@query("A26_recording_counts", "SELECT user_id, event_type, count(DISTINCT date_trunc('day', ts)) AS recordings, max(ts) AS last_seen FROM events GROUP BY 1, 2")
def _(spark, d):
    return A.recordings(table(spark, d, "events"), ["user_id", "event_type"], "ts", "day")
