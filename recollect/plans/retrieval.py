"""Retrieval, ranking, chunking and packing (R, T, C, Q1-Q9, Q15-Q20, J6, J8, J14, W12, W13)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from recollect.functions import text as T
from recollect.functions import vectors as V
from recollect.operators import chunking as C
from recollect.operators import retrieval as R
from recollect.operators.curation import drawn
from recollect.plans.registry import key_points, query, results, sessions, vectors
from recollect.runtime import spread, table

TOK = r"regexp_extract_all(lower({x}), '[a-z0-9]+|[\x{{4e00}}-\x{{9fff}}]')"
ASKED = "asked AS (SELECT DISTINCT CAST(query_id[2:] AS BIGINT) AS query_id, question AS text FROM queries WHERE question IS NOT NULL AND CAST(query_id[2:] AS BIGINT) % 50 = 0)"
ALL_ASKED = "asked AS (SELECT DISTINCT CAST(query_id[2:] AS BIGINT) AS query_id, question AS text FROM queries WHERE question IS NOT NULL)"


def bm25_sql(docs: str, queries: str, unique: bool = False) -> str:
    q = TOK.format(x="text")
    return f"""
    tok AS (SELECT doc_id, len(t) AS dl, t FROM (SELECT doc_id, {TOK.format(x="coalesce(text, '')")} AS t FROM {docs})),
    st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM tok),
    post AS (SELECT term, doc_id, dl, count(*) AS tf FROM (SELECT doc_id, dl, unnest(t) AS term FROM tok) GROUP BY ALL),
    idf AS (SELECT term, ln((n - df + 0.5) / (df + 0.5)) AS raw FROM (SELECT term, count(*) AS df FROM post GROUP BY 1), st),
    mi AS (SELECT avg(raw) AS m FROM idf),
    qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({'list_distinct(' + q + ')' if unique else q}) AS term FROM {queries}) GROUP BY ALL),
    sc AS (SELECT query_id, doc_id, round(sum(qtf * CASE WHEN raw < 0 THEN 0.25 * m ELSE raw END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM post JOIN qt USING (term) JOIN idf USING (term), st, mi GROUP BY ALL),
    rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc)"""


def all_asked(spark, d):
    q = table(spark, d, "queries").where("question is not null").select(F.expr("cast(substring(query_id, 2) as bigint)").alias("query_id"), F.col("question").alias("text"))
    return q.distinct()


def asked(spark, d):
    """The query set of the searches that are held to a fiftieth of the queries by their SQL."""
    return all_asked(spark, d).where("query_id % 50 = 0")


def docs(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text"))


def _bm25(spark, d, k=5, queries=asked, **kw):
    return R.bm25(queries(spark, d), R.index_of(spark, d, "documents", lambda: docs(spark, d), T.mixed_tokens), T.mixed_tokens, k, **kw)


@query("R1_bm25", f"WITH {ALL_ASKED}, {bm25_sql('documents', 'asked')} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM rk WHERE rank <= 5 AND score > 0")
def _(spark, d):
    return _bm25(spark, d, queries=all_asked).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query("T1_bm25_topk", f"WITH {ALL_ASKED}, {bm25_sql('documents', 'asked')} SELECT query_id, count(*) AS hits, round(max(score), 6) AS best FROM rk WHERE rank <= 20 AND score > 0 GROUP BY 1")
def _(spark, d):
    return _bm25(spark, d, 20, all_asked).groupBy("query_id").agg(F.count("*").alias("hits"), F.round(F.max("score"), 6).alias("best"))


@query("R7_key_and_category", f"WITH {ASKED}, kd AS (SELECT DISTINCT kp_id AS doc_id, coalesce(name, '') || ' ' || coalesce(category, '') AS text FROM key_points), {bm25_sql('kd', 'asked')} SELECT query_id, doc_id, round(score, 6) AS score FROM rk WHERE rank <= 5 AND score > 0")
def _(spark, d):
    kd = table(spark, d, "key_points").select(F.col("kp_id").alias("doc_id"), F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("category", F.lit(""))).alias("text")).distinct()
    return R.bm25(asked(spark, d), kd, T.mixed_tokens, 5).select("query_id", "doc_id", F.round("score", 6).alias("score"))


NEAR = """near AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, round(list_dot_product(q.v, c.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(c.v, c.v))), 9) AS score FROM vecs q, vecs c WHERE q.vec_id % 50 = 0),
    nr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM near)"""


def near(spark, d, k, **kw):
    v = vectors(spark, d)
    return R.dense(v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "v"), v.select("vec_id", "v"), k, **kw)


@query("R2_dense_topk", f"SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (WITH {NEAR} SELECT * FROM nr) WHERE rank <= 5", uses="vecs")
def _(spark, d):
    return near(spark, d, 5).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query("T2_dense_l2", "SELECT query_id, vec_id FROM (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_distance(q.v, c.v), 6), c.vec_id) AS n FROM vecs q, vecs c WHERE q.vec_id % 50 = 0) WHERE n <= 3", uses="vecs")
def _(spark, d):
    n = near(spark, d, 8, metric="l2").withColumn("score", F.round("score", 6))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return n.withColumn("n", F.row_number().over(w)).where("n <= 3").select("query_id", "vec_id")


@query("T3_position_ties", "SELECT label, vec_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY round(v[1], 1) DESC, vec_id DESC) AS n FROM vecs) WHERE n <= 3", uses="vecs")
def _(spark, d):
    w = Window.partitionBy("label").orderBy(F.round(F.get("v", 0), 1).desc(), F.desc("vec_id"))
    return vectors(spark, d).withColumn("n", F.row_number().over(w)).where("n <= 3").select("label", "vec_id")


@query("T4_distance_order", "SELECT vec_id FROM (SELECT c.vec_id, c.label, list_cosine_similarity(q.v, c.v) AS s FROM vecs q, vecs c WHERE q.vec_id = 0) ORDER BY round(1 - s, 6), label, vec_id LIMIT 10", uses="vecs")
def _(spark, d):
    v = vectors(spark, d)
    one = R.lookup_vectors(v, F.col("vec_id") == 0)[0]
    return v.orderBy(F.round(1 - V.cosine(F.col("v"), one), 6), "label", "vec_id").limit(10).select("vec_id")


@query("J6_threshold_join", f"SELECT query_id, vec_id FROM (WITH {NEAR} SELECT * FROM near) WHERE score >= 0.3", uses="vecs")
def _(spark, d):
    return near(spark, d, None, threshold=0.3).select("query_id", "vec_id")


@query("Q9_nearest_other", f"SELECT query_id, arg_min(vec_id, (-score, vec_id)) AS vec_id, round(max(score), 6) AS score FROM (WITH {NEAR} SELECT * FROM nr WHERE vec_id <> query_id) GROUP BY 1", uses="vecs")
def _(spark, d):
    n = near(spark, d, 2).where("vec_id <> query_id")
    return n.groupBy("query_id").agg(F.min_by("vec_id", F.struct(-F.col("score"), F.col("vec_id"))).alias("vec_id"), F.round(F.max("score"), 6).alias("score"))


@query("Q8_recent_vectors", "WITH r AS (SELECT * FROM vecs ORDER BY vec_id DESC LIMIT 100) SELECT vec_id FROM (SELECT c.vec_id, round(list_cosine_similarity(q.v, c.v), 6) AS s FROM (SELECT v FROM vecs WHERE vec_id = 0) q, r c) ORDER BY s DESC, vec_id LIMIT 5".replace("WITH r AS", ", r AS", 1), uses="vecs")
def _(spark, d):
    v = vectors(spark, d)
    one = R.lookup_vectors(v, F.col("vec_id") == 0)[0]
    return v.orderBy(F.desc("vec_id")).limit(100).orderBy(F.round(V.cosine(F.col("v"), one), 6).desc(), "vec_id").limit(5).select("vec_id")


@query("R6_multi_query_recall", f"SELECT vec_id, round(max(score), 6) AS score FROM (WITH {NEAR} SELECT * FROM nr WHERE rank <= 4) GROUP BY 1", uses="vecs")
def _(spark, d):
    return near(spark, d, 4).groupBy("vec_id").agg(F.round(F.max("score"), 6).alias("score"))


@query("R10_level_rerank", f"SELECT query_id, vec_id, round(weighted, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY weighted DESC, vec_id) AS n FROM (SELECT x.query_id, x.vec_id, round(x.score * CASE v.label % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.9 ELSE 0.8 END, 9) AS weighted FROM (WITH {NEAR} SELECT * FROM nr WHERE rank <= 20) x JOIN vecs v USING (vec_id))) WHERE n <= 5", uses="vecs")
def _(spark, d):
    factor = F.when(F.col("label") % 3 == 0, 1.0).when(F.col("label") % 3 == 1, 0.9).otherwise(0.8)
    n = near(spark, d, 20).join(vectors(spark, d).select("vec_id", "label"), "vec_id").withColumn("w", F.round(F.col("score") * factor, 9))
    return n.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("w"), "vec_id"))).where("n <= 5").select("query_id", "vec_id", F.round("w", 6).alias("score"))


@query("R16_key_dedup", f"SELECT query_id, CASE WHEN s >= 0.5 THEN 'append' ELSE 'new' END AS action FROM (SELECT query_id, max(score) AS s FROM (WITH {NEAR} SELECT * FROM near WHERE vec_id < query_id) GROUP BY 1)", uses="vecs")
def _(spark, d):
    # only pairs over the threshold leave a task; a key without one is new, the first of all keys is compared with none
    v = vectors(spark, d)
    known = near(spark, d, None, threshold=0.5).where("vec_id < query_id").select("query_id").distinct().withColumn("action", F.lit("append"))
    first = v.agg(F.min("vec_id").alias("first"))  # one row
    keys = v.where("vec_id % 50 = 0").join(F.broadcast(first)).where("vec_id > first").select(F.col("vec_id").alias("query_id")).distinct()
    return keys.join(known, "query_id", "left").select("query_id", F.coalesce("action", F.lit("new")).alias("action"))


@query("R16_key_dedup_all", "SELECT b.vec_id AS query_id, CASE WHEN max(round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 9)) >= 0.5 THEN 'append' ELSE 'new' END AS action FROM vecs b LEFT JOIN vecs a ON a.vec_id < b.vec_id GROUP BY 1", uses="vecs")
def _(spark, d):
    v = vectors(spark, d)
    known = R.similar_pairs(v, 0.5).select(F.col("dst").alias("query_id")).distinct().withColumn("action", F.lit("append"))
    return v.select(F.col("vec_id").alias("query_id")).distinct().join(known, "query_id", "left").select("query_id", F.coalesce("action", F.lit("new")).alias("action"))


@query("W13_minmax", "SELECT event_id, round((value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w + 0.000001), 6) AS scaled FROM events WINDOW w AS (PARTITION BY event_type)")
def _(spark, d):
    return R.scaled(table(spark, d, "events"), "event_type", "value", "s").select("event_id", F.round("s", 6).alias("scaled"))


@query("W12_zscore", "SELECT event_id, round(CASE WHEN sd <= 1e-9 THEN 1.0 ELSE greatest(least((value - m) / sd, 3), -3) END, 6) AS z FROM (SELECT event_id, value, avg(value) OVER w AS m, stddev_pop(value) OVER w AS sd FROM events WINDOW w AS (PARTITION BY user_id))")
def _(spark, d):
    w = Window.partitionBy("user_id")
    e = table(spark, d, "events").withColumn("m", F.avg("value").over(w)).withColumn("sd", F.stddev_pop("value").over(w))
    z = F.greatest(F.least((F.col("value") - F.col("m")) / F.col("sd"), F.lit(3)), F.lit(-3))
    return e.select("event_id", F.round(F.when(F.col("sd") <= 1e-9, 1.0).otherwise(z), 6).alias("z"))


@query("Q2_recency", "SELECT event_id, round(value * (0.3 + 0.7 * pow(0.5, greatest(date_diff('second', ts, TIMESTAMP '2024-02-01') / 86400.0, 0) / 14)), 6) AS score FROM events")
def _(spark, d):
    age = (F.unix_timestamp(F.lit("2024-02-01").cast("timestamp_ntz").cast("timestamp")) - F.unix_timestamp(F.date_trunc("second", F.col("ts").cast("timestamp")))) / 86400.0
    return table(spark, d, "events").select("event_id", F.round(R.recency(F.col("value"), age), 6).alias("score"))


@query("Q3_mmr_rerank")
def _(spark, d):
    n = near(spark, d, 20).select("query_id", F.col("vec_id").alias("doc_id"), "score", "rank")
    return R.ranked_per_query(n, R.choose_mmr(10), vectors(spark, d), 20)


@query("R12_similarity_dedup")
def _(spark, d):
    n = near(spark, d, 30).select("query_id", F.col("vec_id").alias("doc_id"), "score", "rank")
    return R.ranked_per_query(n, R.choose_dissimilar(0.92), vectors(spark, d), 30)


@query("R13_mmr_dedup")
def _(spark, d):
    n = near(spark, d, 30).select("query_id", F.col("vec_id").alias("doc_id"), "score", "rank")
    return R.ranked_per_query(n, R.choose_mmr(10, 0.8, prefill=2, steep=10.0), vectors(spark, d), 30)


@query("Q5_pattern_terms", r"SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest(list_distinct(list_concat(list_filter(regexp_split_to_array(regexp_replace(text, '[^\p{L}\p{N}]', ' ', 'g'), '\s+'), lambda t: length(t) = 2), list_filter(list_transform(range(1, length(text)), lambda i: substr(text, i, 2)), lambda t: regexp_full_match(t, '[\x{4e00}-\x{9fff}]{2}'))))) AS term FROM asked)".replace("SELECT DISTINCT query_id, term", f"WITH {ASKED} SELECT DISTINCT query_id, term", 1))
def _(spark, d):
    two = F.filter(F.split(F.regexp_replace("text", r"[^\p{L}\p{N}]", " "), r"\s+"), lambda t: F.length(t) == 2)
    pairs = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.length("text") - 1, F.lit(1))), lambda i: F.substring(F.col("text"), i, F.lit(2))), lambda t: t.rlike(r"^[\x{4e00}-\x{9fff}]{2}$"))
    return asked(spark, d).select("query_id", F.explode(F.array_distinct(F.concat(two, pairs))).alias("term")).distinct()


@query("Q6_pattern_search", "SELECT kp_id FROM kps WHERE content IS NOT NULL AND (contains(content, '血') OR contains(content, 'fish')) ORDER BY session_id DESC NULLS LAST, kp_id LIMIT 20", uses="kps")
def _(spark, d):
    hit = F.exists(F.array(F.lit("血"), F.lit("fish")), lambda p: F.contains(F.col("content"), p))
    return key_points(spark, d).where(hit).orderBy(F.col("session_id").desc_nulls_last(), "kp_id").limit(20).select("kp_id")


@query("Q15_word_overlap", f"WITH {ASKED} SELECT query_id, doc_id, CAST(n AS BIGINT) AS shared FROM (SELECT query_id, doc_id, n, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, doc_id) AS r FROM (SELECT q.query_id, k.doc_id, count(*) AS n FROM (SELECT query_id, unnest(list_distinct({TOK.format(x='text')})) AS t FROM asked) q JOIN (SELECT DISTINCT name AS doc_id, unnest(list_distinct({TOK.format(x='name')})) AS t FROM key_points) k USING (t) GROUP BY ALL)) WHERE r <= 3")
def _(spark, d):
    words = lambda c: F.explode(F.array_distinct(T.mixed_tokens(F.col(c)))).alias("t")
    k = table(spark, d, "key_points").select("name").distinct().select(F.col("name").alias("doc_id"), words("name"))
    s = asked(spark, d).select("query_id", words("text")).join(k, "t").groupBy("query_id", "doc_id").agg(F.count("*").alias("shared"))
    return s.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("shared"), "doc_id"))).where("r <= 3").select("query_id", "doc_id", "shared")


@query("Q16_preference_search", f"SELECT query_id, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM (WITH {NEAR} SELECT near.*, v.label FROM near JOIN vecs v USING (vec_id) WHERE v.label = 1)) WHERE n <= 3", uses="vecs")
def _(spark, d):
    v = vectors(spark, d)
    return R.dense(v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "v"), v.where("label = 1").select("vec_id", "v"), 3).select("query_id", "vec_id")


@query("Q19_collection_search", f"SELECT query_id, count(*) AS n, round(avg(score), 6) AS mean FROM (WITH {NEAR} SELECT * FROM nr WHERE rank <= 10) GROUP BY 1", uses="vecs")
def _(spark, d):
    return near(spark, d, 10).groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"))


@query("R32_evidence_dot", "SELECT query_id, vec_id FROM (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.v, c.v), 9) DESC, c.vec_id) AS n FROM vecs q, vecs c WHERE q.vec_id % 50 = 0) WHERE n <= 3", uses="vecs")
def _(spark, d):
    return near(spark, d, 3, metric="dot").select("query_id", "vec_id")


@query("R15_value_aware", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY z DESC, event_id) AS n FROM (SELECT user_id, event_id, round(CASE WHEN sd <= 1e-9 THEN 1 ELSE greatest(least((value - m) / sd, 3), -3) END, 6) AS z FROM (SELECT *, avg(value) OVER w AS m, stddev_pop(value) OVER w AS sd FROM events WINDOW w AS (PARTITION BY user_id)))) WHERE n <= 3")
def _(spark, d):
    w = Window.partitionBy("user_id")
    e = table(spark, d, "events").withColumn("m", F.avg("value").over(w)).withColumn("sd", F.stddev_pop("value").over(w))
    e = e.withColumn("z", F.round(F.when(F.col("sd") <= 1e-9, 1.0).otherwise(F.greatest(F.least((F.col("value") - F.col("m")) / F.col("sd"), F.lit(3)), F.lit(-3))), 6))
    return e.withColumn("n", F.row_number().over(w.orderBy(F.desc("z"), "event_id"))).where("n <= 3").select("user_id", "event_id")


@query("R11_boosted_rerank", f"SELECT query_id, vec_id, round(score * CASE WHEN v.label = q.label THEN 1.2 ELSE 1.0 END, 6) AS score FROM (WITH {NEAR} SELECT * FROM nr WHERE rank <= 5) n JOIN vecs v USING (vec_id) JOIN (SELECT vec_id AS query_id, label FROM vecs) q USING (query_id)", uses="vecs")
def _(spark, d):
    v = vectors(spark, d)
    n = near(spark, d, 5).join(v.select("vec_id", F.col("label").alias("lv")), "vec_id").join(v.select(F.col("vec_id").alias("query_id"), F.col("label").alias("lq")), "query_id")
    return n.select("query_id", "vec_id", F.round(F.col("score") * F.when(F.col("lv") == F.col("lq"), 1.2).otherwise(1.0), 6).alias("score"))


@query("T8_trim_per_type", "SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS n FROM events) WHERE n <= CASE event_type WHEN 'click' THEN 6 WHEN 'view' THEN 3 ELSE 5 END")
def _(spark, d):
    w = Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id")
    most = F.when(F.col("event_type") == "click", 6).when(F.col("event_type") == "view", 3).otherwise(5)
    return table(spark, d, "events").withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).select("event_type", "event_id")


DRAWN = "('0x' || md5({x} || ':42')[1:8])::BIGINT"


@query("T13_epsilon_greedy", f"SELECT user_id, event_id, explored FROM (SELECT user_id, event_id, explored, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN explored THEN {DRAWN.format(x='event_id')}::DOUBLE ELSE -value END, event_id) AS n FROM (SELECT *, {DRAWN.format(x='user_id')} % 100 < 10 AS explored FROM events)) WHERE n <= 3")
def _(spark, d):
    e = table(spark, d, "events")
    explore = drawn(F.col("user_id"), "42") % 100 < 10
    w = Window.partitionBy("user_id").orderBy(F.when(explore, drawn(F.col("event_id"), "42").cast("double")).otherwise(-F.col("value")), "event_id")
    return e.withColumn("n", F.row_number().over(w)).where("n <= 3").select("user_id", "event_id", explore.alias("explored"))


@query("T14_unique_task", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS n FROM events) WHERE n = 1) WHERE r <= 3")
def _(spark, d):
    order = [F.desc("value"), F.col("event_id")]
    e = table(spark, d, "events").withColumn("n", F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy(*order))).where("n = 1")
    return e.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(*order))).where("r <= 3").select("user_id", "event_type", "event_id")


@query("T15_two_level_limit", "SELECT event_id FROM (SELECT *, row_number() OVER (ORDER BY value DESC, event_id) AS r FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS n FROM events) WHERE n <= 4) WHERE r <= 10")
def _(spark, d):
    e = table(spark, d, "events").withColumn("n", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id"))).where("n <= 4")
    return e.orderBy(F.desc("value"), "event_id").limit(10).select("event_id")


@query("T17_best_response", "SELECT user_id, arg_min(event_id, ((event_type <> 'purchase')::INT, -value, event_id)) AS event_id FROM events GROUP BY 1")
def _(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.min_by("event_id", F.struct((F.col("event_type") != "purchase").cast("int"), -F.col("value"), "event_id")).alias("event_id"))


@query("T18_random_sample", f"SELECT event_id FROM events ORDER BY {DRAWN.format(x='event_id')}, event_id LIMIT 50")
def _(spark, d):
    return table(spark, d, "events").orderBy(drawn(F.col("event_id"), "42"), "event_id").limit(50).select("event_id")


WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\s\\p{Z}\\x{0b}\\x{85}]+'), lambda w: w <> '')"


def window_sql(size: int, overlap: int) -> str:
    step = size - overlap
    return f"SELECT doc_id, chunk, array_to_string(t[chunk * {step} + 1 : chunk * {step} + {size}], ' ') AS text, CAST(len(t[chunk * {step} + 1 : chunk * {step} + {size}]) AS BIGINT) AS tokens FROM (SELECT doc_id, t, unnest(range(CASE WHEN len(t) = 0 THEN 0 WHEN len(t) <= {size} THEN 1 ELSE 1 + CAST(ceil((len(t) - {size}) / {step}.0) AS BIGINT) END)) AS chunk FROM (SELECT doc_id, {WORDS} AS t FROM documents))"


@query("C1_token_windows", window_sql(64, 8))
def _(spark, d):
    return C.chunked(docs(spark, d), 64, 8)


@query("C2_token_steps", window_sql(40, 20))
def _(spark, d):
    return C.chunked(docs(spark, d), 40, 20)


@query("C3_plain_windows", window_sql(50, 0))
def _(spark, d):
    return C.chunked(docs(spark, d), 50, 0)


@query("C6_paragraphs", "SELECT doc_id, CAST(i - 1 AS INT) AS chunk, p[i] AS text FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: regexp_replace(x, '^[\\s\\p{Z}\\x{0b}\\x{85}]+|[\\s\\p{Z}\\x{0b}\\x{85}]+$', '', 'g')), lambda x: x <> '') AS p FROM documents WHERE text IS NOT NULL))")
def _(spark, d):
    return C.paragraphs(docs(spark, d))


for name, splitter in {
    "C4_paragraph_packing": C.paragraph_packer(800), "C5_sentence_packing": C.sentence_packer(400), "C7_recursive": C.recursive_splitter(512, 64), "C8_separators": C.recursive_splitter(300, 0, ("\n", "。", ". ", " ", "")),
    "C9_headers": C.header_splitter, "C10_lossless": C.lossless(60), "Q14_semantic_chunks": C.semantic_splitter(400),
}.items():
    query(name)(lambda spark, d, s=splitter: C.split_by(docs(spark, d), s))


@query("C9_characters", "SELECT doc_id, CAST(k AS INT) AS chunk, text[k * 180 + 1 : k * 180 + 200] AS text FROM (SELECT doc_id, text, unnest(range(CASE WHEN length(text) <= 200 THEN 1 ELSE CAST(ceil((length(text) - 200) / 180.0) AS BIGINT) + 1 END)) AS k FROM documents WHERE length(text) > 0)")
def _(spark, d):
    return C.characters(docs(spark, d), 200, 20)


@query("C11_context_packing", f"WITH {ALL_ASKED}, {bm25_sql('documents', 'asked')}, h AS (SELECT query_id, doc_id, rank, length(text) // 4 AS tk FROM rk JOIN documents USING (doc_id) WHERE rank <= 10 AND score > 0), b AS (SELECT *, coalesce(sum(tk + 10) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM h), u AS (SELECT *, CASE WHEN before + tk + 10 <= 1000 THEN tk WHEN 1000 - before - 10 > 100 THEN 1000 - before - 10 ELSE 0 END AS used FROM b) SELECT query_id, doc_id, rank, CAST(used AS BIGINT) AS used FROM u WHERE used > 0")
def _(spark, d):
    size = table(spark, d, "documents").select("doc_id", F.floor(F.length("text") / 4).alias("tokens"))  # before the join, which then carries no text
    h = _bm25(spark, d, 10, all_asked).join(size, "doc_id").select("query_id", "doc_id", "rank", "tokens")
    return R.packed_context(h, 1000, 10).select("query_id", "doc_id", "rank", F.col("used").cast("long").alias("used"))


@query("C12_keep_latest_tokens", "SELECT persona_id, session_id FROM (SELECT persona_id, session_id, sum(coalesce(turn_count, 0)) OVER (PARTITION BY persona_id ORDER BY session_id DESC ROWS UNBOUNDED PRECEDING) AS upto FROM sess WHERE persona_id IS NOT NULL) WHERE upto <= 40", uses="sess")
def _(spark, d):
    s = sessions(spark, d).where("persona_id is not null").select("persona_id", "session_id", F.coalesce("turn_count", F.lit(0)).alias("n"))
    return R.kept_suffix(s, "persona_id", "session_id", "n", 40).select("persona_id", "session_id")


@query("C14_backward_fill", "SELECT user_id, count(*) AS kept FROM (SELECT user_id, sum(value) OVER (PARTITION BY user_id ORDER BY event_id DESC ROWS UNBOUNDED PRECEDING) AS upto FROM events) WHERE upto <= 500 GROUP BY 1")
def _(spark, d):
    return R.kept_suffix(table(spark, d, "events"), "user_id", "event_id", "value", 500).groupBy("user_id").agg(F.count("*").alias("kept"))


@query("J8_shared_tokens", "SELECT r.query_id, r.question, len(list_intersect(string_split(coalesce(model_output, ''), ' '), string_split(coalesce(question, ''), ' '))) AS shared FROM results r", uses="results")
def _(spark, d):
    part = lambda c: F.split(F.coalesce(c, F.lit("")), " ")
    return results(spark, d).select("query_id", "question", F.size(F.array_intersect(part("model_output"), part("question"))).cast("long").alias("shared"))


@query("J17_order_restored", f"SELECT n.query_id, n.rank, v.label FROM (WITH {NEAR} SELECT * FROM nr WHERE rank <= 3) n JOIN vecs v USING (vec_id)", uses="vecs")
def _(spark, d):
    return near(spark, d, 3).join(vectors(spark, d).select("vec_id", "label"), "vec_id").select("query_id", "rank", "label").orderBy("query_id", "rank")
