"""Searches composed of several retrievers, filters of duplicates and pages."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from recollect.functions import text as T
from recollect.functions import vectors as V
from recollect.operators import retrieval as R
from recollect.operators.scoring import present
from recollect.plans.graphs import E, graph, wrap
from recollect.plans.registry import key_points, nodes, query, vectors
from recollect.plans.retrieval import ALL_ASKED, ASKED, TOK, all_asked, asked, bm25_sql, docs
from recollect.runtime import materialize, spread, table


def index(spark, d) -> R.Index:
    return R.index_of(spark, d, "documents", lambda: docs(spark, d), T.mixed_tokens)


def letters_sql(x: str) -> str:
    return "[" + ", ".join(f"(length(lower({x})) - length(replace(lower({x}), '{c}', '')))::DOUBLE" for c in V.LETTERS) + "]"


DENSE = f"""dv AS (SELECT doc_id, {letters_sql('text')} AS v FROM documents WHERE text IS NOT NULL), qv AS (SELECT query_id, {letters_sql('text')} AS v FROM asked),
    ds AS (SELECT query_id, doc_id, round(list_cosine_similarity(qv.v, dv.v), 9) AS score FROM qv, dv WHERE list_sum(qv.v) > 0 AND list_sum(dv.v) > 0),
    dr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ds)"""


def dense_docs(spark, d, k):
    """The documents nearest to each query; both sides' vectors come from their texts. Those of the documents are written once."""
    q = asked(spark, d).select("query_id", V.letters(F.col("text")).alias("v"))
    c = docs(spark, d).where("text is not null").select(F.col("doc_id").alias("vec_id"), V.letters(F.col("text")).alias("v"))
    return R.dense(q, materialize(c, "vectors"), k).withColumnRenamed("vec_id", "doc_id")


@query("R3_hybrid", f"""
    WITH {ASKED}, {bm25_sql('documents', 'asked')}, {DENSE}, l AS (SELECT query_id, doc_id, (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w + 1e-6) AS lex FROM (SELECT * FROM rk WHERE rank <= 50 AND score > 0) WINDOW w AS (PARTITION BY query_id)),
    h AS (SELECT query_id, doc_id, round(0.5 * coalesce(lex, 0) + 0.5 * coalesce(s.score, 0), 9) AS score FROM l FULL JOIN (SELECT * FROM dr WHERE rank <= 50) s USING (query_id, doc_id))
    SELECT query_id, doc_id, round(score, 5) AS score, n AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS n FROM h) WHERE n <= 5
    """)
def _(spark, d):
    lex = R.bm25(asked(spark, d), index(spark, d), T.mixed_tokens, 50).select("query_id", "doc_id", "score")
    return R.hybrid(lex, dense_docs(spark, d, 50).select("query_id", "doc_id", "score"), 0.5, 5).select("query_id", "doc_id", F.round("score", 5).alias("score"), "rank")


@query("R4_unique_terms", f"""
    WITH {ASKED}, {bm25_sql('documents', 'asked', True)}, c AS (SELECT * FROM rk WHERE rank <= 10 AND score > 0), n AS (SELECT count(*) AS n FROM documents),
    di AS (SELECT term, ln((1 + n.n) / (1 + count(*))) + 1 AS idf FROM post, n GROUP BY term, n.n), dw AS (SELECT term, doc_id, tf * idf AS w FROM post JOIN di USING (term)), dn AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM dw GROUP BY 1),
    rq AS (SELECT query_id, term, count(*) * idf AS w FROM (SELECT query_id, unnest({TOK.format(x='text')}) AS term FROM asked) JOIN di USING (term) GROUP BY query_id, term, idf), qn AS (SELECT query_id, sqrt(sum(w * w)) AS norm FROM rq GROUP BY 1),
    cs AS (SELECT c.query_id, c.doc_id, sum(dw.w * rq.w / dn.norm / qn.norm) AS cos FROM c JOIN rq USING (query_id) JOIN dw ON dw.doc_id = c.doc_id AND dw.term = rq.term JOIN dn ON dn.doc_id = c.doc_id JOIN qn ON qn.query_id = c.query_id GROUP BY ALL),
    f AS (SELECT c.query_id, c.doc_id, round(0.7 * c.score + 0.3 * coalesce(cos, 0), 9) AS score FROM c LEFT JOIN cs USING (query_id, doc_id))
    SELECT query_id, doc_id, round(score, 6) AS score, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM f) WHERE r <= 5
    """)
def _(spark, d):
    ix, q = index(spark, d), asked(spark, d)
    hits = materialize(R.bm25(q, ix, T.mixed_tokens, 10, unique=True), "hits")
    return R.tfidf_rerank(q, hits, ix, 5).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


TWO = r"list_distinct(list_concat(list_filter(regexp_split_to_array(regexp_replace({x}, '[^\p{{L}}\p{{N}}]', ' ', 'g'), '\s+'), lambda t: length(t) = 2), list_filter(list_transform(range(1, length({x})), lambda i: substr({x}, i, 2)), lambda t: regexp_full_match(t, '[\x{{4e00}}-\x{{9fff}}]{{2}}'))))"
PATTERN = f"""pt AS (SELECT query_id, unnest({TWO.format(x='text')}) AS term FROM asked), pd AS (SELECT doc_id, ingested_at, unnest({TWO.format(x='text')}) AS term FROM documents WHERE text IS NOT NULL),
    pr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ingested_at DESC NULLS LAST, doc_id) AS rank FROM (SELECT DISTINCT query_id, doc_id, ingested_at FROM pt JOIN pd USING (term)))"""


def two_letters(c: str):
    """Words of two letters and pairs of Han characters."""
    two = F.filter(F.split(F.regexp_replace(c, r"[^\p{L}\p{N}]", " "), r"\s+"), lambda t: F.length(t) == 2)
    pairs = F.regexp_extract_all(F.col(c), F.lit(r"(?=([\x{4e00}-\x{9fff}]{2}))"), F.lit(1))  # pairs overlap
    return F.array_distinct(F.concat(two, pairs))


def pattern_docs(spark, d, k):
    """The newest documents that hold one of a query's two-letter patterns. In order of their age, the first ``k`` of a task are enough."""
    q = materialize(asked(spark, d).select("query_id", F.explode(two_letters("text")).alias("term")).distinct().withColumn("w", F.lit(1.0)), "patterns")
    t = spread(table(spark, d, "documents").where("text is not null").select("doc_id", "ingested_at", "text")).select("doc_id", "ingested_at", F.array(two_letters("text")).alias("parts"))
    order = [F.col("ingested_at").desc_nulls_last(), F.col("doc_id")]
    some = lambda ids, batch: lambda start, lo, s, low: np.minimum(s, 1.0, out=s)  # noqa: E731, ARG005
    found = R.best_by_terms(q, t, k, present("parts"), order, some).select("query_id", "doc_id")
    hit = found.join(table(spark, d, "documents").select("doc_id", "ingested_at"), "doc_id")
    return hit.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)


def fused_sql(k: int, *lists: str) -> str:
    return "SELECT query_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS s FROM (" + " UNION ALL ".join(f"SELECT query_id, doc_id, rank FROM {x} WHERE rank <= {k}" for x in lists) + ") GROUP BY ALL"


@query("Q1_rank_fusion", f"WITH {ASKED}, {bm25_sql('documents', 'asked')}, {DENSE}, bl AS (SELECT * FROM rk WHERE score > 0) SELECT query_id, doc_id, round(s, 6) AS score FROM ({fused_sql(10, 'bl', 'dr')})")
def _(spark, d):
    lists = [R.bm25(asked(spark, d), index(spark, d), T.mixed_tokens, 10), dense_docs(spark, d, 10)]
    return R.reciprocal_rank_fusion(lists).select("query_id", "doc_id", F.round("score", 6).alias("score"))


@query("Q4_hybrid_recall", f"""
    WITH {ASKED}, {bm25_sql('documents', 'asked')}, {DENSE}, {PATTERN}, bl AS (SELECT * FROM rk WHERE score > 0), f AS ({fused_sql(25, 'bl', 'dr', 'pr')}),
    a AS (SELECT f.query_id, f.doc_id, d.persona_id, s * (0.3 + 0.7 * pow(0.5, greatest(date_diff('second', d.ingested_at, m.newest) / 86400.0, 0) / 14)) AS s FROM f JOIN documents d USING (doc_id), (SELECT max(ingested_at) AS newest FROM documents) m),
    g AS (SELECT *, max(s) OVER (PARTITION BY query_id) AS top FROM a)
    SELECT query_id, doc_id, round(score, 3) AS score FROM (SELECT query_id, doc_id, round(s / top, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s / top, 6) DESC, doc_id) AS n FROM g WHERE s >= top * 0.45 * 0.3 AND persona_id IS NOT NULL) WHERE n <= 5
    """)
def _(spark, d):
    f = R.reciprocal_rank_fusion([R.bm25(asked(spark, d), index(spark, d), T.mixed_tokens, 25), dense_docs(spark, d, 25), pattern_docs(spark, d, 25)])
    t = table(spark, d, "documents")
    about = t.select("doc_id", "persona_id", "ingested_at")
    newest = t.agg(F.max("ingested_at").alias("newest"))  # one row
    second = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    a = f.join(about, "doc_id").join(F.broadcast(newest)).withColumn("s", R.recency(F.col("score"), (second("newest") - second("ingested_at")) / 86400.0))
    w = Window.partitionBy("query_id")  # at most 75 rows of a query
    g = a.withColumn("top", F.max("s").over(w)).where((F.col("s") >= F.col("top") * 0.45 * 0.3) & F.col("persona_id").isNotNull()).withColumn("score", F.round(F.col("s") / F.col("top"), 6))
    return g.withColumn("n", F.row_number().over(w.orderBy(F.desc("score"), "doc_id"))).where("n <= 5").select("query_id", "doc_id", F.round("score", 3).alias("score"))


NAMED = "named AS (SELECT DISTINCT CAST(query_id[2:] AS BIGINT) AS query_id, persona_id, lang, source_key_points AS s FROM queries WHERE CAST(query_id[2:] AS BIGINT) % 50 = 0 AND len(source_key_points) > 0)"


def named(spark, d):
    q = table(spark, d, "queries").select(F.expr("cast(substring(query_id, 2) as bigint)").alias("query_id"), "persona_id", "lang", F.col("source_key_points").alias("s"))
    return q.where("query_id % 50 = 0 and size(s) > 0").distinct()


@query("R5_key_tag_recall", f"""
    WITH {NAMED}, q AS (SELECT query_id, list_distinct(list_transform(s, lambda x: x.name)) AS keys, list_distinct(list_append(list_transform(s, lambda x: x.category), lang)) AS tags FROM named),
    k AS (SELECT DISTINCT kp_id, name, list_distinct([category, lang]) AS tags FROM key_points)
    SELECT query_id, count(*) AS recalled, count(*) FILTER (WHERE coalesce(list_contains(keys, name), false)) AS by_key FROM q JOIN k ON coalesce(list_contains(q.keys, k.name), false) OR len(list_intersect(list_filter(q.tags, lambda x: x IS NOT NULL), list_filter(k.tags, lambda x: x IS NOT NULL))) >= 2 GROUP BY 1
    """)
def _(spark, d):
    q = materialize(named(spark, d).select("query_id", F.array_distinct(F.transform("s", lambda x: x["name"])).alias("keys"), F.array_compact(F.array_distinct(F.array_append(F.transform("s", lambda x: x.category), F.col("lang")))).alias("tags")), "keys")
    k = table(spark, d, "key_points").select("kp_id", "name", F.array_compact(F.array_distinct(F.array("category", "lang"))).alias("tags")).distinct()
    by_key = q.select("query_id", F.explode("keys").alias("name")).distinct().join(k.where("name is not null").select("kp_id", "name"), "name").select("query_id", "kp_id", F.lit(1).alias("keyed"))
    # two shared tags: an equi-join on pairs of tags, in order
    pairs = lambda c: F.explode(F.flatten(F.transform(c, lambda a: F.transform(F.filter(c, lambda b: a < b), lambda b: F.concat_ws("\x01", a, b))))).alias("pair")
    by_tag = q.select("query_id", pairs(F.col("tags"))).join(k.select("kp_id", pairs(F.col("tags"))), "pair").select("query_id", "kp_id", F.lit(0).alias("keyed"))
    return by_key.union(by_tag).groupBy("query_id", "kp_id").agg(F.max("keyed").alias("keyed")).groupBy("query_id").agg(F.count("*").alias("recalled"), F.sum("keyed").alias("by_key"))


@query("R8_full_text", f"""
    WITH {ASKED}, q AS (SELECT query_id, unnest(list_distinct({TOK.format(x='text')})) AS t FROM asked), n AS (SELECT query_id, count(*) AS n FROM q GROUP BY 1), k AS (SELECT DISTINCT kp_id, unnest(list_distinct({TOK.format(x='content')})) AS t FROM kps)
    SELECT query_id, kp_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, kp_id) AS r FROM (SELECT query_id, kp_id, round(count(DISTINCT t) / n, 6) AS score FROM q JOIN k USING (t) JOIN n USING (query_id) GROUP BY query_id, kp_id, n)) WHERE r <= 10
    """.replace("WITH asked", ", asked", 1), uses="kps")
def _(spark, d):
    words = lambda c: F.array_distinct(T.mixed_tokens(F.col(c)))
    q = asked(spark, d).select("query_id", words("text").alias("w"))
    n = q.groupBy("query_id").agg(F.sum(F.size("w")).alias("n"))
    terms = materialize(q.select("query_id", F.explode("w").alias("term")).distinct().withColumn("w", F.lit(1.0)), "terms")
    k = materialize(key_points(spark, d).select(F.col("kp_id").alias("doc_id"), words("content").alias("t")).groupBy("doc_id").agg(F.collect_list("t").alias("parts")), "words")
    best = R.ranked_best(R.best_by_terms(terms, k, 10, present("parts")), 10)  # by words in common, which the query's number of words divides
    return best.join(n, "query_id").select("query_id", F.col("doc_id").alias("kp_id"), F.round(F.col("score") / F.col("n"), 6).alias("score"))


@query("R9_and_or_fallback", f"""
    WITH {NAMED}, q AS (SELECT DISTINCT query_id, list_distinct({TOK.format(x="coalesce(s[1].category, '') || ' ' || coalesce(s[1].name, '')")}) AS w FROM named), qt AS (SELECT query_id, len(w) AS words, unnest(w) AS word FROM q),
    f AS (SELECT doc_id, term, max(weight) AS weight FROM (SELECT kp_id AS doc_id, 1.0::DOUBLE AS weight, unnest({TOK.format(x="coalesce(name, '')")}) AS term FROM kps UNION ALL SELECT kp_id, 0.4, unnest({TOK.format(x="coalesce(category, '')")}) FROM kps UNION ALL SELECT kp_id, 0.2, unnest({TOK.format(x="coalesce(content, '')")}) FROM kps) GROUP BY 1, 2),
    m AS (SELECT DISTINCT word, term FROM (SELECT DISTINCT word FROM qt) a JOIN (SELECT DISTINCT term FROM f) b ON term = word OR (length(word) >= 3 AND starts_with(term, word))),
    h AS (SELECT query_id, words, doc_id, count(*) AS found, sum(w) AS s FROM (SELECT query_id, words, doc_id, word, max(weight) AS w FROM qt JOIN m USING (word) JOIN f USING (term) GROUP BY ALL) GROUP BY ALL),
    e AS (SELECT query_id, count(*) FILTER (WHERE found = words) >= 10 AS enough FROM h GROUP BY 1)
    SELECT query_id, doc_id, mode, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS n FROM (SELECT query_id, doc_id, round(s / (s + 1), 9) AS score, CASE WHEN enough THEN 'and' ELSE 'or' END AS mode FROM h JOIN e USING (query_id) WHERE NOT enough OR found = words)) WHERE n <= 10
    """.replace("WITH named", ", named", 1), uses="kps")
def _(spark, d):
    first = F.get("s", 0)
    q = named(spark, d).select("query_id", F.concat(F.coalesce(first["category"], F.lit("")), F.lit(" "), F.coalesce(first["name"], F.lit(""))).alias("text")).distinct()
    k = key_points(spark, d)
    fields = k.select(F.col("kp_id").alias("doc_id"), F.explode(F.array(F.struct(F.col("name").alias("text"), F.lit(1.0).alias("weight")), F.struct(F.col("category").alias("text"), F.lit(0.4).alias("weight")), F.struct(F.col("content").alias("text"), F.lit(0.2).alias("weight")))).alias("f")).select("doc_id", "f.text", "f.weight")
    return R.word_search(q, fields, T.mixed_tokens, 10).select("query_id", "doc_id", "mode", F.round("score", 6).alias("score"))


@query("R14_tfidf_duplicates", f"""
    SELECT name, kept FROM (WITH RECURSIVE t AS (SELECT name AS doc_id, row_number() OVER (ORDER BY name) AS i FROM (SELECT DISTINCT name FROM kps WHERE name IS NOT NULL)), p AS (SELECT i, term, count(*) AS tf FROM (SELECT i, unnest({TOK.format(x='doc_id')}) AS term FROM t) GROUP BY 1, 2),
    x AS (SELECT p.i, term, tf * (ln((1 + (SELECT count(*) FROM t)) / (1 + df)) + 1) AS w FROM p JOIN (SELECT term, count(*) AS df FROM p GROUP BY 1) USING (term)), y AS (SELECT i, term, w / sqrt(sum(w * w) OVER (PARTITION BY i)) AS w FROM x),
    nb AS (SELECT b AS i, list(a) AS l FROM (SELECT u.i AS a, v.i AS b FROM y u JOIN y v ON u.term = v.term AND u.i < v.i GROUP BY 1, 2 HAVING round(sum(u.w * v.w), 9) >= 0.75) GROUP BY 1),
    r(i, kept) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT r.i + 1, CASE WHEN len(list_intersect(r.kept, coalesce(nb.l, []))) > 0 THEN r.kept ELSE list_append(r.kept, r.i + 1) END FROM r LEFT JOIN nb ON nb.i = r.i + 1 WHERE r.i < (SELECT count(*) FROM t))
    SELECT doc_id AS name, list_contains((SELECT kept FROM r ORDER BY i DESC LIMIT 1), i) AS kept FROM t)
    """, uses="kps")
def _(spark, d):
    n = table(spark, d, "key_points").where("name is not null").select(F.col("name").alias("doc_id")).distinct()
    ix = R.Index(n.withColumn("text", F.col("doc_id")), T.mixed_tokens)
    return R.keep_first(n.withColumnRenamed("doc_id", "id"), R.tfidf_pairs(ix, 0.75)).select(F.col("id").alias("name"), "kept")


@query("R17_average_vector", """
    SELECT query_id, vec_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM (
        SELECT * FROM (SELECT q.query_id, c.vec_id, round(list_cosine_similarity(q.v, c.v), 9) AS score, row_number() OVER (PARTITION BY q.query_id ORDER BY round(list_cosine_similarity(q.v, c.v), 9) DESC, c.vec_id) AS r FROM (
            SELECT query_id, list(x ORDER BY i) AS v FROM (SELECT vec_id - vec_id % 50 AS query_id, i, avg(x) AS x FROM (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vecs WHERE vec_id % 50 < 3) GROUP BY 1, 2) GROUP BY 1) q, vecs c)
        WHERE r <= 10 AND vec_id NOT BETWEEN query_id AND query_id + 2)) WHERE n <= 5
    """, uses="vecs")
def _(spark, d):
    # the facts of a query's keywords are three vectors; their mean is searched for twice as many as wanted, and the facts themselves left out
    v = vectors(spark, d).where("vec_id % 50 < 3").select((F.col("vec_id") - F.col("vec_id") % 50).alias("query_id"), F.posexplode("v").alias("i", "x"))
    mean = v.groupBy("query_id", "i").agg(F.avg("x").alias("x")).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s.x).alias("v"))  # one vector
    near = R.dense(mean, vectors(spark, d).select("vec_id", "v"), 10).where("vec_id < query_id or vec_id > query_id + 2")
    return near.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where("n <= 5").select("query_id", "vec_id", F.round("score", 6).alias("score"))


EVENTS = "ev AS (SELECT event_id, min(event) AS event, min(type) AS type FROM nodes WHERE event_id IS NOT NULL GROUP BY 1)"


def events_of(spark, d):
    return nodes(spark, d).where("event_id is not null").groupBy("event_id").agg(F.min("event").alias("event"), F.min("type").alias("type"))


@query("R21_relation_search", wrap(f"{E}, {EVENTS}, {ASKED}, tr AS (SELECT src || '>' || dst AS doc_id, src, dst, coalesce(a.event, '') || ' ' || coalesce(b.event, '') AS text FROM e JOIN ev a ON a.event_id = src JOIN ev b ON b.event_id = dst), {bm25_sql('tr', 'asked')}, nv AS (SELECT event_id, {letters_sql('event')} AS v FROM ev WHERE event IS NOT NULL), qv AS (SELECT query_id, {letters_sql('text')} AS v FROM asked), hit AS (SELECT query_id, event_id FROM qv, nv WHERE list_sum(qv.v) > 0 AND list_sum(nv.v) > 0 AND round(list_cosine_similarity(qv.v, nv.v), 9) >= 0.7), rel AS (SELECT DISTINCT query_id, doc_id FROM hit JOIN tr ON src = event_id OR dst = event_id)", "SELECT query_id, doc_id, round(score, 6) AS score FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS n FROM sc JOIN rel USING (query_id, doc_id) WHERE score > 0) WHERE n <= 5"), uses="nodes")
def _(spark, d):
    _, e = graph(spark, d)
    ev = materialize(events_of(spark, d).select("event_id", F.coalesce("event", F.lit("")).alias("t"), V.letters(F.col("event")).alias("v")), "events")
    side = lambda x: ev.select(F.col("event_id").alias(x), F.col("t").alias(f"t{x}"), F.col("v").alias(f"v{x}"))
    tr = e.join(side("src"), "src").join(side("dst"), "dst").select(F.concat_ws(">", F.col("src").cast("string"), F.col("dst").cast("string")).alias("doc_id"), F.concat_ws(" ", "tsrc", "tdst").alias("text"), "vsrc", "vdst")
    q = asked(spark, d)
    ends = R.near_ends(q.select("query_id", V.letters(F.col("text")).alias("v")), ("vsrc", "vdst"), 0.7)
    s = R.bm25(q, R.Index(tr, T.mixed_tokens, ("vsrc", "vdst")), T.mixed_tokens, 5, change=ends)
    return s.select("query_id", "doc_id", F.round("score", 6).alias("score"))


@query("Q17_entity_lookup", wrap(f"{E}, {EVENTS}, q AS (SELECT DISTINCT session_id AS query_id, event_info.event AS text FROM sessions WHERE session_id % 50 = 0 AND event_info.event IS NOT NULL), x AS (SELECT query_id, event_id FROM q JOIN ev ON ev.event = q.text), nv AS (SELECT event_id, {letters_sql('event')} AS v FROM ev WHERE event IS NOT NULL), qv AS (SELECT query_id, {letters_sql('text')} AS v FROM q WHERE query_id NOT IN (SELECT query_id FROM x)), n AS (SELECT query_id, event_id FROM (SELECT query_id, event_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, event_id) AS r FROM (SELECT query_id, event_id, round(list_cosine_similarity(qv.v, nv.v), 9) AS score FROM qv, nv WHERE list_sum(qv.v) > 0 AND list_sum(nv.v) > 0)) WHERE r <= 5 AND 1 - score < 0.5), f AS (SELECT * FROM x UNION SELECT * FROM n)", "SELECT DISTINCT f.query_id, e.src, ev.type AS relation, e.dst FROM f JOIN e ON e.src = f.event_id OR e.dst = f.event_id LEFT JOIN ev ON ev.event_id = e.dst"), uses="nodes")
def _(spark, d):
    _, e = graph(spark, d)
    ev = materialize(events_of(spark, d), "events")
    q = table(spark, d, "sessions").where("session_id % 50 = 0 and event_info.event is not null").select(F.col("session_id").alias("query_id"), F.col("event_info.event").alias("text")).distinct()
    exact = q.join(ev.select("event_id", F.col("event").alias("text")), "text").select("query_id", "event_id")
    rest = q.join(exact, "query_id", "left_anti").select("query_id", V.letters(F.col("text")).alias("v"))
    near = R.dense(rest, ev.where("event is not null").select(F.col("event_id").alias("vec_id"), V.letters(F.col("event")).alias("v")), 5).where("1 - score < 0.5").select("query_id", F.col("vec_id").alias("event_id"))
    found = exact.union(near).distinct()
    hit = found.join(e, found.event_id == e.src).select("query_id", "src", "dst").union(found.join(e, found.event_id == e.dst).select("query_id", "src", "dst"))
    return hit.join(ev.select(F.col("event_id").alias("dst"), F.col("type").alias("relation")), "dst", "left").select("query_id", "src", "relation", "dst").distinct()


@query("Q7_trigram_match", f"""
    WITH {NAMED}, q AS (SELECT DISTINCT query_id, persona_id, lower(s[1].name) AS p FROM named WHERE length(s[1].name) >= 3 AND persona_id IS NOT NULL), h AS (SELECT query_id, kp_id, (length(content) - length(replace(lower(content), p, ''))) / length(p) * 100.0 / length(content) AS r FROM q JOIN kps USING (persona_id) WHERE contains(lower(content), p))
    SELECT query_id, kp_id, round(r / max(r) OVER (PARTITION BY query_id), 6) AS score FROM h
    """.replace("WITH named", ", named", 1), uses="kps")
def _(spark, d):
    # a word of three letters or more inside a text of the same owner; the owner is the key of the join, so only its texts are read for it
    q = named(spark, d).select("query_id", "persona_id", F.lower(F.get("s", 0)["name"]).alias("p")).where("length(p) >= 3 and persona_id is not null").distinct()
    c = F.lower("content")
    h = key_points(spark, d).join(F.broadcast(q) if q.count() <= R.MOST_TERMS else q, "persona_id").where(F.contains(c, F.col("p")))
    h = h.select("query_id", "kp_id", ((F.length("content") - F.length(F.replace(c, F.col("p"), F.lit("")))) / F.length("p") * 100.0 / F.length("content")).alias("r"))
    return h.select("query_id", "kp_id", F.round(F.col("r") / F.max("r").over(Window.partitionBy("query_id")), 6).alias("score"))


CLUES = r"sub AS (SELECT query_id || '#' || i AS query_id, query_id AS whole, c[i] AS text FROM (SELECT query_id, c, unnest(range(1, len(c) + 1)) AS i FROM (SELECT query_id, list_append(list_filter(regexp_split_to_array(text, '[.;。；?？!！\n]'), lambda x: len(%s) > 3), text) AS c FROM asked)))" % TOK.format(x="x")


@query("Q20_corpus_order", f"WITH {ALL_ASKED}, {CLUES}, {bm25_sql('documents', 'sub')} SELECT DISTINCT s.whole AS query_id, rk.doc_id FROM rk JOIN sub s USING (query_id) WHERE rank <= 3 AND score > 0")
def _(spark, d):
    lines = F.filter(F.split("text", "[.;。；?？!！\n]"), lambda x: F.size(T.mixed_tokens(x)) > 3)
    c = all_asked(spark, d).select(F.col("query_id").alias("whole"), F.posexplode(F.array_append(lines, F.col("text"))).alias("i", "text"))
    sub = c.select(F.concat_ws("#", F.col("whole").cast("string"), (F.col("i") + 1).cast("string")).alias("query_id"), "whole", "text")
    hits = R.bm25(sub.select("query_id", "text"), index(spark, d), T.mixed_tokens, 3)
    return hits.join(sub.select("query_id", "whole").distinct(), "query_id").select(F.col("whole").alias("query_id"), "doc_id").distinct().orderBy("query_id", "doc_id")


@query("T5_keyset_page", """
    SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS n, count(*) OVER () AS k FROM (SELECT * FROM events WHERE (ts > TIMESTAMP '2024-01-05' OR ts = TIMESTAMP '2024-01-05' AND event_id > 100) AND (ts < TIMESTAMP '2024-01-20' OR ts = TIMESTAMP '2024-01-20' AND event_id < 5000) ORDER BY ts, event_id LIMIT 50))
    WHERE n >= greatest(0, (k - 25) // 2) AND n < greatest(0, (k - 25) // 2) + 25
    """)
def _(spark, d):
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    after = (F.col("ts") > at("2024-01-05")) | ((F.col("ts") == at("2024-01-05")) & (F.col("event_id") > 100))
    before = (F.col("ts") < at("2024-01-20")) | ((F.col("ts") == at("2024-01-20")) & (F.col("event_id") < 5000))
    return R.middle_page(table(spark, d, "events").select("ts", "event_id"), [F.col("ts"), F.col("event_id")], after, before, 25).select("event_id")


@query("T6_cursor_page", "SELECT event_id, more FROM (SELECT event_id, row_number() OVER (ORDER BY value DESC, event_id) AS n, (SELECT count(*) FROM events) > 40 AS more FROM events WHERE value IS NOT NULL) WHERE n BETWEEN 21 AND 40")
def _(spark, d):
    e = table(spark, d, "events").where("value is not null").select("event_id", "value", "ts")
    cursor = R.cursor_page(e, "value", "event_id", ("value", "ts"), None, 20)[1]
    page, after = R.cursor_page(e, "value", "event_id", ("value", "ts"), cursor, 20) if cursor else ([], None)
    return spark.createDataFrame([(r["event_id"], after is not None) for r in page], "event_id long, more boolean")


@query("T7_smallest_sums", wrap(f"{E}, w AS (SELECT event_id, min(coalesce(time_span_days, 1) / 100.0::DOUBLE) AS w FROM nodes GROUP BY 1)", "SELECT src, dst, round(coalesce(a.w, 1) + coalesce(b.w, 1) + abs(src - dst) % 100 / 100.0::DOUBLE, 6) AS distance FROM e LEFT JOIN w a ON a.event_id = src LEFT JOIN w b ON b.event_id = dst ORDER BY 3, 1, 2 LIMIT 5"), uses="nodes")
def _(spark, d):
    w = nodes(spark, d).groupBy("event_id").agg(F.min(F.coalesce("time_span_days", F.lit(1)) / 100.0).alias("w"))
    _, e = graph(spark, d)
    side = lambda x: w.select(F.col("event_id").alias(x), F.col("w").alias(f"w{x}"))
    t = e.join(side("src"), "src", "left").join(side("dst"), "dst", "left")
    own = F.abs(F.col("src") - F.col("dst")) % 100 / 100.0
    return t.select("src", "dst", F.round(F.coalesce("wsrc", F.lit(1.0)) + F.coalesce("wdst", F.lit(1.0)) + own, 6).alias("distance")).orderBy("distance", "src", "dst").limit(5)
