"""Graph queries over event links and vector neighbours."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from recollect.operators import curation as C
from recollect.operators import graph as G
from recollect.operators import retrieval as R
from recollect.plans.registry import nodes, query, vectors
from recollect.plans.retrieval import NEAR, near
from recollect.runtime import materialize

E = "e AS (SELECT DISTINCT src, dst FROM (SELECT unnest(triggered_by) AS src, event_id AS dst FROM nodes) WHERE src IS NOT NULL AND src <> dst)"
B = "b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)"


def graph(spark, d):
    n = nodes(spark, d)
    return n.select(F.col("event_id").alias("node")).where("node is not null").distinct(), C.edges(n)


def wrap(ctes: str, select: str, recursive: bool = False) -> str:
    return f"SELECT * FROM (WITH {'RECURSIVE ' if recursive else ''}{ctes} {select})"


@query("J9_neighbours", wrap(f"{E}, {B}", "SELECT src AS node, dst AS neighbour FROM b WHERE src % 5 = 0"), uses="nodes")
def _(spark, d):
    n, e = graph(spark, d)
    return G.neighbours(e, e.select(F.col("src").alias("node")).union(e.select("dst")).where("node % 5 = 0"))


@query("R20_k_hop", wrap(f"{E}, h(start, node, hop) AS (SELECT DISTINCT event_id, event_id, 0 FROM nodes WHERE event_id % 10 = 0 UNION SELECT start, dst, hop + 1 FROM h JOIN e ON src = node WHERE hop < 3)", "SELECT start, node, min(hop) AS hop FROM h GROUP BY ALL", True), uses="nodes")
def _(spark, d):
    n, e = graph(spark, d)
    return G.k_hop(e, n.where("node % 10 = 0"), 3)


@query("R19_bounded_paths", wrap(f"{E}, p(start, node, path) AS (SELECT DISTINCT event_id, event_id, [event_id] FROM nodes WHERE event_id % 10 = 0 UNION ALL SELECT start, dst, list_append(path, dst) FROM p JOIN e ON src = node WHERE len(path) <= 3 AND NOT list_contains(path, dst))", "SELECT start, node, array_to_string(path, '>') AS path FROM p WHERE len(path) > 1", True), uses="nodes")
def _(spark, d):
    n, e = graph(spark, d)
    return G.paths(e, n.where("node % 10 = 0"), 3).select("start", "node", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query("A23_components", wrap(f"{E}, {B}, r(node, comp) AS (SELECT DISTINCT event_id, event_id FROM nodes WHERE event_id IS NOT NULL UNION SELECT src, comp FROM r JOIN b ON dst = node JOIN (SELECT DISTINCT event_id FROM nodes) x ON x.event_id = src WHERE comp < src)", "SELECT node, min(comp) AS component FROM r GROUP BY 1", True), uses="nodes")
def _(spark, d):
    n, e = graph(spark, d)
    known = e.join(n.select(F.col("node").alias("src")), "src", "left_semi")
    return G.components(n, known)


@query("A23_graph_measures")
def _(spark, d):
    n, e = graph(spark, d)
    return G.measures(n.union(e.select("src")).distinct(), e)


@query("R23_personalized_rank")
def _(spark, d):
    n, e = graph(spark, d)
    seeds = n.where("node % 50 = 0").withColumn("weight", F.lit(1.0))
    return G.pagerank(n.union(e.select("src")).distinct(), G.undirected(e), 0.5, 10, seeds).select("node", F.round("rank", 9).alias("rank"))


def similar(spark, d, threshold=0.4):
    return near(spark, d, None, threshold=threshold).where("vec_id <> query_id").select(F.col("query_id").alias("src"), F.col("vec_id").alias("dst"), F.col("score").alias("sim"))


@query("J7_similar_nodes", f"SELECT query_id AS src, vec_id AS dst, round(score, 6) AS sim FROM (WITH {NEAR} SELECT * FROM near WHERE vec_id <> query_id AND score >= 0.4)", uses="vecs")
def _(spark, d):
    return similar(spark, d).select("src", "dst", F.round("sim", 6).alias("sim"))


@query("R18_graph_build", f"SELECT n.query_id AS src, n.vec_id AS dst, round(0.7 * score + 0.3 * (a.label = b.label)::INT, 6) AS weight FROM (WITH {NEAR} SELECT * FROM near WHERE vec_id <> query_id AND score >= 0.4) n JOIN vecs a ON a.vec_id = n.query_id JOIN vecs b ON b.vec_id = n.vec_id", uses="vecs")
def _(spark, d):
    lab = vectors(spark, d).select("vec_id", "label")
    e = similar(spark, d).join(lab.select(F.col("vec_id").alias("src"), F.col("label").alias("a")), "src").join(lab.select(F.col("vec_id").alias("dst"), F.col("label").alias("b")), "dst")
    return e.select("src", "dst", F.round(0.7 * F.col("sim") + 0.3 * (F.col("a") == F.col("b")).cast("int"), 6).alias("weight"))


PAIRS = "pairs AS (SELECT a.vec_id AS src, b.vec_id AS dst, a.label = b.label AS same, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 9) AS sim FROM vecs a JOIN vecs b ON a.vec_id < b.vec_id)"


@query("J7_similar_nodes_all", f"SELECT src, dst, round(sim, 6) AS sim FROM (WITH {PAIRS} SELECT * FROM pairs WHERE sim >= 0.4)", uses="vecs")
def _(spark, d):
    return R.similar_pairs(vectors(spark, d), 0.4).select("src", "dst", F.round("sim", 6).alias("sim"))


@query("R18_graph_build_all", f"SELECT src, dst, round(0.7 * sim + 0.3 * same::INT, 6) AS weight FROM (WITH {PAIRS} SELECT * FROM pairs WHERE sim >= 0.4)", uses="vecs")
def _(spark, d):
    lab = vectors(spark, d).select("vec_id", "label")
    e = R.similar_pairs(vectors(spark, d), 0.4).join(lab.select(F.col("vec_id").alias("src"), F.col("label").alias("a")), "src").join(lab.select(F.col("vec_id").alias("dst"), F.col("label").alias("b")), "dst")
    return e.select("src", "dst", F.round(0.7 * F.col("sim") + 0.3 * (F.col("a") == F.col("b")).cast("int"), 6).alias("weight"))


@query("R19_expansion")
def _(spark, d):
    e = R.similar_pairs(vectors(spark, d), 0.3).select("src", "dst", F.col("sim").alias("weight"))
    e = materialize(e.union(e.select("dst", "src", "weight")), "graph")
    seeds = near(spark, d, 3).select("query_id", F.col("vec_id").alias("node"), "score").where("score > 0")
    concepts = vectors(spark, d).select(F.col("vec_id").alias("node"), F.array("label").alias("concepts"))
    return G.expanded(seeds, e, concepts)


@query("R22_triplets", wrap(f"{E}, w AS (SELECT DISTINCT event_id, coalesce(time_span_days, 1) / 100.0 AS w FROM nodes), m AS (SELECT event_id, min(w) AS w FROM w GROUP BY 1)", "SELECT src, dst, round(coalesce(a.w, 1) + coalesce(b.w, 1) + 1, 6) AS distance FROM e LEFT JOIN m a ON a.event_id = src LEFT JOIN m b ON b.event_id = dst ORDER BY 3, 1, 2 LIMIT 20"), uses="nodes")
def _(spark, d):
    m = nodes(spark, d).groupBy("event_id").agg(F.min(F.coalesce("time_span_days", F.lit(1)) / 100.0).alias("w"))
    _, e = graph(spark, d)
    t = e.join(m.select(F.col("event_id").alias("src"), F.col("w").alias("a")), "src", "left").join(m.select(F.col("event_id").alias("dst"), F.col("w").alias("b")), "dst", "left")
    return t.select("src", "dst", F.round(F.coalesce("a", F.lit(1)) + F.coalesce("b", F.lit(1)) + 1, 6).alias("distance")).orderBy("distance", "src", "dst").limit(20)


@query("R25_link_expansion", wrap(f"{E}, s AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS n FROM e)", "SELECT src, dst FROM s WHERE n <= 3"), uses="nodes")
def _(spark, d):
    _, e = graph(spark, d)
    return e.withColumn("n", F.row_number().over(Window.partitionBy("src").orderBy("dst"))).where("n <= 3").select("src", "dst")


@query("R27_merged_nodes", wrap(f"{E}, m AS (SELECT DISTINCT CASE WHEN src % 2 = 1 THEN src - 1 ELSE src END AS src, CASE WHEN dst % 2 = 1 THEN dst - 1 ELSE dst END AS dst FROM e)", "SELECT src, dst FROM m WHERE src <> dst"), uses="nodes")
def _(spark, d):
    _, e = graph(spark, d)
    even = lambda c: F.when(F.col(c) % 2 == 1, F.col(c) - 1).otherwise(F.col(c)).alias(c)
    return e.select(even("src"), even("dst")).where("src <> dst").distinct()


@query("S16_degree_one", wrap(f"{E}, {B}", "SELECT src AS node FROM b GROUP BY 1 HAVING count(*) = 1"), uses="nodes")
def _(spark, d):
    _, e = graph(spark, d)
    return G.undirected(e).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n")).where("n = 1").select("node")


@query("R24_recursive_clusters")
def _(spark, d):
    return G.recursive_clusters(vectors(spark, d))


@query("R27_triangles", wrap(f"{E}, {B}", "SELECT p.src AS node, count(*) AS triangles FROM b p JOIN b q ON p.src = q.src AND p.dst < q.dst JOIN b r ON r.src = p.dst AND r.dst = q.dst GROUP BY 1"), uses="nodes")
def _(spark, d):
    _, e = graph(spark, d)
    return G.triangles(e)
