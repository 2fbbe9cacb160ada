"""Whole jobs: every pair, every node, every key, whatever the cut of a query set, a batch or a depth."""

import heapq
import math
import random

from recollect.operators import graph as G
from recollect.operators import retrieval as R
from recollect.plans.catalog import QUERIES
from recollect.streaming import streams as S


def embeddings(spark, tmp_path, degrees):
    rows = [(k, k, [math.cos(math.radians(a)), math.sin(math.radians(a))]) for k, a in degrees.items()]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


def test_similar_pairs_equal_brute_force_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 16)
    rng = random.Random(5)
    v = {k: [rng.gauss(0, 1) for _ in range(4)] for k in range(1, 50)}
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.hypot(*a) / math.hypot(*b)
    want = {(a, b) for a in v for b in v if a < b and round(cosine(v[a], v[b]), 9) >= 0.4}
    got = [(r["src"], r["dst"]) for r in R.similar_pairs(spark.createDataFrame([*v.items()], "vec_id long, v array<double>").repartition(3), 0.4).collect()]
    assert want and len(got) == len(want) and {*got} == want


def test_graph_has_edges_of_all_nodes(spark, tmp_path):
    d = embeddings(spark, tmp_path, {1: 0, 2: 30, 3: 170, 4: 50})
    assert {(r["src"], r["dst"]) for r in QUERIES["J7_similar_nodes_all"](spark, d).collect()} == {(1, 2), (1, 4), (2, 4)}
    assert QUERIES["R18_graph_build_all"](spark, d).count() == 3
    assert {r["query_id"]: r["action"] for r in QUERIES["R16_key_dedup_all"](spark, d).collect()} == {1: "new", 2: "append", 3: "new", 4: "append"}


def test_expansion_walks_edges_beside_the_query_set(spark, tmp_path):
    d = embeddings(spark, tmp_path, {0: 0, 1: 10, 2: 20, 3: 80, 4: 150})
    assert {r["node"] for r in QUERIES["R19_expansion"](spark, d).collect()} == {0, 1, 2, 3, 4}


def test_update_stream_keeps_keys_absent_from_the_last_batch(spark, tmp_path):
    for part in ([(1, 1, False), (2, 2, False), (1, 3, False)], [(1, 4, False), (3, 5, True)], [(3, 6, False)]):
        spark.createDataFrame(part, "persona_id long, session_id long, is_noise boolean").coalesce(1).write.mode("append").parquet(f"{tmp_path}/t.parquet")
    got = S.drained(S.unit_builder(S.stream_of(spark, str(tmp_path), "t"), 2), "update")
    assert sorted(tuple(r) for r in got.collect()) == [(1, 3, 1, 1), (2, 1, 1, 0), (3, 1, 2, 0)]
    events = [(u, k, 10.0) for k, u in enumerate((1, 2, 1, 3))]
    for e in events:
        spark.createDataFrame([e], "user_id long, event_id long, value double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/e.parquet")
    got = S.drained(S.value_keeper(S.stream_of(spark, str(tmp_path), "e")), "update")
    assert {r["user_id"]: (round(r["q"], 6), r["visits"]) for r in got.collect()} == {1: (5.1, 2), 2: (3.0, 1), 3: (3.0, 1)}


def test_expansion_equals_the_heap_beyond_200_nodes(spark):
    rng = random.Random(2)
    out = {k: {} for k in range(400)}
    for a in range(400):
        for b in {a + 1, a + 2} | ({rng.randrange(400) for _ in range(300)} if a == 9 else set()):
            if b < 400 and b != a:
                out[a][b] = out[b][a] = rng.uniform(0.3, 1)
    concepts = {k: [k if k < 12 else rng.randrange(12)] for k in out}
    seeds = [(1, 0, 0.9), (1, 5, 0.4), (2, 3, 0.7)]
    want = {}
    for q in (1, 2):
        heap, done, known = [(1 / s, n) for i, n, s in seeds if i == q], [], set()
        heapq.heapify(heap)
        while heap:
            cost, n = heapq.heappop(heap)
            if n in done:
                continue
            done.append(n)
            if len(done) == 1 or not {*concepts[n]} <= known:
                known |= {*concepts[n]}
                for m, w in out[n].items():
                    heapq.heappush(heap, (cost + 1 / w, m))
        want[q] = done
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = G.expanded(frame(seeds, "query_id long, node long, score double"), frame([(a, b, w) for a in out for b, w in out[a].items()], "src long, dst long, weight double"), frame([*concepts.items()], "node long, concepts array<int>"))
    rows = sorted((r["query_id"], r["order"], r["node"]) for r in got.collect())
    assert max(map(len, want.values())) > 200
    assert {q: [n for i, _, n in rows if i == q] for q in want} == want


def test_no_cluster_stays_over_the_limit(spark):
    same = [(k, [1.0, 1.0]) for k in range(45)]
    c = [r["cluster"] for r in G.recursive_clusters(spark.createDataFrame(same, "vec_id long, v array<double>"), 10, 2).collect()]
    assert len(c) == 45 and max(map(c.count, c)) <= 10
