import json
import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recollect.functions import text as T
from recollect.operators import aggregates as A
from recollect.operators import chunking as K
from recollect.operators import curation as C
from recollect.operators import graph as G
from recollect.operators import retrieval as R
from recollect.operators import stores as S
from recollect.operators.filters import compile_filter
from recollect.sources import files


def sessions(spark, flags):
    rows = [(1, k, k, bool(f)) for k, f in enumerate(flags)]
    return spark.createDataFrame(rows, "persona_id long, session_id long, original_index int, is_noise boolean")


def loop_units(flags, interval):
    out, count, pending, unit = {}, 0, [], 0
    for k, noise in enumerate(flags):
        pending.append(k)
        count += not noise
        if not noise and count % interval == 0:
            out |= dict.fromkeys(pending, unit)
            pending, unit = [], unit + 1
    return out | dict.fromkeys(pending)


@pytest.mark.parametrize("flags", [[0] * 7, [0, 1, 0, 1, 1, 0, 0, 0], [1, 1, 1], [0, 0, 0, 1, 1]])
def test_units_equal_a_loop(spark, flags):
    got = {r["session_id"]: r["unit"] for r in C.units(sessions(spark, flags), 3).collect()}
    assert got == loop_units(flags, 3)


def test_units_without_query_are_dropped(spark):
    s = sessions(spark, [0] * 6)
    u = C.units(s, 3, spark.createDataFrame([(1, 5)], "persona_id long, session_id long"))
    assert sorted(r["session_id"] for r in u.collect()) == [3, 4, 5]


def test_packing_respects_limit_and_order(spark):
    rng = random.Random(0)
    rows = [(s, t, "user", "x" * rng.randint(0, 90)) for s in range(5) for t in range(20)]
    p = C.packed(spark.createDataFrame(rows, "session_id long, turn int, role string, content string"), 100)
    assert p.agg(F.max("chars")).first()[0] <= 100 and p.agg(F.sum("turns")).first()[0] == 100


def test_injection_keeps_everything_once(spark):
    o = spark.createDataFrame([(1, k) for k in range(10)], "p long, s long")
    n = spark.createDataFrame([(1, 100 + k) for k in range(5)], "p long, s long")
    r = C.injected(o, n, "p", "s").orderBy("position").collect()
    assert [x["position"] for x in r] == list(range(15)) and [x["s"] for x in r if not x["is_noise"]] == list(range(10))


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "apple pie"), (2, "apple apple tart"), (3, "plum"), (4, None)], "doc_id long, text string")
    q = spark.createDataFrame([(7, "pie apple")], "query_id long, text string")
    r = {x["doc_id"]: x["score"] for x in R.bm25(q, docs, T.mixed_tokens, 5).collect()}
    import math

    n, avg = 4, 6 / 4
    idf = {t: math.log((n - d + 0.5) / (d + 0.5)) for t, d in {"apple": 2, "pie": 1, "tart": 1, "plum": 1}.items()}
    score = lambda tf, dl: tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg))
    assert abs(r[1] - (idf["pie"] * score(1, 2) + idf["apple"] * score(1, 2))) < 1e-8 and 3 not in r and 4 not in r


def test_bm25_common_terms_get_the_floor(spark):
    docs = spark.createDataFrame([(k, "same rare" if k == 0 else "same") for k in range(5)], "doc_id long, text string")
    r = R.bm25(spark.createDataFrame([(1, "same")], "query_id long, text string"), docs, T.mixed_tokens, 10)
    assert r.count() in (0, 5)


def test_dense_equals_brute_force_and_nests(spark):
    rng = random.Random(1)
    vecs = [(k, [rng.gauss(0, 1) for _ in range(8)]) for k in range(200)] + [(900, [0.0] * 8), (901, None), (902, [1.0])]
    c = spark.createDataFrame(vecs, "vec_id long, v array<double>")
    q = c.where("vec_id < 6").select(F.col("vec_id").alias("query_id"), "v")
    got = defaultdict(list)
    for r in R.dense(q, c.repartition(5), 7).orderBy("rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    unit = {k: [x / sum(y * y for y in v) ** 0.5 for x in v] for k, v in vecs[:200]}
    for k in range(6):
        s = sorted(unit, key=lambda j: (-round(sum(a * b for a, b in zip(unit[k], unit[j])), 9), j))[:7]
        assert got[k] == s
    assert R.dense(q.where("query_id < 0"), c, 3).count() == 0


def test_fusion_and_choices(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, doc_id long, rank int")
    b = spark.createDataFrame([(1, 11, 1)], "query_id long, doc_id long, rank int")
    r = {x["doc_id"]: x["score"] for x in R.reciprocal_rank_fusion([a, b]).collect()}
    assert abs(r[11] - (1 / 62 + 1 / 61)) < 1e-12 and abs(r[10] - 1 / 61) < 1e-12
    import pandas as pd

    pdf = pd.DataFrame({"score": [0.9, 0.8, 0.7], "v": [[1, 0], [1, 0.01], [0, 1]]})
    assert R.choose_dissimilar(0.92)(pdf) == [0, 2] and R.choose_mmr(2)(pdf) == [0, 2] and R.choose_mmr(5)(pdf)[0] == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .。\n#", max_size=300))
def test_lossless_chunks(text):
    if text:
        assert "".join(K.lossless(5)(text)) == text


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="abc .!?\n", max_size=400))
def test_packers_keep_limits_and_words(text):
    for limit in (20, 60):
        for make in (K.sentence_packer, K.paragraph_packer):
            parts = make(limit)(text)
            assert all(len(p) <= limit for p in parts) and "".join("".join(parts).split()) == "".join(text.split())


def test_windows(spark):
    r = lambda text, size, over: [x["text"] for x in K.chunked(spark.createDataFrame([(1, text)], "doc_id long, text string"), size, over).orderBy("chunk").collect()]
    assert r("a b c d e", 3, 1) == ["a b c", "c d e"] and r("a b", 3, 1) == ["a b"] and r(" ", 3, 1) == [] and r(None, 3, 1) == []
    with pytest.raises(ValueError):
        K.windows(F.col("t"), 3, 3)


def test_filters(spark):
    df = spark.createDataFrame([(1, json.dumps({"k": 5, "tag": "Blue sky"})), (2, json.dumps({"k": "x"})), (3, None)], "id long, p string")
    ids = lambda tree: [r["id"] for r in df.where(compile_filter(tree, "p")).orderBy("id").collect()]
    assert ids({"k": {"gte": 5}}) == [1] and ids({"tag": {"contains": "SKY"}}) == [1] and ids({"k": {"exists": True}}) == [1, 2]
    assert ids({"or": [{"k": 5}, {"k": "x"}]}) == [1, 2] and ids({"not": {"k": 5}}) == [2, 3] and ids({"k": {"in": ["x"]}}) == [2]
    with pytest.raises(ValueError):
        compile_filter({"k": {"near": 1}})


def test_operation_log(spark):
    log = [(1, 1, "ADD", "a"), (1, 2, "UPDATE", "b"), (2, 3, "ADD", "x"), (2, 4, "DELETE", None), (3, 5, "UPDATE", "new"), (4, 6, "DELETE", None), (5, 7, "ADD", " "), (1, 8, "NONE", "z"), (2, 9, "ADD", "again")]
    r = S.fold_log(spark.createDataFrame(log, "memory_id long, seq long, op string, fact string"), "memory_id", ["seq"], "op", "fact")
    assert {x["memory_id"]: x["fact"] for x in r.collect()} == {1: "b", 2: "again", 3: "new"}


def test_graph_against_plain_search(spark):
    rng = random.Random(3)
    edges = {(rng.randrange(40), rng.randrange(40)) for _ in range(35)}
    e = spark.createDataFrame(sorted(edges), "src long, dst long")
    n = spark.range(40).select(F.col("id").alias("node"))
    parent = list(range(40))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    assert {r["node"]: r["component"] for r in G.components(n, e).collect()} == {k: root(k) for k in range(40)}
    near = {0: {0}}
    for hop in range(1, 4):
        near[hop] = {b for a, b in edges if a in near[hop - 1]}
    least = {}
    for hop, found in near.items():
        for x in found:
            least.setdefault(x, hop)
    assert {r["node"]: r["hop"] for r in G.k_hop(e, n.where("node = 0"), 3).collect()} == least
    rank = G.pagerank(n, e, rounds=15).collect()
    assert abs(sum(r["rank"] for r in rank) - 1) < 1e-6
    m = G.measures(n, e).first()
    assert m["nodes"] == 40 and m["components"] == len({root(k) for k in range(40)})


def test_statistics_of_one_row_and_bootstrap(spark):
    r = A.statistics(spark.createDataFrame([(2.0,)], "v double"), "v").first()
    assert r["std"] == 0 and r["median"] == 2
    b = A.bootstrap(spark.createDataFrame([(k, float(k % 2)) for k in range(400)], "id long, v double"), "v", 200).first()
    assert b["low"] < 0.5 < b["high"] and b["high"] - b["low"] < 0.2


def test_persona_files(spark, tmp_path):
    for k in (2, 10):
        d = tmp_path / f"persona_{k}" / "eval"
        d.mkdir(parents=True)
        (d / "generated_dialogues.json").write_text(json.dumps({"metadata": {}, "sessions": [{"session_id": s, "persona_id": k, "noise_id": 1 if s == 1 else None, "messages": []} for s in range(3)]}))
    df = files.persona_sessions(spark, str(tmp_path), most=1, head=2)
    assert [(r["persona"], r["session_id"], r["is_noise"]) for r in df.orderBy("session_id").collect()] == [(2, 0, False), (2, 1, True)]
    assert files.persona_sessions(spark, str(tmp_path), personas=[10]).count() == 3
