"""Operators on changing tables, graphs, streams and searches against loops over small inputs."""

import random

from pyspark.sql import functions as F

from recollect.functions import text as T
from recollect.operators import aggregates as A
from recollect.operators import chunking as K
from recollect.operators import curation as C
from recollect.operators import graph as G
from recollect.operators import retrieval as R
from recollect.operators import stores as S
from recollect.streaming import streams as ST


def test_chunks_are_stretches_of_the_text():
    text = "病人血压高。今天吃药。明天复查。 He walked home. Then he slept well!\n\nNext part, with many words and no end " * 6
    for splitter in (K.recursive_splitter(40, 10), K.recursive_splitter(30, 0, ("\n", "。", ". ", " ", "")), K.sentence_packer(50), K.paragraph_packer(80)):
        out = splitter(text)
        assert out and all(c in text for c in out)
        assert all(len(c.strip()) <= 80 for c in out)
    assert K.recursive_splitter(10, 0, ("。", ""))("病人血压高。今天吃药。明天复查。") == ["病人血压高。", "今天吃药。明天复查。"]
    for t in (text, "", " ", "one", "a. b! c? " * 9, "\n\n\n"):
        assert "".join(K.lossless(7)(t)) == t
        assert "".join(K.sentences(t)) == t


def test_ranks_of_a_hot_group(spark):
    rng = random.Random(1)
    rows = [(k, "hot" if k % 10 else None if k % 20 else "rare", float(rng.randrange(30))) for k in range(500)]
    out = {r["k"]: r["n"] for r in R.ranked(spark.createDataFrame(rows, "k long, g string, v double"), "g", [F.desc("v"), F.col("k")], "n").collect()}
    for g in ("hot", "rare", None):
        mine = sorted((r for r in rows if r[1] == g), key=lambda r: (-r[2], r[0]))
        assert [out[r[0]] for r in mine] == [*range(1, len(mine) + 1)]


def test_keep_first_equals_a_loop(spark):
    rng = random.Random(2)
    pairs = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(70)}
    kept: list[int] = []
    for i in range(40):
        if not any((j, i) in pairs for j in kept):
            kept.append(i)
    out = R.keep_first(spark.range(40), spark.createDataFrame([*pairs], "a long, b long"))
    assert sorted(r["id"] for r in out.where("kept").collect()) == kept and out.count() == 40
    assert R.keep_first(spark.range(0), spark.createDataFrame([], "a long, b long")).count() == 0


def test_cursor_pages_meet(spark):
    rows = spark.createDataFrame([(k, float(k % 7)) for k in range(45)], "id long, v double")
    got, cursor = [], None
    while True:
        page, cursor = R.cursor_page(rows, "v", "id", ("v",), cursor, 10)
        got += [(r["v"], r["id"]) for r in page]
        if cursor is None:
            break
    assert got == sorted(got, key=lambda x: (-x[0], x[1])) and len(got) == 45


def test_stream_state_over_several_batches(spark, tmp_path):
    d = str(tmp_path)
    rows = [(k, k % 3, 60 * k) for k in range(60)]
    for b in range(5):
        spark.createDataFrame(rows[b * 12 : b * 12 + 12], "event_id long, user_id long, at long").coalesce(1).write.mode("append").parquet(f"{d}/log.parquet")
    stream = lambda: ST.stream_of(spark, d, "log", files=1)
    rounds = {r["event_id"]: r["round"] for r in ST.drained(ST.fair_rounds(stream(), "user_id", "event_id", 4)).collect()}
    assert len(rounds) == 60 and all(sum(1 for e, x in rounds.items() if e % 3 == u and x == n) <= 4 for u in range(3) for n in range(5))
    fresh = {r["user_id"]: r["refreshes"] for r in ST.drained(ST.refresher(stream(), "user_id", "at", 600), "update").collect()}
    assert set(fresh) == {0, 1, 2} and all(3 <= n <= 6 for n in fresh.values())


def test_reclaimed_tasks(spark):
    log = spark.createDataFrame([(1, 0, False), (1, 10, True), (2, 5, False), (3, 9000, False), (2, 1, True), (4, 7000, True)], "task long, at long, done boolean")
    assert [tuple(r) for r in ST.reclaimable(log, "task", "at", F.col("done"), 3600).collect()] == [(2, 1, 8995)]


def test_noise_keeps_its_order_and_comes_early(spark):
    o = spark.createDataFrame([("p", 100 + k, k) for k in range(50)], "key string, n long, at int")
    noise = spark.createDataFrame([("p", k) for k in range(20)] + [("q", 1)], "key string, n long")
    out = [(r["n"], r["is_noise"]) for r in C.interleaved(o, noise, "key", "n", "7").orderBy("position").collect()]
    assert [n for n, x in out if x] == [*range(20)] and [n for n, x in out if not x] == [*range(100, 150)]
    places = [sum(1 for m, y in out[:i] if not y) for i, (n, x) in enumerate(out) if x]
    assert sum(p <= 10 for p in places) >= 6 and max(places) <= 50


def test_collection_and_graph_changes(spark):
    v = spark.createDataFrame([(k, [float(k), 1.0], k % 2) for k in range(10)], "vec_id long, v array<double>, label int")
    c = S.Collection(v.where("vec_id < 5")).insert(v).update(spark.createDataFrame([(3, [0.0, 9.0], 7), (77, [0.0, 0.0], 7)], v.schema)).delete(F.col("vec_id") == 9)
    assert sorted(r["vec_id"] for r in c.list().collect()) == [*range(9)] and c.get(3).first()["label"] == 7
    g = G.Graph(spark.range(5).withColumnRenamed("id", "node"), spark.createDataFrame([(0, 1), (1, 2), (2, 0), (3, 3)], "src long, dst long"))
    assert {tuple(r) for r in g.delete_nodes(F.col("node") == 2).degrees().collect()} == {(0, 0, 1), (1, 1, 0), (3, 1, 1), (4, 0, 0)}
    assert {tuple(r) for r in g.merge(F.when(F.col("node") == 1, 0).otherwise(F.col("node"))).edges.collect()} == {(0, 2), (2, 0)}
    assert sorted(r["node"] for r in g.disconnected().collect()) == [4]


def test_monitor_keeps_the_best_of_the_old(spark):
    old = spark.createDataFrame([("u", "a", 5.0, 3), ("u", "b", 4.0, 1), ("u", "c", 9.0, 2)], "u string, k string, score double, recordings long")
    new = spark.createDataFrame([("u", "a", 1.0), ("u", "d", 2.0)], "u string, k string, score double")
    out = {r["k"]: (r["score"], r["recordings"]) for r in S.retained(old, new, "u", "k", 1, 9).collect()}
    assert out == {"a": (1.0, 4), "d": (2.0, 1), "c": (0.0, 1)}


def test_uuid5_and_date_ranges(spark):
    import hashlib
    import json
    import uuid
    from datetime import datetime

    row = spark.range(1).select(T.uuid5(uuid.NAMESPACE_DNS.hex, F.lit("x-0")).alias("u"), T.config_hash({"b": F.lit("é"), "a": F.lit(3)}).alias("h")).first()
    assert row["u"] == str(uuid.uuid5(uuid.NAMESPACE_DNS, "x-0"))
    assert row["h"] == hashlib.md5(json.dumps({"a": 3, "b": "é"}, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:16]
    now = F.lit("2024-05-15 10:30:00").cast("timestamp_ntz")
    get = lambda p: tuple(spark.range(1).select(T.date_range(F.lit(p), now).alias("r")).first()["r"])
    assert get("THIS week?")[0] == datetime(2024, 5, 13) and get("last 2 months")[0] == datetime(2024, 3, 16) and get("nothing") == (None, None)
    assert get("yesterday") == (datetime(2024, 5, 14), datetime(2024, 5, 14, 23, 59, 59, 999999))


def test_bootstrap_covers_the_mean(spark):
    b = A.bootstrap(spark.createDataFrame([(float(k % 2),) for k in range(400)] + [(None,)], "v double"), "v", 2000).first()
    assert abs(b["mean"] - 0.5) < 0.01 and 0.43 < b["low"] < 0.48 and 0.52 < b["high"] < 0.57
