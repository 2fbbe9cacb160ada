from pyspark.sql import functions as F

from recollect.operators import curation as C
from recollect.streaming import streams as S


def batches(spark, tmp_path, rows, schema, parts):
    for k, part in enumerate(parts):
        spark.createDataFrame([rows[i] for i in part], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/t.parquet")
    return str(tmp_path)


def test_unit_state_equals_the_window(spark, tmp_path):
    rows = [(p, s, s % 4 == 1) for p in range(3) for s in range(11)]
    d = batches(spark, tmp_path, rows, "persona_id long, session_id long, is_noise boolean", [[i for i, r in enumerate(rows) if r[1] < 5], [i for i, r in enumerate(rows) if r[1] >= 5]])
    got = S.drained(S.unit_builder(S.stream_of(spark, d, "t", 100), 2), "update")
    batch = C.units(spark.createDataFrame([(p, s, s, n) for p, s, n in rows], "persona_id long, session_id long, original_index int, is_noise boolean"), 2)
    want = {r["persona_id"]: r["n"] for r in batch.where("boundary").groupBy("persona_id").agg(F.count("*").alias("n")).collect()}
    assert {r["persona_id"]: r["units"] for r in got.collect()} == want


def test_upsert_survives_a_repeated_batch(spark, tmp_path):
    write = S.idempotent_upsert(f"{tmp_path}/u", ["k"])
    write(spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), 0)
    for _ in range(2):
        write(spark.createDataFrame([(1, "c")], "k long, v string"), 1)
    assert {r["k"]: r["v"] for r in S.latest(spark, f"{tmp_path}/u", ["k"]).collect()} == {1: "c", 2: "b"}


def test_windows_count_every_closed_event(spark, tmp_path):
    rows = [(k, f"2024-01-01 {k:02d}:30:00", "a", 1.0) for k in range(20)]
    spark.createDataFrame(rows, "event_id long, s string, event_type string, value double").withColumn("ts", F.col("s").cast("timestamp")).drop("s").coalesce(1).write.parquet(f"{tmp_path}/t.parquet")
    out = S.drained(S.windowed(S.stream_of(spark, str(tmp_path), "t"), "2 hours"))
    assert all(r["n"] == 2 for r in out.collect()) and out.count() >= 8
