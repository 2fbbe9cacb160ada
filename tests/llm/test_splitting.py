import random

import pytest
from pyspark.sql import functions as F

from recollect.llm.splitting import pieces_of, split_oversized


def texts():
    rng = random.Random(1)
    words = ["alpha", "beta", "血压", "药。", "sentence.", "clause,", "\n", "\n\n", "😀", "x" * 40]
    return ["".join(rng.choice(words) + rng.choice([" ", "", " "]) for _ in range(rng.randint(150, 600))) for _ in range(30)] + ["y" * 5000, "，" * 1201, " " * 1500, "a" * 1200 + "b"]


@pytest.mark.parametrize(("limit", "overlap"), [(1200, 100), (200, 0), (50, 20)])
def test_round_trip_limit_and_overlap(spark, limit, overlap):
    rows = [(k, t) for k, t in enumerate(texts()) if len(t) > limit]
    out = split_oversized(spark.createDataFrame(rows, "k long, content string"), ["k"], "content", limit, overlap).orderBy("k", "piece_no").collect()
    source = dict(rows)
    joined = dict.fromkeys(source, "")
    for r in out:
        assert 0 < len(r["piece"]) <= limit
        assert source[r["k"]][r["start"] : r["start"] + len(r["piece"])] == r["piece"]
        done = joined[r["k"]]
        assert len(done) - r["start"] == (min(overlap, len(done)) if r["piece_no"] else 0)
        joined[r["k"]] = done + r["piece"][len(done) - r["start"] :]
    assert joined == source


def test_boundaries(spark):
    paragraphs = "\n\n".join(("word " * 100).strip() + "." for _ in range(8))
    df = spark.createDataFrame([(1, paragraphs)], "k long, content string")
    pieces = [r["piece"] for r in split_oversized(df, ["k"]).orderBy("piece_no").collect()]
    assert all(p.endswith(".\n\n") for p in pieces[:-1])
    sentence = " ".join("Some words here, and more." for _ in range(100))
    df = spark.createDataFrame([(1, sentence)], "k long, content string")
    assert all(r["piece"].rstrip().endswith(".") for r in split_oversized(df, ["k"]).collect())


def test_null_short_empty_and_repeated(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "short", 5), (4, "z" * 1201, 5), (4, "z" * 1201, 5)], "k long, content string, piece int")
    assert split_oversized(df, ["k"]).count() == 2
    r = df.select("k", pieces_of(F.col("content")).alias("p")).orderBy("k").collect()
    assert r[0]["p"] is None and [x["text"] for x in r[1]["p"]] == [""] and r[2]["p"][0]["text"] == "short"
    assert split_oversized(df.where("k < 0"), ["k"]).count() == 0
    with pytest.raises(ValueError):
        pieces_of(F.col("content"), 10, 10)
