import random

from recollect.llm.reading import LEVELS, reading_levels


def test_grades_come_from_all_rated_documents(spark):
    """A word stands in about six rated documents, and in hardly two of those that the regression is fitted on."""
    rng = random.Random(11)
    word = lambda level, k: "abcd"[level] + "".join("klmnopqrst"[int(c)] for c in f"{k:03d}")
    docs = [(k, k % 4, " ".join(word(k % 4, rng.randrange(200)) for _ in range(20)) + " of the" * 30) for k in range(320)]
    df = spark.createDataFrame([(k, text) for k, _, text in docs], "doc_id long, text string")
    r = spark.createDataFrame([(k, "r1", LEVELS[level]) for k, level, _ in docs[:240]], "doc_id long, rater string, reading_level string")
    out = {x["doc_id"]: x["level"] for x in reading_levels(df, r, 48).collect()}
    assert sum(out[k] == LEVELS[level] for k, level, _ in docs[240:]) > 0.9 * 80
