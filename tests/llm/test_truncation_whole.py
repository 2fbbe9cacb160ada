import random

import numpy as np
import pytest

from recollect.llm import truncation


def rows_of(n):
    rng = random.Random(12)
    rows = []
    for k in range(n):
        t = " ".join(f"{rng.choice(['The patient', 'Dr Miller', 'A neighbour'])} {rng.choice(['noticed', 'reported', 'mentioned'])} {rng.choice(['mild', 'sharp', 'steady'])} {rng.choice(['headaches', 'back pain', 'nausea'])} after {rng.choice(['walking', 'dinner', 'work'])}." for _ in range(rng.randint(1, 4)))
        cut = rng.randint(20, len(t) - 4)
        short = k % 10 == 1 and not t[:cut].rstrip().endswith(".")
        rows.append((k, t[:cut] if short else t, short))
    return rows


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(rows_of(1600), "k long, text string, truth boolean").repartition(3).cache()


def test_texts_beyond_one_part_are_fitted_and_held_out(spark, texts):
    r = truncation.holdout(texts, ["k"], "text", [], 200).collect()[0]
    assert 250 < r["texts"] < 550 and r["cuts"] > 400 and r["recall"] > 0.9  # two of eight parts; a sample of 200 holds 40 out
    out = {r["k"]: r["truncated"] for r in truncation.truncated(texts, ["k"], "text", [], 200).collect()}
    rows = rows_of(1600)
    assert len(out) == 1600
    assert sum(out[k] for k, _, y in rows if y) > 0.9 * sum(y for *_, y in rows) and sum(out[k] for k, _, y in rows if not y) < 0.05 * len(rows)


def test_repeated_rows_count_once_in_the_held_out_texts(spark, texts):
    one, two = (truncation.holdout(t, ["k"], "text", [], 200).collect() for t in (texts, texts.union(texts)))
    assert one == two


def test_lexicon_counts_all_texts(spark):
    df = spark.createDataFrame([(f"the blorrent {'vatic, yes' if k < 4 else 'vatic no'} end",) for k in range(40)] + [("红色药片，好",)], "_text string").repartition(5)
    known = truncation.lexicon_of(df, 1.0)
    assert [known[w] for w in ("the", "vatic", "end", "红", "药片")] == ["3p0", "3p3", "0p0", "1p0", "1p5"]
    fewer = truncation.lexicon_of(df, 0.05)
    assert [fewer[w] for w in ("the", "药片")] == ["1p0", "0p0"]


def test_threshold_rests_on_all_held_out_cuts(spark, texts, monkeypatch):
    """No part has enough held-out cuts by itself."""
    monkeypatch.setattr(truncation, "HIGHEST", 100.0)
    r = truncation.holdout(texts, ["k"], "text", [], 200).collect()[0]
    assert r["threshold"] != truncation.THRESHOLD and 0.985 <= r["recall"] <= 0.995


def test_threshold_from_counts_is_the_quantile():
    odds = np.round(np.random.default_rng(2).normal(-2, 1, 5000), 1)
    values, counts = np.unique(odds, return_counts=True)
    assert truncation.threshold_of(dict(zip(values.tolist(), counts.tolist()))) == pytest.approx(min(truncation.HIGHEST, np.quantile(odds, truncation.LOSS)))
    assert truncation.threshold_of({-5.0: truncation.LEAST_HELD - 1}) == truncation.THRESHOLD


def test_identical_examples_are_fitted_as_one():
    rng = np.random.default_rng(5)
    c = np.array([[0, 1 + x, 4 + x * y] for x, y in rng.integers(0, 3, (300, 2))])
    y = (rng.random(300) < 0.3 + 0.1 * (c[:, 1] == 2)).astype(float)
    r, c = np.repeat(np.arange(300), 3), c.ravel()
    weight = np.ones(300)
    fewer = truncation.merged(r, c, y, weight)
    assert len(fewer[2]) < 20 and fewer[3].sum() == 300
    assert np.allclose(truncation.logistic_fit(r, c, y, 10, weight), truncation.logistic_fit(fewer[0], fewer[1], fewer[2], 10, fewer[3]))
